"""Grouping activity into sessions by merging interval state.

Every event opens an interval of gap length; the merging state of a key joins the intervals that overlap, in whatever order they come,
and a session is what was joined. The same state serves tables, whose watermark passes everything at their end, and streams, where
a session comes out once the watermark has passed it and events that come later than the allowed lateness are dropped and counted.

Of a table, events of one key in the same cell of gap width always overlap, so they are joined before the shuffle: what the state
takes is at most one interval per key and cell, however many rows a key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SECONDS = 9_000_000_000_000  # fixed value: whole seconds that a timestamp in microseconds can hold, with room for a gap


def merge_intervals(intervals: DataFrame, gap: int, start: str, end: str, *sums: str) -> DataFrame:
    """Sessions of the intervals of each _k: _k, start_time, end_time, the sums, n_intervals. start and end are timestamps.

    An interval stays open for `gap` seconds after its end, that second included. Works on tables and, with a watermark, on streams.
    """
    open_for = F.make_interval(secs=(F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0) + F.lit(gap + 0.5))
    merged = intervals.groupBy("_k", F.session_window(start, open_for).alias("_w"))
    return merged.agg(F.unix_seconds(F.min(start)).alias("start_time"), F.unix_seconds(F.max(end)).alias("end_time"), *(F.sum(c).alias(c) for c in sums), F.count(F.lit(1)).alias("n_intervals")).drop("_w")


def _cell(t: str, gap: int) -> Column:
    """floor(t / gap) without loss of digits."""
    return F.expr(f"{t} div {gap} - if({t} % {gap} < 0, 1, 0)")


def sessionize(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """Sessions of each key: `key`, start_time, end_time, duration, n_events, n_intervals.

    Two rows of one key belong to one session as long as no gap between neighbours in time exceeds `gap` (whole seconds, as
    `time`; gap >= 1). Order of arrival plays no part. Rows with null key or time are left out; repeated rows count each; equal times
    are one instant. n_intervals is the number of gap-wide cells that hold events of the session. Times beyond 9e12 seconds
    before or after 0, which a timestamp can't hold, raise an error. Other columns are ignored. Empty input gives no sessions.
    """
    if gap < 1:
        raise ValueError("gap must be at least 1")
    rows = df.select(F.col(key).alias("_k"), F.col(time).cast("long").alias("_t")).filter("_k is not null and _t is not null")
    held = F.when(F.col("_t").between(-MOST_SECONDS, MOST_SECONDS), F.col("_t")).otherwise(F.raise_error(F.lit("time beyond 9e12 seconds")).cast("long"))
    cells = rows.withColumn("_t", held).groupBy("_k", _cell("_t", gap).alias("_c")).agg(F.timestamp_seconds(F.min("_t")).alias("_s"), F.timestamp_seconds(F.max("_t")).alias("_e"), F.count(F.lit(1)).alias("n_events"))
    found = merge_intervals(cells, gap, "_s", "_e", "n_events")
    return found.select(F.col("_k").alias(key), "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "n_events", "n_intervals")


def session_summary(sessions: DataFrame, key: str) -> DataFrame:
    """Per key: number of sessions, of events, the longest and total duration."""
    return sessions.groupBy(key).agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.max("duration").alias("longest"), F.sum("duration").alias("total_duration"))
