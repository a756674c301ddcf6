"""Sessions over a stream: the merging interval state of operators.sessions under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoweave.operators.sessions import merge_intervals


def sessionize_stream(df: DataFrame, key: str, time: str, gap: int, late: str = "7 days") -> DataFrame:
    """Sessions of a stream with whole-second `time`: `key`, start_time, end_time, duration, n_events.

    Each event opens an interval of `gap` seconds; the state merges the overlapping intervals of a key, events
    that come late by up to `late` among them (a late event can join two sessions), and emits a session once the watermark has passed
    its end (output mode append). Rows with null key or time are left out. Events later than that are dropped; late_rows tells how many.
    """
    rows = df.select(F.col(key).alias("_k"), F.timestamp_seconds(F.col(time)).alias("_s")).filter("_k is not null and _s is not null")
    each = rows.withWatermark("_s", late).withColumns({"_e": F.col("_s"), "n_events": F.lit(1).cast("long")})
    found = merge_intervals(each, gap, "_s", "_e", "n_events")
    return found.select(F.col("_k").alias(key), "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "n_events")


def late_rows(query: StreamingQuery) -> int:
    """How many rows the watermark has dropped in the micro-batches of a query that its progress still tells of."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
