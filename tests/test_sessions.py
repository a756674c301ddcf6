import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators.sessions import session_summary, sessionize
from chronoweave.streaming.sessions import late_rows, sessionize_stream

SCHEMA = "src long, time long"


def brute(rows, gap):
    out = []
    for key in {k for k, t in rows if k is not None and t is not None}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        start = prev = times[0]
        n = 0
        for t in times:
            if t - prev > gap:
                out.append((key, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        out.append((key, start, prev, n))
    return sorted(out)


def got(df, gap):
    return sorted((r.src, r.start_time, r.end_time, r.n_events) for r in sessionize(df, "src", "time", gap).collect())


@pytest.mark.parametrize("gap", [1, 7, 1800])
def test_against_brute_force(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, rng.randint(-40 * gap, 40 * gap)])) for _ in range(300)]
    rows += rows[:40]
    assert got(spark.createDataFrame(rows, SCHEMA), gap) == brute(rows, gap)


def test_edges_of_the_gap_and_extremes(spark):
    far = 8_999_999_999_000
    rows = [(1, 0), (1, 1800), (1, 3601), (2, -far), (2, far), (2, far)]
    res = {(r.src, r.start_time): r for r in sessionize(spark.createDataFrame(rows, SCHEMA), "src", "time", 1800).collect()}
    assert res[(1, 0)].end_time == 1800 and res[(1, 0)].duration == 1800
    assert (1, 3601) in res and len(res) == 4
    assert res[(2, far)].n_events == 2
    with pytest.raises(Exception, match="beyond"):
        sessionize(spark.createDataFrame([(2, 2**62)], SCHEMA), "src", "time", 1800).collect()


def test_empty_extra_columns_and_bad_gap(spark):
    assert sessionize(spark.createDataFrame([], SCHEMA), "src", "time", 5).count() == 0
    df = spark.createDataFrame([(1, 2, 9, 9, 9)], "src long, time long, _k long, _s long, start_time long")
    assert got(df, 5) == [(1, 2, 2, 1)]
    assert session_summary(sessionize(df, "src", "time", 5), "src").first().n_sessions == 1
    with pytest.raises(ValueError):
        sessionize(df, "src", "time", 0)


def test_hot_key_is_merged_before_the_shuffle(spark):
    df = spark.range(20000).select(F.lit(1).cast("long").alias("src"), (F.col("id") % 5000).alias("time"))
    r = sessionize(df, "src", "time", 1800).collect()
    assert len(r) == 1 and r[0].n_events == 20000 and r[0].n_intervals == 3


def test_stream_with_late_events_equals_batch(spark, tmp_path):
    rows = [(1, 100), (1, 5000), (2, 50), (1, 1900), (1, 3300), (2, 9000), (3, 400_000)]
    for i in range(0, len(rows), 2):
        spark.createDataFrame(rows[i : i + 2], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessionize_stream(stream, "src", "time", 1800, late="1 day").writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    seen = sorted((r.src, r.start_time, r.end_time, r.n_events) for r in spark.table("sess").collect())
    assert seen == [x for x in brute(rows, 1800) if x[0] != 3]


def test_late_events_join_sessions_or_are_dropped_and_counted(spark, tmp_path):
    steps = [[(1, 1000), (1, 4000)], [(1, 2500)], [(2, 400_000)], [(3, 5000), (2, 400_100)], [(2, 900_000)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out, dropped = sessionize_stream(stream, "src", "time", 1800, late="1 day"), 0
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += late_rows(q)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, 1000, 4000, 3000, 3), (2, 400_000, 400_100, 100, 2)]  # 2500 joined two, 5000 came after the watermark
    assert dropped == 1
