"""Queries that run as streams over the tables and must equal the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import skew
from chronoweave.plans import base, general
from chronoweave.plans.base import E, R, block_sql
from chronoweave.session import shared_dir, table, written
from chronoweave.streaming import neighbours, sessions

K = 5
SLICES = 4
LATE = 86_400
ROWS = 50_000  # of a state of str02_recent, about


class _Feed:
    """A stream over a folder to which slices of a table are added; each is taken from where the one before ended, by its checkpoint."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema, self.at = spark, schema, f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def source(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(f"{self.at}/in")

    def take(self, rows: DataFrame, stream: Callable[[DataFrame], DataFrame]) -> None:
        rows.write.mode("append").parquet(f"{self.at}/in")
        out = stream(self.source()).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{self.at}/state")
        out.option("path", f"{self.at}/out").trigger(availableNow=True).start().awaitTermination()

    def result(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.at}/out")


def _slices(df: DataFrame, by: str) -> list[int]:
    """Upper bounds of all but the last of SLICES slices of about equal size."""
    bounds = df.agg(F.percentile_approx(by, [i / SLICES for i in range(1, SLICES)]).alias("b")).first()["b"]
    return sorted(set(bounds or []))


def str01_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions from slices of rows in order of arrival, in append mode, with the lateness between slices as the bound.

    A last row far in the future lets the watermark pass every session; it has a node of its own and stays open.
    """
    edges = table(spark, d, "edges").filter("src is not null and time is not null").select("eid", "src", "time")
    bounds = [None, *_slices(edges, "eid"), None]
    parts = [edges.filter((F.lit(True) if a is None else F.col("eid") > a) & (F.lit(True) if b is None else F.col("eid") <= b)) for a, b in zip(bounds, bounds[1:])]
    ends = [p.agg(F.min("time").alias("a"), F.max("time").alias("b")).first() for p in parts]
    seen = [e for e in ends if e["a"] is not None]
    if not seen:
        return spark.createDataFrame([], "src long, start_time long, end_time long, duration long, n_events long")
    late = max([0, *(max(e["b"] for e in seen[:i]) - seen[i]["a"] for i in range(1, len(seen)))]) + 1
    last = max(e["b"] for e in seen) + late + 10 * general.GAP
    feed = _Feed(spark, "src long, time long")
    for rows in [p.select("src", "time") for p in parts] + [spark.createDataFrame([(-(2**63), last)], "src long, time long")]:
        feed.take(rows, lambda s: sessions.sessionize_stream(s, "src", "time", general.GAP, late=f"{late} seconds"))
    return feed.result("src long, start_time long, end_time long, duration long, n_events long")


def str02_recent(spark: SparkSession, d: str) -> DataFrame:
    """Recent neighbours from slices of time; queries of negatives come a slice late, those older than the watermark are settled from the table."""
    e, q = base.edges(spark, d), base.queries(spark, d)
    none = F.lit(None).cast("long")
    asked = q.select("node", "t", none.alias("eid"), none.alias("dst"), (F.col("batch") * 1_000_000 + F.col("root_pos")).alias("query"), (F.col("role") == "neg").cast("int").alias("_later"))
    events = e.select(F.col("src").alias("node"), "t", "eid", "dst", none.alias("query"), F.lit(0).alias("_later")).unionByName(asked)
    at = F.col("_later")
    for b in _slices(e, "t"):
        at = at + (F.col("t") > b).cast("int")
    events = written(events.withColumn("_slice", at).drop("_later"), "stream-events")
    heavy = [r["node"] for r in skew.heavy_keys(e.select("src", "dst"), share=0.02).filter("side = 'src'").collect()]
    buckets = max(16, events.count() // ROWS)
    feed = _Feed(spark, "node long, t long, eid long, dst long, query long")
    for i in range(SLICES + 1):
        feed.take(events.filter(F.col("_slice") == i).drop("_slice"), lambda s: neighbours.recent_stream(s, K, f"{LATE} seconds", heavy, buckets=buckets))
    return neighbours.settled(feed.result(neighbours.FOUND), K, e, asked.select("query", "node", "t"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (str01_sessions, str02_recent)}
ORACLES = {
    "str01_sessions": general.ORACLES["p2_sessions"],
    "str02_recent": f"with {E}, {R}, q as (select batch * 1000000 + root_pos as query, node, t from r), b as ({block_sql(K, 'e', 'q', 'query')}) select query, root, root_t, nbr_pos, node, eid, t from b",
}
