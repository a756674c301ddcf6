"""Writers of edges, per-node ordered tables, hot ids and weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from chronoweave.operators import etl


def write_edges(edges: DataFrame, path: str, kind: str = "parquet") -> None:
    """Edges as Parquet or as CSV with a header."""
    writer = edges.write.mode("error")
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)


def write_csr(edges: DataFrame, path: str) -> None:
    """The neighbour lists of all nodes end to end: pos, src, dst, t, eid in files of ranges of (src, t, eid), each in order."""
    flat = etl.flat_adjacency(edges).select("pos", "src", "dst", "t", "eid")
    flat.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("error").parquet(path)


def write_hot_ids(ranked: DataFrame, path: str, most: int) -> None:
    """The ids of the first `most` places of hotset.ranked."""
    ranked.filter(f"place < {int(most)}").write.mode("error").parquet(path)


def write_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """Weights as rows (name, shape, values)."""
    rows = [(n, list(w.shape), [float(x) for x in w.ravel()]) for n, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r["values"]).reshape(r.shape) for r in spark.read.parquet(path).collect()}
