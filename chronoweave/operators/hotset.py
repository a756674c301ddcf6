"""Which entities to keep near: hotness, ranking, capacity splits, and gathers parted into hits and misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.ordering import with_row_ids


def hotness(occurrences: DataFrame, key: str, block: list[str]) -> DataFrame:
    """key, score: the number of distinct blocks it occurs in; several occurrences in one block count once."""
    return occurrences.select(key, *block).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("score"))


def ranked(scores: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """All ids with their score (0 where none) and place from 0, by score, then id."""
    full = ids.select(key).join(scores, key, "left").select(key, F.coalesce("score", F.lit(0)).alias("score"), (-F.coalesce("score", F.lit(0))).alias("_neg"))
    return with_row_ids(full, ["_neg", key], "place").drop("_neg")


def joint_split(nodes: DataFrame, edges: DataFrame, capacity: int) -> DataFrame:
    """How many of the best `capacity` scores are of nodes and of edges: kind, n. Ties: by score, kind. All if they fit.

    Only the numbers of ids per score and kind are put in order, one row for each score that occurs.
    """
    both = nodes.select(F.lit("node").alias("kind"), "score").unionByName(edges.select(F.lit("edge").alias("kind"), "score"))
    per = both.groupBy("score", "kind").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy(F.col("score").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    taken = per.withColumn("_t", F.greatest(F.least(F.col("_c"), F.lit(int(capacity)) - before), F.lit(0)))
    return taken.filter("_t > 0").groupBy("kind").agg(F.sum("_t").alias("n"))


def node_first_split(n_nodes: int, n_edges: int, capacity: int) -> tuple[int, int]:
    """Nodes first, the rest to edges."""
    nodes = min(n_nodes, capacity)
    return nodes, min(n_edges, capacity - nodes)


def proportional_split(n_nodes: int, n_edges: int, capacity: int) -> tuple[int, int]:
    nodes = capacity * n_nodes // max(1, n_nodes + n_edges)
    return min(n_nodes, nodes), min(n_edges, capacity - nodes)


def capacity(n_nodes: int, n_edges: int, node_width: int, edge_width: int, ratio: float, most_bytes: int | None = None) -> int:
    """Rows of edge features that the ratio of all features takes; the ratio falls by tenths until it fits most_bytes."""
    while True:
        rows = int((n_nodes * node_width / edge_width + n_edges) * ratio)
        if most_bytes is None or rows * edge_width * 4 <= most_bytes or ratio <= 0:
            return max(rows, 0)
        ratio = round(ratio - 0.1, 1)


def hit_or_miss(rows: DataFrame, hot: DataFrame, features: DataFrame, key: str, by: str) -> DataFrame:
    """rows with f and hit, whether the key is among the hot ones; the result is that of a plain gather, and rows move once."""
    known = features.select(F.col(by).alias(key), "f").join(hot.select(F.col(by).alias(key), F.lit(True).alias("hit")).distinct(), key, "full")
    return rows.join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def gathered(rows: DataFrame, features: DataFrame, key: str, by: str, ratio: float, hot: DataFrame | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """rows with f by the method that a share of features to be kept near asks for; the result is the same for all.

    1: the whole table is sent to every executor, if its size by the numbers of its rows and elements is at most `most_bytes`; else, and
    for 0, rows and features meet by their key. In between: the features of the `hot` ids are sent where their size is within
    the bound, and only rows of other keys are moved.
    """
    f = features.select(F.col(by).alias(key), "f")
    bytes_of = lambda df: df.agg(F.coalesce(F.sum(F.size("f") * 8 + 24), F.lit(0)).alias("n")).first()["n"]
    if ratio >= 1 and bytes_of(f) <= most_bytes:
        return rows.join(F.broadcast(f), key, "left")
    if 0 < ratio < 1 and hot is not None:
        near = f.join(hot.select(F.col(by).alias(key)).distinct(), key, "left_semi")
        if bytes_of(near) <= most_bytes:
            tried = rows.join(F.broadcast(near.withColumn("_hit", F.lit(True))), key, "left")
            return tried.filter("_hit").drop("_hit").unionByName(tried.filter("_hit is null").drop("f", "_hit").join(f, key, "left"))
    return rows.join(f, key, "left")
