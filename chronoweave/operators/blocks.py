"""Blocks of sampled neighbours: numbering, distinct edges, inverse indexes, row pointers, and the gather of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_features(features: DataFrame, key: str, width: int, loaded: str | None = None) -> DataFrame:
    """One whole vector per key (key, f): null, short, long and NaN vectors are left out, the last loaded wins, then the least.

    Whole-row copies so come out once; a null load time is older than any other. A null key is left out. Copies merge map-side.
    """
    good = features.filter(F.col(key).isNotNull() & (F.size("f") == width) & ~F.exists("f", lambda x: x.isNull() | F.isnan(x)))
    minus = lambda c: F.transform(c, lambda x: -x)
    when = F.lit(None).cast("timestamp") if loaded is None else F.col(loaded)
    best = good.groupBy(key).agg(F.max(F.struct(when.alias("w"), minus(F.col("f")).alias("m"))).alias("_b"))
    return best.select(key, minus(F.col("_b.m")).alias("f"))


def coo(block: DataFrame, batch: str = "batch") -> DataFrame:
    """Rows and columns of a block in coordinates: row is the number of the root within its batch, col the number of the neighbour
    after all roots. batch, row, col, root_pos, nbr_pos, node, eid, dt; roots without neighbours take no number."""
    w = Window.partitionBy(batch).orderBy("root_pos", "nbr_pos")
    return block.select(batch, (F.dense_rank().over(Window.partitionBy(batch).orderBy("root_pos")) - 1).alias("row"), (F.row_number().over(w) - 1).alias("col"), "root_pos", "nbr_pos", "node", "eid", "dt")


def distinct_edges(block: DataFrame, batch: str = "batch") -> DataFrame:
    return block.select(batch, "eid").distinct()


def inverse_edges(block: DataFrame, batch: str = "batch") -> DataFrame:
    """Each sampled edge with the number of its eid among the batch's distinct ones, in order of eid."""
    return block.select(batch, "root_pos", "nbr_pos", "eid", (F.dense_rank().over(Window.partitionBy(batch).orderBy("eid")) - 1).alias("inv"))


def row_pointers(block: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch and root with neighbours, in order: batch, root_pos, n, start and stop, the running sums of n."""
    per = block.groupBy(batch, "root_pos").agg(F.count(F.lit(1)).alias("n"))
    stop = F.sum("n").over(Window.partitionBy(batch).orderBy("root_pos").rowsBetween(Window.unboundedPreceding, 0))
    return per.select(batch, "root_pos", "n", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def dimensions(queries: DataFrame, block: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch dim_out (roots), n_edges, dim_in (roots and sampled neighbours)."""
    out = queries.groupBy(batch).agg(F.count(F.lit(1)).alias("dim_out"))
    got = block.groupBy(batch).agg(F.count(F.lit(1)).alias("n_edges"))
    n = F.coalesce("n_edges", F.lit(0))
    return out.join(got, batch, "left").select(batch, "dim_out", n.alias("n_edges"), (F.col("dim_out") + n).alias("dim_in"))


def message_rows(queries: DataFrame, block: DataFrame) -> DataFrame:
    """Source side of a block: the roots, then their neighbours, as batch, root_pos, nbr_pos (-1 for a root), node, t, dt."""
    own = queries.select("batch", "root_pos", F.lit(-1).alias("nbr_pos"), "node", "t", F.lit(0).cast("long").alias("dt"))
    return own.unionByName(block.select("batch", "root_pos", "nbr_pos", "node", "t", "dt"))


def reversed_block(block: DataFrame) -> DataFrame:
    """Direction swapped, for delivery of mails: from the root to its neighbours."""
    return block.select("batch", "root_pos", "nbr_pos", F.col("root").alias("node"), F.col("node").alias("root"), "eid", "t", "dt")


def gather(rows: DataFrame, features: DataFrame, key: str, by: str) -> DataFrame:
    """rows with f of their key, null where there is none; the hot keys of rows are left to adaptive skew joins, as features has one row a key."""
    return rows.join(features.select(F.col(by).alias(key), "f"), key, "left")


def gather_distinct(rows: DataFrame, features: DataFrame, key: str, by: str) -> DataFrame:
    """The same result, each feature row moved once: distinct keys meet the features, rows meet the few that are needed."""
    need = rows.select(key).distinct().join(features.select(F.col(by).alias(key), "f"), key)
    return rows.join(need, key, "left")


def distinct_occurrences(rows: DataFrame) -> DataFrame:
    """Distinct (node, t) of a block with how often each occurs: the rows a model computes once."""
    return rows.groupBy("node", "t").agg(F.count(F.lit(1)).alias("n"))
