"""Per-key results without imbalance when a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("src", "dst")


def heavy_keys(edges: DataFrame, share: float = 0.005, most: int = 400) -> DataFrame:
    """Candidates (side, node) for keys with at least `share` of the rows, by a sketch of bounded memory over all rows.

    At most `most` keys a side, so the result may be broadcast whatever the input's size (share * most must be >= 1 for none
    to be missed; a key missed or named too much only costs balance, never rightness).
    """
    tracked = max(10 * most, int(8 / share))
    kind = "array<struct<side:string,node:bigint,n:bigint>>"

    def top(side: str) -> Column:
        best = F.expr(f"approx_top_k({side}, {most}, {tracked})")
        return F.coalesce(F.transform(best, lambda x: F.struct(F.lit(side).alias("side"), x["item"].cast("long").alias("node"), x["count"].alias("n"))), F.array().cast(kind))

    found = edges.agg(F.count(F.lit(1)).alias("_total"), F.concat(*map(top, SIDES)).alias("_top"))
    return found.select("_total", F.explode("_top").alias("_x")).filter(F.col("_x.n") >= F.col("_total") * share).select("_x.side", "_x.node")


def node_results(edges: DataFrame, salts: int = 64, share: float = 0.005) -> DataFrame:
    """Per (side, node): n_rows (degree), first_time, last_time, n_partners, n_loops, for each src and each dst.

    Repeated (src, dst) pairs merge before the first shuffle, which is by pair and so never on a hot node alone. The rows of a
    heavy node then get a salt from a hash of the partner (pseudo-random, so a rerun task gives the same rows), partial
    results are made per (side, node, salt) and merged per (side, node). As one partner has one salt, numbers of partners add up.

    Null nodes give no result; a null partner counts in n_rows but not in n_partners; null times are passed over and a node
    with none has null times. Repeated rows count each. Extra columns are ignored. An empty table gives an empty result.
    """
    rows = edges.select(*(F.col(s).cast("long").alias(s) for s in SIDES), F.col("time").cast("long").alias("_t"))
    pairs = rows.groupBy(*SIDES).agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    ends = F.array(*(F.struct(F.lit(a).alias("side"), F.col(a).alias("node"), F.col(b).alias("_other")) for a, b in (SIDES, SIDES[::-1])))
    long = pairs.select(F.explode(ends).alias("_e"), "_n", "_first", "_last").select("_e.*", "_n", "_first", "_last").filter("node is not null")
    heavy = heavy_keys(rows, share).withColumn("_heavy", F.lit(True))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64("_other"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    salted = long.join(F.broadcast(heavy), ["side", "node"], "left").withColumn("_salt", salt)
    partial = salted.groupBy("side", "node", "_salt").agg(
        F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.count("_other").alias("_p"), F.sum(F.when(F.col("node") == F.col("_other"), F.col("_n")).otherwise(0)).alias("_l")
    )
    return partial.groupBy("side", "node").agg(F.sum("_n").alias("n_rows"), F.min("_first").alias("first_time"), F.max("_last").alias("last_time"), F.sum("_p").alias("n_partners"), F.sum("_l").alias("n_loops"))


def dominant_nodes(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """Nodes that hold at least `share` of all rows in their column; rows with nulls count in the total."""
    total = edges.agg(F.count(F.lit(1)).alias("_total")).scalar()
    return node_results(edges).filter(F.col("n_rows") >= total * share)
