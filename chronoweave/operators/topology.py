"""Which workers share most of their inputs: similarity of equal chunks, and the pairing of greatest weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators import matching


def chunk_similarity(rows: DataFrame, parts: int) -> DataFrame:
    """batch, i, j, w: positions at which chunks i and j of a batch's nodes agree, zeros left out.

    A batch (batch, root_pos, node) is cut to a multiple of `parts` and into chunks in order; a null node agrees with none.
    """
    at = F.row_number().over(Window.partitionBy("batch").orderBy("root_pos")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("batch"))
    c = rows.select("batch", "node", at.alias("_at"), F.floor(n / parts).alias("_len")).filter((F.col("_len") > 0) & (F.col("_at") < F.col("_len") * parts))
    c = c.select("batch", "node", F.floor(F.col("_at") / F.col("_len")).cast("int").alias("i"), F.pmod(F.col("_at"), F.col("_len")).alias("p"))
    return c.join(c.withColumnRenamed("i", "j"), ["batch", "p", "node"]).groupBy("batch", "i", "j").agg(F.count(F.lit(1)).alias("w"))


def accumulated(similarity: DataFrame) -> DataFrame:
    return similarity.groupBy("i", "j").agg(F.sum("w").alias("w"))


def full_matrix(similarity: DataFrame, parts: int) -> DataFrame:
    """i, j, w for all parts * parts pairs."""
    ids = similarity.sparkSession.range(parts * parts).select((F.col("id") / parts).cast("int").alias("i"), F.pmod("id", F.lit(parts)).cast("int").alias("j"))
    return ids.join(similarity, ["i", "j"], "left").select("i", "j", F.coalesce("w", F.lit(0)).alias("w"))


def pairing(weights: dict[tuple[int, int], int], parts: int) -> list[int]:
    """Partner of each part in a perfect matching of greatest weight, exact for any number of parts (-1 for the one left over)."""
    n = parts + parts % 2  # a part without weights stands for being left over
    both = [[weights.get((i, j), 0) + weights.get((j, i), 0) if i != j else 0 for j in range(n)] for i in range(n)]
    return [p if p < parts else -1 for p in matching.perfect_matching(both)[:parts]] if parts else []
