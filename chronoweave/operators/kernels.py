"""Grouped vector kernels over the edges of a block: degrees, prefix sums, sums by root, softmax and its gradient. Attention is in nn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def in_degrees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    d = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return ids.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def balance_marks(prefix: DataFrame, threshold: int, chunk: int = 256) -> DataFrame:
    """id, mark: 1 where ptr passes a multiple of threshold against the row before within its chunk of ids."""
    chunks = prefix.withColumn("_c", F.floor(F.col("id") / chunk))
    last = F.lag("ptr").over(Window.partitionBy("_c").orderBy("id"))
    step = F.floor(F.col("ptr") / threshold) > F.floor(last / threshold)
    return chunks.select("id", F.coalesce(step, F.lit(False)).cast("int").alias("mark"))


def scatter_sum(rows: DataFrame, by: list[str], vector: str, width: int) -> DataFrame:
    """Sum of the vectors (of `width` elements) of each group, per position: by, pos, value. Null vectors and elements are passed over.

    The elements are summed side by side, so a group moves as one row.
    """
    sums = rows.filter(F.col(vector).isNotNull()).groupBy(*by).agg(*(F.sum(F.col(vector)[i].cast("double")).alias(f"_s{i}") for i in range(width)))
    return sums.select(*by, F.posexplode(F.array(*(f"_s{i}" for i in range(width)))).alias("pos", "value"))


def edge_softmax(rows: DataFrame, by: list[str], score: str, out: str = "y") -> DataFrame:
    """exp(x - max) / sum per group, whatever its degree; rows with null scores are left out."""
    w = Window.partitionBy(*by)
    e = rows.filter(F.col(score).isNotNull()).withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def edge_softmax_gradient(rows: DataFrame, by: list[str], y: str, dy: str) -> DataFrame:
    """dx = y * (dy - sum of y * dy over the group)."""
    return rows.withColumn("dx", F.col(y) * (F.col(dy) - F.sum(F.col(y) * F.col(dy)).over(Window.partitionBy(*by))))


def nan_rows(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector holds a NaN."""
    return rows.filter(F.exists(vector, lambda x: F.isnan(x)))
