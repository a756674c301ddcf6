"""Most frequent items among billions: exact spillable aggregation with local and final top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_values(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """The k most frequent non-null values of each of the (integer) columns: side (the column's name), node, n_rows, exact.

    Counts are combined map-side, then per hash partition in an aggregation that spills to disk when memory runs out. Each
    partition keeps its own k best in a heap (ordered limit), and only these meet in the final ordered limit, so nothing but k
    rows per partition is ever gathered. Ties go to the smaller value. Fewer than k values: all of them. All rows count,
    repeated ones too; nulls don't. Empty input or all nulls: no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")

    def one(c: str) -> DataFrame:
        counts = df.select(F.col(c).cast("long").alias("node")).filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n_rows"))
        return counts.orderBy(F.col("n_rows").desc(), "node").limit(k).select(F.lit(c).alias("side"), "node", "n_rows")

    return reduce(DataFrame.union, map(one, columns))
