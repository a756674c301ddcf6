"""Row numbers and running sums over a whole table without bringing it into one task, with one shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from chronoweave.session import written

_IN_PARTITION = (1 << 33) - 1  # fixed value: the bits that number the rows of a partition in Spark's ids


def _offsets(kept: DataFrame, of) -> DataFrame:
    """_part and the sum over all parts before it: one row a partition."""
    sums = kept.groupBy("_part").agg(of.alias("_sum"))
    return sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))


def _finished(kept: DataFrame, of, name: str) -> DataFrame:
    return kept.join(F.broadcast(_offsets(kept, of)), "_part").withColumn(name, F.col("_offset") + F.col("_before")).drop("_part", "_of", "_before", "_offset")


def with_prefix_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add `name`, the sum of `value` over all rows before this one in `order`, which must be a total order.

    Rows are range-partitioned and sorted by `order`, summed up within their partition as they come and written once, since another
    run of the partitioner could draw other bounds. The sums of the partitions, one row each, give the offsets. Nulls in
    `value` count as 0 and come first where they are in `order`. Empty input gives no rows.
    """
    ranged = df.withColumn("_of", F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long"))).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    out = StructType([*ranged.schema.fields]).add("_before", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for b in batches:
            upto = so_far + np.cumsum(b.column("_of").to_numpy(zero_copy_only=False))
            if len(upto):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - b.column("_of").to_numpy(zero_copy_only=False), pa.int64())], names=[*b.schema.names, "_before"])
                so_far = int(upto[-1])

    return _finished(written(ranged.mapInArrow(run, out), "ordered"), F.sum("_of"), name)


def with_row_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Add the number of each row in `order`, from 0: Spark's increasing ids within the sorted range, plus the rows of the ranges before."""
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    split = ranged.select(*df.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(_IN_PARTITION).alias("_before"))
    return _finished(written(split, "ordered"), F.count(F.lit(1)), name)
