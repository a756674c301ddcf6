"""Readers of edges and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INT_MAX = 2147483647
EDGE_SCHEMA = "eid long, src long, dst long, time long, ext_roll int"


def text_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Lines (line) of text files; with header the first line of each file is dropped, however the file is split."""
    if not header:
        return spark.read.text(path).withColumnRenamed("value", "line")
    return spark.read.schema("line string").option("header", True).option("sep", "\u0001").option("quote", "").option("escape", "").csv(path)


def parted_edges(lines: DataFrame, *carried: str) -> DataFrame:
    """carried columns, src, dst, time and ok of white-space separated lines (column line).

    A line is ok if it has exactly three fields of the digits 0-9, each at most 2147483647 however many leading zeros it has; blanks,
    tabs and CR at both ends don't count. The three are null where a line isn't ok.
    """
    p = lines.select(*carried, F.split(F.expr("trim(BOTH ' \\t\\r' FROM line)"), "[ \\t]+").alias("_p"))
    fits = lambda x: x.rlike("^0*[0-9]{1,10}$") & (F.coalesce(x.try_cast("long"), F.lit(INT_MAX + 1)) <= INT_MAX)
    told = p.withColumn("ok", F.coalesce((F.size("_p") == 3) & F.forall("_p", fits), F.lit(False)))
    return told.select(*carried, *(F.when(F.col("ok"), F.col("_p")[i].try_cast("long")).alias(n) for i, n in enumerate(("src", "dst", "time"))), "ok")


def text_edges(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """src, dst, time of white-space separated files; a line that isn't three whole numbers raises an error when it is read.

    For files that may hold broken lines use operators.parse_rejects.
    """
    rows = parted_edges(text_lines(spark, path, header), "line")
    stop = F.raise_error(F.concat(F.lit("not three whole numbers: "), F.coalesce("line", F.lit("null")))).cast("long")
    return rows.select(*(F.when(F.col("ok"), F.col(n)).otherwise(stop).alias(n) for n in ("src", "dst", "time")))


def csv_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge tables as CSV with the edge id in the first column."""
    return spark.read.schema(EDGE_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)


def parquet_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def features(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Feature vectors as array<float>, whatever number or boolean type they are stored in."""
    raw = spark.read.parquet(path)
    kind = raw.schema["f"].dataType.elementType.simpleString()
    one = (lambda x: x.cast("int").cast("float")) if kind == "boolean" else (lambda x: x.cast("float"))
    return raw.select(key, F.transform("f", one).alias("f"))


def csr_edges(spark: SparkSession, path: str) -> DataFrame:
    """pos, src, dst, t, eid as sinks.write_csr stores them: ordered by src, so that a filter on src reads few files and row groups."""
    return spark.read.parquet(path)


def hot_ids(spark: SparkSession, path: str) -> DataFrame:
    """node, score, place as sinks.write_hot_ids stores them."""
    return spark.read.parquet(path)
