"""Session settings, table access and the shared folder for written intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int | None = None, app: str = "chronoweave") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            return found
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chronoweave-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext.getCheckpointDir()
    return named


_written: list[list[str]] = [[]]
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back, so that later stages don't hang on its lineage.

    The files stay until the scratch() around the call ends or drop_written is called, as results that are still lazy read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written[-1].append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the files of its shuffles go with the write, not when the driver's garbage happens to be collected
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what written() made of df before its scratch() ends, once nothing that is still lazy reads it."""
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    for paths in _written:
        for p in [p for p in paths if p.rpartition("/")[2] in read]:
            drop(df.sparkSession, p)
            paths.remove(p)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that written() left since the innermost scratch() began, once no result needs them any more; their number."""
    n = len(_written[-1])
    while _written[-1]:
        drop(spark, _written[-1].pop())
    return n


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it tables of written() are kept, at its end those made in it are deleted; results must have been stored or shown by then."""
    _written.append([])
    try:
        yield
    finally:
        drop_written(spark)
        _written.pop()
