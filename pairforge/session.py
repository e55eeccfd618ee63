"""A session with the settings that the package expects."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "pairforge", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow; further settings by keyword with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
    }
    for k, v in (fixed | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out over all of them.

    A small table in one file would keep one core busy; large tables have more
    partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can see.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (unit tests) a folder inside the warehouse is used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pairforge-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so that no later job repeats it."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """As :func:`written`, in buckets of a column: what groups by it reads them without another exchange."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"pairforge_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(table)
    out = spark.table(table)
    out._written_at, out._written_as = path, table
    return out


def removed(df: DataFrame) -> None:
    """Remove the files of a frame of ``written`` or ``bucketed`` that nothing reads any more."""
    if getattr(df, "_written_as", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._written_as}")
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffled files of a finished job go at once, for steps that write each result and read it back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
