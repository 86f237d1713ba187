"""Session factory and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files when the query has ended, not when the driver collects its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None
#: Folders that materialize has written.
_written: list[str] = []


def get_session(app: str = "lakewright", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library counts on; a running session is taken as it is."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if cores:
        builder = builder.master(f"local[{cores}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a temporary folder, with a local master only."""
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_dir is None or not os.path.isdir(_local_dir):
        _local_dir = tempfile.mkdtemp(prefix="lakewright-")
    return f"file://{_local_dir}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and gives the planner a measured size, so that it
    broadcasts a side only below spark.sql.autoBroadcastJoinThreshold. Shuffle files of the step go as soon as it is written.
    The table itself goes when the driver ends, or with drop_materialized.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if was is None else spark.conf.set(_DROP_SHUFFLES, was)
    folder, fs = _folder(spark, path)
    fs.deleteOnExit(folder)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    """The path as Hadoop's, and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_materialized(spark: SparkSession) -> int:
    """Deletes all tables that materialize has written so far, once the results that read them are written; how many."""
    n = 0
    while _written:
        folder, fs = _folder(spark, _written.pop())
        fs.cancelDeleteOnExit(folder)
        n += fs.delete(folder, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
