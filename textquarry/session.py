"""Session helpers: defaults for local use and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for one machine; a cluster's own session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textquarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TEXTQUARRY_DRIVER_MEMORY", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's shared one if it names one.

    Only where ``spark.checkpoint.dir`` is unset (tests, one machine) a folder
    of this machine is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    target = shared or tempfile.mkdtemp(prefix="textquarry-checkpoint-")
    spark.sparkContext.setCheckpointDir(target)
    return target


#: Shuffle files go at the end of a query, not when the driver collects its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the queries inside are gone when each ends."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Cut the lineage with a table written to the checkpoint folder.

    It survives lost executors, and unlike a checkpointed frame, which keeps
    the size estimate of its source, it is planned by its own size, so that no
    side is broadcast that grew beyond the threshold. Files go with the
    session's JVM, or before by ``drop_cut``. With ``free`` the shuffle files
    of the write are gone when it ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    with freed_shuffles(spark) if free else nullcontext():
        df.write.parquet(path)
    fs, at = path_of(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a frame of ``cut`` that no plan needs any more."""
    fs, at = path_of(df.sparkSession, df._cut_path)
    fs.delete(at, True)


def path_of(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path, as its JVM objects."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def spread(df: DataFrame) -> DataFrame:
    """Repartition a text input whose files give fewer splits than there are
    cores, so that per-row work does not run on one core. Larger inputs stay
    as the scan splits them."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
