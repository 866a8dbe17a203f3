"""Session set-up and shared working folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_DIRS: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks (a cluster brings its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("venuekit")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting: it then gets a fresh
    temporary folder. On a cluster a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="venuekit-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder when the session's JVM ends."""
    context = spark.sparkContext
    stored = context._jvm.org.apache.hadoop.fs.Path(path)
    stored.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(stored)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back.

    Used where a result feeds several jobs (tuning folds, neighbour blocks); the
    written table survives the loss of any executor and goes when the session's JVM ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    delete_on_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give an under-split input to all cores before costly per-row work.

    A large input has more splits than cores and passes through untouched; only a table
    that would leave half of the cluster idle is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
