"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    # event times are UTC, report dates are UTC dates
    "spark.sql.session.timeZone": "UTC",
    # repeated HTTP headers: the last one counts
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # lets the 10,000-visits-per-profile filter prune before its shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # state with timers, maps and time to live
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings above where they differ."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_spark(app_name: str = "wardline", **extra: str) -> SparkSession:
    """A configured session; master and memory come from spark-submit."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession, default: str | None = None) -> str:
    """The folder all executors share, as the cluster names it.

    ``default`` is used only where the session names none, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if default is None:
        raise ValueError("spark.checkpoint.dir is not set and no default was given")
    return default.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables of one run; a local folder only where all runs on this machine.

    A cluster whose session names no shared folder is an error: executors could not
    see what others wrote.
    """
    local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
    return shared_dir(spark, _local_root() if local else None)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="wardline-")


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A new folder name below ``scratch_root``, removed when the driver ends."""
    path = f"{scratch_root(spark)}/wardline-{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, also if executors are lost."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Share the rows of a few large splits among all cores before costly work on them.

    A table with enough splits is left as it is, so large inputs are not shuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
