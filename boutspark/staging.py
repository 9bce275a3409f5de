"""Intermediate tables in the shared checkpoint folder.

A staged table cuts lineage, survives the loss of executors and is read back
column by column, so several consumers do not repeat the work before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
# temporary folders of local applications without the setting
_OWN: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only in local mode."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
    name = spark.sparkContext.applicationId
    if name not in _OWN:
        _OWN[name] = tempfile.mkdtemp(prefix="boutspark-")
    return _OWN[name]


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's staged tables."""
    return f"{staging_root(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and return the written table; `release` removes all of a run."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Remove every table that this application has staged; their readers are of no use after it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(path) and system.delete(path, True))
