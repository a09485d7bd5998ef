"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where it is absent and all tasks run on one machine (tests, a laptop) is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None and context.master.split("[")[0] != "local" and not context._jsc.sc().getCheckpointDir().isDefined():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factweave-checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now and read it from there afterwards."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder now and read it from there; for large tables, since it is compressed."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def released(df: DataFrame) -> DataFrame:
    """``df``, written; and now Spark may drop the shuffle files and checkpoints of what led to it.

    It drops them when the driver collects garbage, which a job of many rounds should not leave to chance.
    """
    out = cut(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file."""
    fs, at = _at(spark, path)
    fs.create(at, True).close()
