"""Session helpers: where intermediate tables may live."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; fall back to a temporary folder
    only where none is configured and the master is a single local JVM (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "wayfare-checkpoints")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clear_checkpoints(spark: SparkSession) -> None:
    """Remove what this application has written to the checkpoint folder. Frames that go on from there must not be read
    afterwards. Sessions with ``spark.cleaner.referenceTracking.cleanCheckpoints`` remove them by themselves in time."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
