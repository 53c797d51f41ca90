"""Checkpoints and small files in the cluster's shared folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that lets a checkpoint go when no plan refers to it any more.
CHECKPOINT_CLEANUP = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only in local mode, and only where it is unset, a temporary one."""
    context = spark.sparkContext._jsc.sc()
    context.conf().set(CHECKPOINT_CLEANUP, "true")
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def write_file(spark: SparkSession, path: str, text: str) -> str:
    """A small text file at a path of any file system that Spark knows; folders are made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path
