"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that the session names in ``spark.checkpoint.dir``; it goes when the application ends.

    Where that is unset, a temporary one is made on a single machine; a cluster has to name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        on_path(spark, sc.getCheckpointDir(), lambda fs, p: fs.deleteOnExit(p))
    return sc.getCheckpointDir()


def on_path(spark: SparkSession, path: str, f: Callable):
    """``f`` of the path's file system and the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return f(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)
