"""Intermediate tables, in the shared folder that the cluster names.

Steps that are read more than once, or whose lineage is too costly to repeat when an
executor is lost, are written to ``spark.checkpoint.dir`` and read back.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set and Spark runs locally."""
    sc = spark.sparkContext
    root = spark.conf.get(SETTING, None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
        own = tempfile.mkdtemp(prefix="wordwood-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/wordwood-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nobody else writes to."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one scratch table, or a folder of them, once nothing reads it any more."""
    if not path.startswith(f"{_own_folder(spark)}/"):
        raise ValueError(f"{path} is not in the scratch folder of this application")
    _delete(spark, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote, once nothing reads it any more."""
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
