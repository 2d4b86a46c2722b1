"""Replacing a folder such that the old one stays until the new one is whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def _beside(spark: SparkSession, at, word: str):
    """A path next to ``at`` that readers of the parent pass over."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{at.getName()}.{word}")


def restore(spark: SparkSession, path: str) -> None:
    """Put back what an application that died between two renames had set aside.

    Nothing is done while there is something at ``path``.
    """
    fs, at = folder(spark, path)
    if fs.exists(at):
        return
    found = [f.getPath() for f in fs.globStatus(_beside(spark, at, "old-*")) or []]
    if len(found) > 1:
        raise ValueError(f"{path} is missing and has several earlier versions: {found}")
    for old in found:
        fs.rename(old, at)


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` make a folder that takes the place of ``path``.

    It writes next to the old folder, which is renamed away and deleted only when the new one is
    whole, so a write that fails leaves the old one, and may read it while it writes. Two renames
    are two steps: an application that dies between them leaves the old folder to :func:`restore`.
    Where nothing is replaced, ``write`` gets ``path`` itself.
    """
    restore(spark, path)
    fs, at = folder(spark, path)
    if not fs.exists(at):
        write(path)
        return
    name = uuid.uuid4().hex
    new, old = _beside(spark, at, f"new-{name}"), _beside(spark, at, f"old-{name}")
    try:
        write(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    if not fs.rename(at, old):
        fs.delete(new, True)
        raise OSError(f"cannot rename {path}")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"cannot rename {new.toString()} to {path}")
    fs.delete(old, True)
