"""Replacing a folder of results without a moment in which a part of them is all there is."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class _Folder:
    """A folder on whatever file system its path names, and the folders that stand in for it meanwhile."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.path = self._path(path.rstrip("/"))
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def beside(self, mark: str):
        """A new path in the same folder, with a name that Spark's readers skip."""
        return self._path(self.path.getParent(), f"_{self.path.getName()}.{mark}-{uuid.uuid4().hex}")

    def kept(self) -> list:
        """What earlier replacements set aside and did not remove."""
        parent = self.path.getParent()
        if not self.files.exists(parent):
            return []
        begin = f"_{self.path.getName()}.old-"
        return [s.getPath() for s in self.files.listStatus(parent) if s.getPath().getName().startswith(begin)]

    def move(self, source, target) -> None:
        if not self.files.rename(source, target):
            raise OSError(f"could not rename {source.toString()} to {target.toString()}")


def recover(spark: SparkSession, path: str) -> bool:
    """Brings back what a replacement had set aside when it was lost between its two renames; True if there was such."""
    folder = _Folder(spark, path)
    aside = folder.kept()
    if not aside or folder.files.exists(folder.path):
        return False
    folder.move(aside[0], folder.path)
    return True


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Has ``write`` fill a new folder beside path, then puts it in the place of path.

    A write that fails leaves path as it was. The old folder goes last. A driver lost between the two renames leaves
    the old results aside, complete: the next call, or ``recover``, brings them back. In an object store a rename
    copies, so there a lost driver can leave a copy begun; the folder it was copied from is still whole.
    """
    recover(spark, path)
    folder = _Folder(spark, path)
    new, old = folder.beside("new"), folder.beside("old")
    try:
        write(new.toString())
        if folder.files.exists(folder.path):
            folder.move(folder.path, old)
        try:
            folder.move(new, folder.path)
        except Exception:
            if folder.files.exists(old):
                folder.move(old, folder.path)
            raise
    except Exception:
        folder.files.delete(new, True)
        raise
    for aside in folder.kept():
        folder.files.delete(aside, True)
