"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: One write at a time changes the setting above, which holds for a whole session.
_ALONE = threading.RLock()
#: What this process wrote to the shared folder and did not remove yet.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local run gets a temporary one and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def _own_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions within remove their shuffle files as they end. The setting is the session's: writes of several threads take turns, and other
    actions of that session should not run beside them."""
    with _ALONE:
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut: a lost executor costs a reread.

    Partitioning is kept. The shuffle files behind ``df`` are of no more use and are removed as the write ends.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    with _own_shuffles_removed(spark):
        out = df.select("*").checkpoint()  # a frame of its own: nobody else runs this plan
    file = _checkpoint_file(out)
    if file:
        _WRITTEN.append(file)
    return out


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder below the shared one; ``release_all`` removes it."""
    at = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append(at)
    return at


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to a new folder by columns: wide rows take less room so than in a checkpoint. Shuffle files go as with ``saved``."""
    at = new_folder(df.sparkSession, kind)
    with _own_shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _checkpoint_file(df: DataFrame) -> str | None:
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def release(df: DataFrame) -> None:
    """Remove what ``saved`` wrote for ``df``, which must not be read any more."""
    file = _checkpoint_file(df)
    if file:
        remove(df.sparkSession, file)


def release_all(spark: SparkSession) -> int:
    """Remove all that this process wrote to the shared folder; how many files and folders. No frame that was made before may be read any more: call it
    when results are written or collected."""
    paths = list(_WRITTEN)
    for path in paths:
        remove(spark, path)
    return len(paths)
