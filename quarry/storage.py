"""The folder that driver and executors share: where it is, tables in it, and their removal."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_checkpoints: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which also takes checkpoints.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session without that setting gets
    a folder of its own; a cluster without it is a configuration error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
        _checkpoints.append((spark, sc.getCheckpointDir()))
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A folder for a table of this session; it is removed when the process ends, if not before, unless it is to keep."""
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    if not keep:
        _made.append((spark, path))
    return path


def file_system(path: str):
    """The file system of a path in the shared storage, for Python tasks, and the path within it."""
    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(url.path)
    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def freed(spark: SparkSession):
    """The shuffles of each job that is begun within go when it ends; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, any executor may be lost; ``free``: see ``freed``."""
    path = new_folder(df.sparkSession, name)
    with freed(df.sparkSession) if free else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The number of folders so far, for ``drop``."""
    return len(_made)


def last() -> str:
    """The folder made last."""
    return _made[-1][1]


def drop(since: int = 0, keep: str | None = None) -> None:
    """Removes the folders made after a mark, but that of a table to keep."""
    gone = [x for x in _made[since:] if x[1] != keep]
    _made[since:] = [x for x in _made[since:] if x[1] == keep]
    for spark, path in gone:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit() -> None:
    for spark, path in _made + _checkpoints:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session, and its temporary folder, may be gone
            return


atexit.register(_at_exit)
