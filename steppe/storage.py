"""Files and tables that driver and executors share, on any Hadoop file system."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and all runs on one machine, as in
    tests, it is a temporary folder of this process; elsewhere that is an error,
    since each executor would write to a disk of its own. What is written there
    is read by lazy results, so it lives as long as they may be used; whoever
    runs the job clears the folder afterwards.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (known or _own_folder()).rstrip("/")


def _located(spark: SparkSession, path: str):
    """File system and qualified path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files, files.makeQualified(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder, with the scheme of its file system."""
    return _located(spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")[1].toString()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs only the tasks it ran; what is read back lies on
    shared storage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    files, path = _located(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def delete(spark: SparkSession, path: str) -> None:
    files, where = _located(spark, path)
    files.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _located(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(files, path, text: str) -> None:
    stream = files.create(path, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with its whole content, or returns False because it is there.

    The text goes to a hidden name first. On a local disk a hard link gives it
    its own name, elsewhere a rename that may not overwrite; both happen at once
    or not at all (on HDFS; an object store needs a connector whose rename or
    create is conditional).
    """
    files, final = _located(spark, path)
    files.mkdirs(final.getParent())
    hidden = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}-{uuid.uuid4().hex}")
    _write(files, hidden, text)
    try:
        if final.toUri().getScheme() == "file":
            os.link(hidden.toUri().getPath(), final.toUri().getPath())
            return True
        if files.exists(final):
            return False
        return bool(files.rename(hidden, final))
    except FileExistsError:
        return False
    finally:
        with contextlib.suppress(Exception):
            files.delete(hidden, False)


def replace_text(path: str, text: str) -> None:
    """Writes a local file at once: readers see the old content or the new, never a part."""
    hidden = os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path)}-{uuid.uuid4().hex}")
    try:
        with open(hidden, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(hidden, path)
    finally:
        if os.path.exists(hidden):
            os.remove(hidden)
