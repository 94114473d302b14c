"""Small files and staged tables on any Hadoop file system."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class Taken(FileExistsError):
    """A file that must not be replaced is there already."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; None if there is none."""
    fs, at = file_system(spark, path), _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A file that appears whole or not at all: written beside its place, then moved there by one rename.

    With ``replace`` an older file gives way in the same step; without it Taken is raised if
    there is one, so of several writers one succeeds.
    """
    sc = spark.sparkContext
    fs, part, at = file_system(spark, path), _path(spark, f"{path}.{uuid.uuid4().hex}.part"), _path(spark, path)
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    out = fs.create(part, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    try:
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(at), how)
    except Exception as e:
        fs.delete(part, False)
        if not replace and "FileAlreadyExists" in str(e):
            raise Taken(path) from None
        raise


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where a local session names none."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "quillgraph-staged")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """The path goes when the driver's JVM ends, whether it exists by now or not."""
    file_system(spark, path).deleteOnExit(_path(spark, path))


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    return file_system(spark, path).getContentSummary(_path(spark, path)).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    file_system(spark, path).delete(_path(spark, path), True)


#: Paths that staged() wrote within the innermost staging() block.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables that staged() writes in this block go with its end: for work whose results are on the driver by then."""
    token = _written.set([])
    try:
        yield
    finally:
        for path in _written.get():
            remove(spark, path)
        _written.reset(token)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, for several uses; it goes with the staging() block around it, else when the driver's JVM ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if (within := _written.get()) is not None:
        within.append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that staged() wrote, once everything made from them is there."""
    for df in tables:
        file_system(df.sparkSession, df._staged_at).delete(_path(df.sparkSession, df._staged_at), True)
