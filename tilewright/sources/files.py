"""Files by path or URI, through pyarrow's file systems: the driver and every task reach them alike."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs), and the path on it."""
    if path.startswith("file:") or "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def reader(path: str):
    """A file to read, with seek and read_at."""
    system, name = located(path)
    return system.open_input_file(name)


def writer(path: str):
    """A file to write; folders above it are made."""
    system, name = located(path)
    system.create_dir(name.rpartition("/")[0] or ".", recursive=True)
    return system.open_output_stream(name, compression=None)


def remove(folder: str) -> None:
    system, name = located(folder)
    system.delete_dir(name)


def delete(path: str) -> None:
    system, name = located(path)
    system.delete_file(name)


def move(old: str, new: str) -> None:
    system, name = located(old)
    system.move(name, located(new)[1])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that driver and executors share; it goes when the driver ends.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, as in
    tests in one process, Spark's own local folder stands in.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.sparkContext._jvm.System.getProperty("java.io.tmpdir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, path)
    return path


def discard(folder: str) -> None:
    """Removes a folder if it is there and its file system can be reached."""
    with contextlib.suppress(OSError, pa.ArrowInvalid):
        remove(folder)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` computed once into a table in the shared folder, and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what stands as Python objects at once doesn't grow with the batches that Spark makes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
