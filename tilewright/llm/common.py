"""Session helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as the contracts name them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests in one process) a temporary folder of this machine stands in.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tilewright-"))
        return context.getCheckpointDir().rstrip("/")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root; no two calls get the same, and it goes when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, path)
    return path


def discard(folder: str) -> None:
    """Removes a folder if it is there and its file system can be reached."""
    with contextlib.suppress(OSError, pa.ArrowInvalid):
        system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.delete_dir(path)


#: Rows that a file of a table of known size has at least.
FILE_ROWS = 20_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once into a table in the shared folder and read from there, its lineage cut.

    All executors share the folder, so a lost executor costs nothing.  A table of
    columns is read with less memory and time than a checkpoint's rows are.
    rows: an upper bound of the table's rows, where one is known; it saves tables of
    few rows from being many files, and leaves tables of many rows as they are dealt.
    """
    path = scratch(df.sparkSession, "cut")
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seeded_sample(rows: DataFrame, group: str, order: list[str], n: int, seed: int) -> DataFrame:
    """The ``n`` first rows of each group in the order of a seeded hash of ``order``; ties by ``order``.

    A count of each group gives the part of the hashes that holds that many but
    for a chance under 1e-15, so little more than ``n`` rows of a group are
    ranked, however large it is.  Groups are few, as labels are.  Fewer than ``n``
    rows: all.
    """
    key = F.xxhash64(*order, F.lit(seed))
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    known = rows.withColumn("_key", key).join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")  # a row for each label
    part = (F.col("_key").cast("double") / 2.0**64 + 0.5) * F.col("_size") <= n + 8 * n**0.5 + 64
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_key", *order))
    return known.filter(part).withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_key", "_size", "_rank")


BITMAP_DEPTH = 20


def _place(h: Column) -> tuple[Column, Column]:
    """Word and bit of a 64-bit hash in a bitmap."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.shiftrightunsigned(h, 64 - BITMAP_DEPTH), bit


def bitmap(keys: DataFrame, h: str) -> DataFrame:
    """place, mask: a bitmap of 2^26 places, 2^BITMAP_DEPTH rows at most, with the hashes of column ``h``.

    Written to the shared folder; several hashes may share a place, so it tells
    for sure only which hashes are absent.
    """
    place, bit = _place(F.col(h))
    words = keys.select(place.alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("mask"))
    return cut(words, 1 << 18)


def marked(rows: DataFrame, h: Column, places: DataFrame, yes: bool = True) -> DataFrame:
    """The rows whose hash is at a marked place (``yes``), or at none."""
    place, bit = _place(h)
    told = rows.withColumn("_place", place).withColumn("_bit", bit)
    small = F.broadcast(places.select(F.col("place").alias("_place"), "mask"))  # 2^BITMAP_DEPTH rows at most
    found = told.join(small, "_place", "inner" if yes else "left")
    is_set = F.col("mask").bitwiseAND(F.col("_bit")) != 0
    return found.filter(is_set if yes else F.col("mask").isNull() | ~is_set).select(*rows.columns)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(doc_id: str, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``: the folds of the contracts; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(by), F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
