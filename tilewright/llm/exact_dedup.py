"""Exact deduplication through an extendible-hash index on shared files.

The index maps the 64-bit hash of a normalised text to the entry that stays.
Its directory has 2^G slots, addressed by the first G bits of a hash; several
slots may lead to one bucket, and a bucket is a range of hashes.  A bucket over
its capacity is split on its next bit, and when it already uses all G bits the
directory is doubled first.

Work is shared out as follows:

* ``keys`` are read from the texts once: (id, hash, SHA-256, bytes, rows);
* the loads of the finest slots let the driver grow the directory without
  seeing a single key.  The finest depth follows the load; from 2^MAX_DEPTH
  slots on (8 TB of entries) the capacity of a bucket grows instead;
* a hash that one row alone has needs no comparison: its entry is its key.
  A bitmap of 2^26 places, at most 2^20 rows, marks the hashes that
  repeat; only texts at marked places travel.  A place that several hashes
  share sends some texts in vain and never leaves one out;
* readers combine equal texts of their own split, so that a text with a
  billion copies reaches its owner as one row for each reader;
* owner tasks take ranges of whole buckets in hash order, chain the texts of
  one hash and compare their bytes, so a collision of hashes never merges two
  texts;
* the index is written to the shared folder, and documents find their entry
  in it by bucket, hash and SHA-256, a join whose hot keys Spark's skew
  handling splits.

Edge cases: null text equals the empty text; a null id stays only where no other
row has the text; of equal rows repeated under one id one is kept and all are
counted; rows of different texts under one id are decided on one by one; texts
of any length are whole; an empty table gives an empty result; further columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import SPACE, bitmap, marked, scratch, text_or_empty

#: A reader's memory for the texts it combines, and the slices it reads them in.
COMBINE_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
#: The directory has at most 2^MAX_DEPTH slots; ENTRY_BYTES is the load of an index entry.
MAX_DEPTH, ENTRY_BYTES = 20, 128
ENTRY = "owner int, h long, sha string, text string, keep_id long, n long"
INDEX = "h long, chain int, sha string, keep_id long, group_size long"


def normalised(column: str = "text"):
    return F.regexp_replace(text_or_empty(column), SPACE, " ")


def grow_directory(loads: dict[int, int], max_depth: int, capacity: int) -> tuple[int, list[int]]:
    """Global depth and, for each slot, its bucket, after all splits.

    loads: bytes by slot of the finest directory.  A bucket that is still too
    large at ``max_depth`` keeps an overflow chain: its owner streams it.
    """
    sums = [0] * (1 << max_depth)
    for slot, load in loads.items():
        sums[slot] += load
    levels = [sums]  # levels[d]: loads of the 2^(max_depth-d) prefixes
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([last[i] + last[i + 1] for i in range(0, len(last), 2)])
    depth, directory, used = 0, [0], 1
    pending = [(0, 0, 0)]  # local depth, prefix, bucket
    while pending:
        local, prefix, bucket = pending.pop()
        if local == max_depth or levels[max_depth - local][prefix] <= capacity:
            continue
        if local == depth:
            directory = [b for b in directory for _ in (0, 1)]
            depth += 1
        span = 1 << (depth - local - 1)
        start = (2 * prefix + 1) * span
        directory[start : start + span] = [used] * span
        pending += [(local + 1, 2 * prefix, bucket), (local + 1, 2 * prefix + 1, used)]
        used += 1
    return depth, directory


def smaller(a: int | None, b: int | None) -> int | None:
    """The smaller id; null comes last."""
    return b if a is None else a if b is None else min(a, b)


def sliced(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``most`` bytes, one row at least."""
    rows = max(1, batch.num_rows * most // max(1, batch.column(column).nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of one split as one row; what is held stays near COMBINE_BYTES."""
    held: dict[tuple[int, str], list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(owner, h, sha, text, keep, n) for (h, text), (owner, sha, keep, n) in held.items()]
        held.clear()
        return _batch(rows, ENTRY)

    for batch in batches:
        for part in sliced(batch, 3):
            for owner, h, sha, text, keep, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                entry = held.get((h, text))
                if entry is None:
                    held[h, text] = [owner, sha, keep, n]
                    size += len(text.encode()) + 300
                else:
                    entry[2] = smaller(entry[2], keep)
                    entry[3] += n
            if size > COMBINE_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of the key range a task owns; its rows come in the order of h.

    At any time only the different texts of one hash are held.
    """
    at: int | None = None
    entries: list[list] = []  # sha, text, keep, n
    out: list[tuple] = []

    def close() -> None:
        out.extend((at, k, sha, keep, n) for k, (sha, _, keep, n) in enumerate(entries))

    for batch in batches:
        for part in sliced(batch, 3):
            for _, h, sha, text, keep, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if at != h:
                    if at is not None:
                        close()
                    at, entries = h, []
                for entry in entries:
                    if entry[1] == text:  # the bytes decide, not the hash
                        entry[2] = smaller(entry[2], keep)
                        entry[3] += n
                        break
                else:
                    entries.append([sha, text, keep, n])
            if len(out) >= 10_000:
                yield _batch(out, INDEX)
                out.clear()
    if at is not None:
        close()
    if out:
        yield _batch(out, INDEX)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def slot_of(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, index, directory), all read back from the shared folder.

    keys: doc_id, h, sha, bytes, n (equal rows under one id); index: h, chain, sha,
    keep_id, group_size; directory: slot, bucket, owner.
    """
    spark: SparkSession = docs.sparkSession
    root = scratch(spark, "exact-index")
    text = normalised(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    with_hash = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    told = with_hash.select("doc_id", "h", "sha", F.octet_length("text").alias("bytes"))
    told.groupBy("doc_id", "h", "sha").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/keys")
    keys = spark.read.parquet(f"{root}/keys")
    by_hash = keys.groupBy("h").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes"), F.min("doc_id").alias("keep_id"), F.min("sha").alias("sha"))
    by_hash.write.parquet(f"{root}/hashes")
    hashes = spark.read.parquet(f"{root}/hashes")

    # an entry, and the text of a hash that has to be compared
    load = F.lit(ENTRY_BYTES).cast("long") + F.when(F.col("n") > 1, F.col("bytes")).otherwise(0)
    total = hashes.agg(F.sum(load)).first()[0] or 0
    finest = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total / bucket_bytes)))) + 3)
    loads = hashes.groupBy(slot_of(finest).alias("slot")).agg(F.sum(load).alias("load"))
    capacity = max(bucket_bytes, total >> (MAX_DEPTH - 3))
    depth, slots = grow_directory({r["slot"]: r["load"] for r in loads.toLocalIterator()}, finest, capacity)  # at most 2^MAX_DEPTH rows
    ranges = {b: k for k, b in enumerate(dict.fromkeys(slots))}  # buckets in hash order
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = [(slot, b, ranges[b] * owners // len(ranges)) for slot, b in enumerate(slots)]
    spark.createDataFrame(entries, "slot long, bucket int, owner int").coalesce(1).write.parquet(f"{root}/directory")
    directory = spark.read.parquet(f"{root}/directory")

    repeated = bitmap(hashes.filter("n > 1"), "h")
    alone = marked(hashes, F.col("h"), repeated, False).select("h", F.lit(0).alias("chain"), "sha", "keep_id", F.col("n").alias("group_size"))
    addressed = marked(with_hash, F.col("h"), repeated).withColumn("slot", slot_of(depth)).join(F.broadcast(directory), "slot")  # 2^MAX_DEPTH rows at most
    compared = addressed.select("owner", "h", "sha", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")).mapInArrow(combine, ENTRY)
    owned = compared.repartitionById(owners, "owner").sortWithinPartitions("h")
    owned.mapInArrow(chain, INDEX).write.parquet(f"{root}/buckets/several")
    alone.write.parquet(f"{root}/buckets/alone")
    return keys, spark.read.parquet(f"{root}/buckets/several", f"{root}/buckets/alone"), directory


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    ``kept`` is true for one row of each group, of the smallest doc_id.
    """
    keys, index, _ = build_index(docs, id_col=id_col, text_col=text_col, **options)
    found = keys.select("doc_id", "h", "sha", "n").join(index.select("h", "sha", "keep_id", "group_size"), ["h", "sha"])
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
