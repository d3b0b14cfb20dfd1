"""Tiles to archive: merging, deduplication, runs, offsets and directories.

Order along the Hilbert curve is handled in buckets of the tile id, so no window
sees the whole table: only one row for each bucket is put in one task, and the
tile ids of all zooms have at most 2^17 buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.sources import files

BUCKET = 4096


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(key) / BUCKET))


def running(df: DataFrame, key: str, value: Column, alias: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in key order."""
    b = _bucketed(df, key).withColumn("_v", value)
    sums = b.groupBy("_b").agg(F.sum("_v").alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_s")).alias("_before"))
    w = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return b.join(before, "_b").withColumn(alias, F.col("_before") + F.sum("_v").over(w)).drop("_b", "_v", "_before")


def previous(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Adds prev_<field> of the row before in key order."""
    b = _bucketed(df, key)
    row = F.struct(*fields)
    last = b.groupBy("_b").agg(F.max_by(row, F.col(key)).alias("_last"))
    carried = last.select("_b", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_b")).alias("_carried"))
    w = Window.partitionBy("_b").orderBy(key)
    joined = b.join(carried, "_b").withColumn("_p", F.coalesce(F.lag(row).over(w), F.col("_carried")))
    return joined.withColumns({f"prev_{f}": F.col("_p")[f] for f in fields}).drop("_b", "_p", "_carried")


def same_attr_merge(features: DataFrame, keys: list[str], order: list[str], geometry: str, id_col: str, slot: Column | None = None) -> DataFrame:
    """Features of a tile and layer with equal attributes as one, at the first one's slot.

    A merged feature has no id; a single one keeps its own.  slot: what is least at
    the first slot, the order's columns if none is given.
    """
    row = F.struct(*order, geometry)
    got = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order) if slot is None else slot).alias("slot"), F.transform(F.array_sort(F.collect_list(row)), lambda r: r[geometry]).alias("parts"), F.max(id_col).alias("_id"))
    return got.withColumn(id_col, F.when(F.col("n") == 1, F.col("_id"))).drop("_id")


def payload_dedup(tiles: DataFrame) -> DataFrame:
    """digest, first_id, length, uses: each different payload once, owned by its first tile."""
    return tiles.groupBy(F.sha2(F.col("payload").cast("binary"), 256).alias("digest")).agg(F.min("tile_id").alias("first_id"), F.max(F.octet_length("payload")).cast("bigint").alias("length"), F.count(F.lit(1)).alias("uses"))


def blob_offsets(blobs: DataFrame) -> DataFrame:
    """Adds each payload's offset: the lengths of those used before it."""
    return running(blobs, "first_id", F.col("length"), "_end").withColumn("offset", F.col("_end") - F.col("length")).drop("_end")


def tile_runs(tiles: DataFrame) -> DataFrame:
    """start_id, run_length, digest: following tile ids that share a payload.

    Runs are made inside each bucket of the tile id first, from one reading of the
    tiles; then the first run of a bucket joins the last of the one before where
    they touch and agree.  A payload with a third of all tiles (open sea) is no
    key of any shuffle.
    """
    w = Window.partitionBy("_b").orderBy("tile_id")
    marked = _bucketed(tiles.select("tile_id", F.sha2(F.col("payload").cast("binary"), 256).alias("digest")), "tile_id")
    begins = ~F.coalesce((F.lag("tile_id").over(w) == F.col("tile_id") - 1) & (F.lag("digest").over(w) == F.col("digest")), F.lit(False))
    island = F.max(F.when(begins, F.col("tile_id"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = marked.withColumn("start_id", island).groupBy("_b", "start_id").agg(F.count(F.lit(1)).alias("run_length"), F.max("digest").alias("digest"))
    parts = files.kept(parts, "runs")
    last = F.max_by(F.struct("start_id", (F.col("start_id") + F.col("run_length")).alias("end"), "digest"), "start_id").alias("last")
    ends = parts.groupBy("_b").agg(F.min_by(F.struct("start_id", "digest"), "start_id").alias("first"), last)
    order = Window.partitionBy(F.lit(0)).orderBy("_b")  # a row for each bucket, 2^17 at most
    before = F.lag("last").over(order)
    ends = ends.withColumn("goes_on", F.coalesce((before["end"] == F.col("first.start_id")) & (before["digest"] == F.col("first.digest")), F.lit(False)))
    # where the run that a bucket ends with began: not in this bucket if it is its only one and goes on
    own = F.when(~(F.col("goes_on") & (F.col("first.start_id") == F.col("last.start_id"))), F.col("last.start_id"))
    ends = ends.withColumn("began", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    joined = parts.join(ends.select("_b", F.col("first.start_id").alias("first_start"), "goes_on", "began"), "_b")
    start = F.when(F.col("goes_on") & (F.col("start_id") == F.col("first_start")), F.col("began")).otherwise(F.col("start_id"))
    return joined.groupBy(start.alias("start_id")).agg(F.sum("run_length").alias("run_length"), F.max("digest").alias("digest"))


def directory_columns(runs: DataFrame) -> DataFrame:
    """start_id, id_delta, run_length, length, offset_code of the directory's columns.

    offset_code: 0 right behind the run before, else offset + 1.
    """
    seen = previous(runs, "start_id", ["start_id", "offset", "length"])
    behind = F.coalesce(F.col("offset") == F.col("prev_offset") + F.col("prev_length"), F.lit(False))
    return seen.select("start_id", (F.col("start_id") - F.coalesce("prev_start_id", F.lit(0))).alias("id_delta"), "run_length", "length", F.when(behind, 0).otherwise(F.col("offset") + 1).alias("offset_code"))


def spread(runs: DataFrame, start: str = "start_id", length: str = "run_length") -> DataFrame:
    """A row for each bucket that a run touches: ranges then meet by an equality."""
    return runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor((F.col(start) + F.col(length) - 1) / BUCKET))))


def run_lookup(ids: DataFrame, runs: DataFrame, key: str = "tile_id") -> DataFrame:
    """Each id with the run that covers it, if any."""
    cover = spread(runs).withColumnRenamed("_b", "_rb")
    at = F.floor(F.col(key) / BUCKET)
    return ids.join(cover, (at == F.col("_rb")) & (F.col(key) >= F.col("start_id")) & (F.col(key) < F.col("start_id") + F.col("run_length")), "left").drop("_rb")


def run_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """start_id, run_length, a, b: the common parts of two run tables."""
    x = spread(a).select("_b", F.col("start_id").alias("s1"), (F.col("start_id") + F.col("run_length")).alias("e1"), F.col("digest").alias("a"))
    y = spread(b).select(F.col("_b").alias("_c"), F.col("start_id").alias("s2"), (F.col("start_id") + F.col("run_length")).alias("e2"), F.col("digest").alias("b"))
    low, high = F.greatest("s1", "s2"), F.least("e1", "e2")
    met = x.join(y, (F.col("_b") == F.col("_c")) & (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")))
    return met.filter(F.floor(low / BUCKET) == F.col("_b")).select(low.alias("start_id"), (high - low).alias("run_length"), "a", "b")


def directory_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Maximal spans of tile ids over which both archives are constant: a full outer interval join."""
    a, b = files.kept(a, "runs"), files.kept(b, "runs")
    ends = F.explode(F.array(F.col("start_id"), F.col("start_id") + F.col("run_length"))).alias("at")
    cuts = files.kept(a.select(ends).union(b.select(ends)).distinct(), "cuts")
    back = previous(cuts.withColumn("key", -F.col("at")), "key", ["at"])  # the next cut is the one before in falling order
    spans = back.filter("prev_at IS NOT NULL").select(F.col("at").alias("span_start"), (F.col("prev_at") - F.col("at")).alias("span_length"))
    left = run_lookup(spans, a, "span_start").select("span_start", "span_length", F.col("digest").alias("a"))
    both = run_lookup(left, b, "span_start").select("span_start", "span_length", "a", F.col("digest").alias("b"))
    return both.filter("a IS NOT NULL OR b IS NOT NULL")


def hot_splits(buckets: DataFrame, target: int = 64 << 20, most: int = 32) -> DataFrame:
    """bucket, sub, piece: pieces of sort buckets that are over twice the target, by quantiles of their bytes.

    buckets: bucket, sub (its at most 4,096 parts in order), bytes.  A bucket gets
    2 to ``most`` pieces of about ``target`` bytes; others are one piece.
    """
    w = Window.partitionBy("bucket")
    told = buckets.withColumn("total", F.sum("bytes").over(w)).withColumn("before", F.sum("bytes").over(w.orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes"))
    pieces = F.when(F.col("total") > 2 * target, F.greatest(F.lit(2), F.least(F.lit(most), F.ceil(F.col("total") / target)))).otherwise(F.lit(1))
    return told.select("bucket", "sub", F.floor(F.col("before") * pieces / F.col("total")).cast("int").alias("piece"), pieces.cast("int").alias("pieces"))


def digests(features: DataFrame, tile: str, text: Column) -> DataFrame:
    """tile, n, digest: a multiset hash, equal however the features are ordered."""
    hashed = features.select(tile, F.md5(text.cast("binary")).alias("h"))
    return hashed.groupBy(tile).agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary")).alias("digest"))


def fold(tiles: DataFrame, tile: str, size: int = 64) -> DataFrame:
    """bucket, tiles, uniques, digest: the digests of a range of tiles in one."""
    pair = F.concat_ws(":", F.col(tile).cast("string"), F.col("digest"))
    rows = tiles.withColumn("bucket", F.floor(F.col(tile) / size))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("tiles"), F.count_distinct("digest").alias("uniques"), F.md5(F.array_join(F.array_sort(F.collect_list(pair)), ",").cast("binary")).alias("digest"))


def staged_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """tile_id, outcome: added, removed, raw_equal, canonical_equal or changed.

    a, b: tile_id, raw, canonical.  Only what an earlier stage leaves open is
    compared further.
    """
    both = a.alias("a").join(b.alias("b"), F.col("a.tile_id") == F.col("b.tile_id"), "full")
    outcome = F.when(F.col("a.tile_id").isNull(), "added").when(F.col("b.tile_id").isNull(), "removed").when(F.col("a.raw") == F.col("b.raw"), "raw_equal").when(F.col("a.canonical") == F.col("b.canonical"), "canonical_equal").otherwise("changed")
    return both.select(F.coalesce("a.tile_id", "b.tile_id").alias("tile_id"), outcome.alias("outcome"))
