"""Mixing sources to target weights by Sainte-Laguë apportionment.

Tokens are words.  The mix is laid out in blocks of equally many tokens.

1. Targets.  Sources in code-point order (null last) weigh 5, 2, 1, 5, ...;
   they share ``ratio`` times all tokens, and a target stops at ``most`` times
   its source, the excess going to the others by weight.  Sorting sources by
   the level at which each fills up gives the end of that resharing at once:
   the full ones are a prefix of the order.
2. Quotas.  A source that is not full gets whole blocks by the Sainte-Laguë
   method, the highest quotients w / (2k + 1); inside a source its shards get
   theirs the same way, by their tokens.  No divisor is searched and no
   quotient sequence is listed in full: a party's seats differ from its exact
   share p of N by at most p * parties / 2 + 1/2, so seats below that are
   given at once and only about four quotients a party are ranked.
3. Selection.  A shard's documents, in seeded order, form a ring of tokens cut
   in blocks from a seeded place on; the quota takes consecutive blocks of the
   ring, whole turns first.  A document's share is the overlap of its interval
   with what was taken: arithmetic, with no row for each block.

A shard is a seeded part of one source of about ``shard_docs`` documents (at
most ``max_shards`` parts, bigger ones beyond), so a source that holds a third
of all rows is spread over many tasks.  Everything is DataFrame functions.

Only the table of sources, whose size the number of named sources bounds, is
ever in one task; the windows over it are marked.  Edge cases: null text has
size 0; a null source is a source; documents of size 0 take 0; an empty table
gives an empty result; rows repeated under one id are separate documents of one
shard; rows without an id are dealt by their texts; texts of any length count
whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import WORD, cut

#: A table of sources up to this many rows is sent to all executors.
BROADCAST_SOURCES = 50_000


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def number(digest: Column) -> Column:
    """28 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ratio: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Adds rank, w, total, full, rest (den times the tokens of the others), target."""
    num, den = ratio
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1).cast("long"))
    cap = F.col("source_size") * most
    level = Window.partitionBy(F.lit(0)).orderBy((cap / F.col("w")).asc(), "rank")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    laid = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("cap_before"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    # full: cap / w <= what is left / weights left, in whole numbers
    full = den * cap * F.col("w_left") <= (num * F.col("total") - den * F.col("cap_before")) * F.col("w")
    marked = laid.withColumn("full", full)
    rest = num * F.col("total") - den * F.sum(F.when(F.col("full"), cap).otherwise(0)).over(everything)
    w_rest = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), cap.cast("double")).otherwise((F.col("w") * F.col("rest")).cast("double") / (float(den) * F.col("w_rest").cast("double")))
    done = marked.withColumn("rest", rest).withColumn("w_rest", w_rest)
    return done.withColumn("target", target).drop("cap_before", "w_left", "w_rest")


def apportion(parties: DataFrame, group: list[str], party: str, weight: str, seats: str, alias: str) -> DataFrame:
    """Sainte-Laguë seats of each party in its group; ties go to the smaller ``party``.

    ``weight`` is positive; ``seats`` is the group's number of seats.  The
    result has group, party and ``alias``.
    """
    whole = Window.partitionBy(*group)
    w, n = F.col(weight).cast("double"), F.col(seats).cast("double")
    shares = parties.select(*group, party, w.alias("_w"), F.col(seats).alias("_seats"), (w / F.sum(w).over(whole)).alias("_p"), F.count(F.lit(1)).over(whole).alias("_n"), n.alias("_s"))
    slack = F.col("_p") * F.col("_n") / 2 + 1
    low = F.greatest(F.lit(0).cast("long"), F.floor(F.col("_p") * F.col("_s") - slack).cast("long"))
    high = F.floor(F.col("_p") * F.col("_s") + slack).cast("long") + 1
    sure = shares.withColumn("_low", low).withColumn("_high", high).withColumn("_left", F.col("_seats") - F.sum("_low").over(whole))
    quotients = sure.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high"))))
    best = Window.partitionBy(*group).orderBy((F.col("_w") / (2 * F.col("_k") + 1)).desc(), party)
    ranked = quotients.withColumn("_won", (F.row_number().over(best) <= F.col("_left")).cast("long"))
    return ranked.groupBy(*group, party).agg((F.max("_low") + F.sum("_won")).alias(alias))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), ratio: tuple[int, int] = (3, 2), most: int = 2, seed: int = 7, blocks: int = 1 << 24, shard_docs: int = 256, max_shards: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each document.

    ``blocks``: a block has total // blocks tokens, at least one, so a source's
    error of half a block is the same part of the mix at every size.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-:"), F.xxhash64(text_col).cast("string")))  # rows without an id spread by their texts
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), own.alias("own")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    laid = targets(per_source, weights, ratio, most)
    block = F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / blocks).cast("long"))
    n_shards = F.least(F.lit(max_shards), F.ceil(F.col("n_docs") / shard_docs)).cast("long")
    sources = cut(laid.withColumn("block", block).withColumn("n_shards", n_shards).withColumn("seats", F.floor(F.col("rest") / (ratio[1] * F.col("block")) + 0.5).cast("long")))
    quotas = apportion(sources.filter(~F.col("full")).withColumn("_all", F.lit(0)), ["_all"], "rank", "w", "seats", "quota").select("rank", "quota")
    sources = cut(sources.join(quotas, "rank", "left"))
    small = sources.count() <= BROADCAST_SOURCES
    side = F.broadcast(sources) if small else sources

    placed = sized.withColumnRenamed("source", "_source").join(side, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    key = seeded(seed, F.col("own"))
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "rank", "block", "full", "quota", key.alias("key"), (number(key) % F.col("n_shards")).alias("shard"))

    shards = placed.filter(~F.col("full") & (F.col("size") > 0)).groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.max("quota").alias("quota"))
    shard_quotas = apportion(shards, ["rank"], "shard", "shard_size", "quota", "blocks")

    ring = Window.partitionBy("rank", "shard")
    running = ring.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("end", F.sum("size").over(running)).withColumn("shard_size", F.sum("size").over(ring))
    lined = lined.join(shard_quotas, ["rank", "shard"], "left").fillna(0, ["blocks"])
    turn = F.greatest(F.col("shard_size"), F.lit(1).cast("long"))
    wanted = F.least(F.col("blocks") * F.col("block"), most * F.col("shard_size"))
    start_block = number(seeded(seed, F.lit("start"), F.col("rank"), F.col("shard"))) % F.ceil(turn / F.col("block")).cast("long")
    lined = lined.select("*", (F.col("end") - F.col("size")).alias("begin"), F.floor(wanted / turn).cast("long").alias("turns"), (wanted % turn).alias("rest"), (start_block * F.col("block")).alias("from"), turn.alias("turn"))
    zero = F.lit(0).cast("long")
    stop = F.col("from") + F.col("rest")
    first = F.greatest(zero, F.least(F.col("end"), stop) - F.greatest(F.col("begin"), F.col("from")))
    wrapped = F.greatest(zero, F.least(F.col("end"), stop - F.col("turn")) - F.col("begin"))
    taken = F.when(F.col("full"), most * F.col("size")).otherwise(F.col("turns") * F.col("size") + first + wrapped)
    return lined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
