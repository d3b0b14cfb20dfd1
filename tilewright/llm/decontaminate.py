"""Benchmark decontamination: passages of documents close to a benchmark item.

A document is contaminated by an item when some passage of it is within
``edits`` times the item's words of the item, in word edit distance.

1. Places.  Of an item's n words at most e are edited, so of any e + 1 parts one
   is whole: a window is laid wherever a document holds the seed of a part, its
   rarest words in a row (three at most) among all items.  This loses nothing,
   leaves item-sized windows in few places, and a phrase that many items share
   is no seed where its part has another.
2. Ranges.  The passage is then within e words of the window's place, on either
   side; ranges of one item that touch are searched as one.
3. Exact search: the smallest edit distance of the item to any passage of a range,
   a column of the dynamic programme at a time in the bits of two numbers.  A
   range that shares too few words with the item is passed over before.

No range is left to sampling, so all passages within the bound are found.

Items come to the executors in blocks of at most ``ITEM_BLOCK`` items and about
``WORD_BLOCK`` words, so the memory of a task is bounded however many there are;
documents are never shuffled.

Words are runs of letters and digits, in lower case.  Edge cases: null and empty
texts hold nothing; items of few words have a bound of 0 edits and are found as
exact word sequences, in ordinary prose too (``least`` words are asked for, one
unless told otherwise); items without a word are in no document; items with a
null id are found like others, with a null item_id; equal items each count; of
passages equally near the first is told; texts of any length are read whole;
repeated rows give repeated results; further columns are ignored by ``find`` and
kept by ``clean``, whatever their names; an empty table of either kind gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
ITEM_BLOCK, WORD_BLOCK = 20_000, 1 << 20
#: Multiplier of the seeds' 64-bit codes; equal codes of different seeds only add places to search.
RADIX, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
OUT = "doc_id long, item_id long, start long, distance long, item_words long"
Hit = tuple[int, int, int, int]  # item number, start, distance, words


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def edit_bound(n: int, edits: float) -> int:
    return math.floor(edits * n + 1e-9)


def nearest_end(item: list[int], words: list[int], bound: int) -> tuple[int, int] | None:
    """(distance, end) of the first passage of ``words`` nearest to ``item``, within the bound.

    Myers' bit vectors: bit i of ``more`` (``less``) is set where the distance grows
    (falls) from the item's first i words to its first i + 1.
    """
    at: dict[int, int] = {}
    for i, x in enumerate(item):
        at[x] = at.get(x, 0) | 1 << i
    if sum(map(at.__contains__, words)) < len(item) - bound:
        return None
    every, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    more, less, distance = every, 0, len(item)
    best = (bound + 1, 0)
    for j, x in enumerate(words):
        equal = at.get(x, 0)
        down = equal | less
        across = (((equal & more) + more) ^ more) | equal
        grows = less | ~(across | more) & every
        falls = more & across
        if grows & last:
            distance += 1
        elif falls & last:
            distance -= 1
            if distance < best[0]:
                best = (distance, j + 1)
        grows <<= 1
        more = (falls << 1 | ~(down | grows)) & every
        less = grows & down & every
    return best if best[0] <= bound else None


def best_passage(item: list[int], words: list[int], bound: int) -> tuple[int, int] | None:
    """(distance, start) of the passage of ``words`` nearest to ``item``, within the bound."""
    n, m = len(item), len(words)
    row = [(0, j) for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [(i, 0)]
        for j in range(1, m + 1):
            cost, start = row[j - 1]
            here = (cost + (item[i - 1] != words[j - 1]), start)
            up, left = row[j], new[j - 1]
            if up[0] + 1 < here[0]:
                here = (up[0] + 1, up[1])
            if left[0] + 1 < here[0]:
                here = (left[0] + 1, left[1])
            new.append(here)
        row = new
        if min(c for c, _ in row) > bound:
            return None
    best = min(row)
    return best if best[0] <= bound else None


@dataclass
class Matcher:
    """The items of one block, ready to be looked for."""

    items: list[tuple[int | None, list[str]]]  # item_id, words
    edits: float = 0.2
    vocabulary: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for _, words in self.items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids = [[self.vocabulary[w] for w in words] for _, words in self.items]
        shared: dict[int, Counter] = {}  # by length of the seeds: in how many items
        for ids in self.ids:
            q = self.seed_words(len(ids))
            shared.setdefault(q, Counter()).update({self.code(ids[at : at + q]) for at in range(len(ids) - q + 1)})
        grams: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, ids in enumerate(self.ids):
            n, q = len(ids), self.seed_words(len(ids))
            parts = edit_bound(n, self.edits) + 1
            for part in range(parts):
                low, high = part * n // parts, (part + 1) * n // parts
                code, at = min(((self.code(ids[at : at + q]), at) for at in range(low, high - q + 1)), key=lambda x: (shared[q][x[0]], x[1]))
                grams.setdefault(q, {}).setdefault(code, []).append((k, at))
        self.grams = {q: (np.array(sorted(g), dtype=np.uint64), g) for q, g in grams.items()}

    def seed_words(self, n: int) -> int:
        """Words of the seeds of an item of ``n`` words: three, or its smallest part."""
        return min(3, n // (edit_bound(n, self.edits) + 1))

    def code(self, ids: list[int]) -> int:
        value = 0
        for x in ids:
            value = (value * RADIX + x) & MASK
        return value

    def places_in(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, start) of the windows that the item's stretches lay in a document."""
        found: set[tuple[int, int]] = set()
        for q, (codes, grams) in self.grams.items():
            if len(ids) < q:
                continue
            whole = np.ones(len(ids) - q + 1, dtype=bool)
            value = np.zeros(len(ids) - q + 1, dtype=np.uint64)
            for t in range(q):
                part = ids[t : len(ids) - q + 1 + t]
                whole &= part > 0
                value = value * np.uint64(RADIX) + part.astype(np.uint64)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            v = value[at]
            k = np.minimum(np.searchsorted(codes, v), len(codes) - 1)
            for p in at[codes[k] == v].tolist():
                found.update((item, p - q_at) for item, q_at in grams[int(value[p])])
        return found

    def ranges_in(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, low, high): where in a document passages of the item may lie, apart from each other."""
        item, low, high = -1, 0, 0
        for k, start in sorted(self.places_in(ids)):
            n = len(self.ids[k])
            e = edit_bound(n, self.edits)
            if k == item and start - e <= high:
                high = start + n + e
                continue
            if item >= 0:
                yield item, low, high
            item, low, high = k, max(0, start - e), start + n + e
        if item >= 0:
            yield item, low, high

    def hits(self, texts: Iterable[str | None]) -> list[list[Hit]]:
        """For each text the items that it holds, each at its best passage."""
        get = self.vocabulary.get
        out: list[list[Hit]] = []
        for text in texts:
            ids = [get(w, 0) for w in words_of(text)]
            best: dict[int, tuple[int, int]] = {}  # item: distance, start
            for k, low, high in self.ranges_in(np.array(ids, dtype=np.int64)):
                item = self.ids[k]
                bound = best[k][0] - 1 if k in best else edit_bound(len(item), self.edits)
                if bound < 0 or (found := nearest_end(item, ids[low:high], bound)) is None:
                    continue
                distance, end = found
                first = max(0, end - len(item) - distance)
                passage = best_passage(item, ids[low + first : low + end], distance)
                best[k] = (distance, low + first + passage[1])
            out.append([(k, start, distance, len(self.ids[k])) for k, (distance, start) in sorted(best.items())])
        return out


def matchers(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", edits: float = 0.2, least: int = 1) -> Iterator[Matcher]:
    """Matchers for the items, a block at a time in the order of their ids."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).orderBy("item_id", "text")
    block: list[tuple[int | None, list[str]]] = []
    size = 0
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if words and len(words) >= least:
            block.append((row["item_id"], words))
            size += len(words)
        if len(block) == ITEM_BLOCK or size >= WORD_BLOCK:
            yield Matcher(block, edits)
            block, size = [], 0
    if block:
        yield Matcher(block, edits)


def find(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, start, distance, item_words: one row for each item in a document.

    start: the number of the passage's first word.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], OUT)
    for matcher in matchers(items, **options):
        shared = spark.sparkContext.broadcast(matcher)  # ITEM_BLOCK items at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = shared.value.hits(t.as_py() for t in batch.column(1))
                out = [(d, shared.value.items[k][0], s, e, n) for d, hs in zip(batch.column(0).to_pylist(), hits, strict=True) for k, s, e, n in hs]
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "distance", "item_words"])

        found = found.union(rows.mapInArrow(run, OUT))
    return found


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    at = docs.columns.index(text_col)
    for matcher in matchers(items, **options):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)  # ITEM_BLOCK items at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = pa.array([not h for h in shared.value.hits(t.as_py() for t in batch.column(at))], pa.bool_())
                yield batch.filter(keep)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
