"""Similarity join of documents on the Jaccard index of their word n-grams.

Documents are sets of hashed shingles; two link when 100 * |A and B| is at
least ``percent`` * |A or B|, which bounds |A xor B| by a share of |A| + |B|.

1. Equal sets become one class, by a combined aggregation; classes are joined.
2. Parity sketches.  A set's shingles are dealt over the words of a sketch and
   XORed there.  An element of the symmetric difference changes one word, so
   with more words than the bound at least one is equal: classes meet there
   (pigeonhole).  The number of words depends on the size band alone; a class
   enters its own band and the next, so partners in either meet.  An empty word
   says nothing, hence a few words are spare: with e empty words and more than
   e spare ones an equal word that isn't empty remains.  A set with more empty
   words is dealt anew with other hashes, as often as it takes up to
   ``LEVELS``; beyond that its empty words count too.
3. Classes that share a word form runs; equal runs are kept once.  A word that
   many texts of one reader share doesn't travel by word: its rows go straight
   to the run that the word names, spread over all tasks, and a mark tells the
   word's own task to name the run alike.  No task gathers a hot word.
4. A run goes to its anchor, the member that is in most runs, so the many runs
   of a group of near copies go to a few anchors, each class once to each.
   Classes that share no more than a frequent shingle alone in its word make
   large groups, too.  So what a group's members first send each other, in blocks
   of ``SIEVE``, is a one-bit parity sketch of 256 bytes, more for long texts: its
   Hamming distance is at most |A xor B|.  Pairs that pass give components of kin, and a class that
   is kin to none is done with.
5. Only kin send texts.  Kin of up to ``BLOCK`` classes are one task's work and
   send each text once.  Of larger kin the runs go to their anchors again and
   are compared in blocks of ``BLOCK``, the anchor in each; a group of one block
   is done with that; of the others only runs that still hold several components
   go on, and there blocks of one component don't meet each other.  So a group of
   n near copies of its anchor costs n texts, not n * n / BLOCK.  In a task what
   the sketches leave is verified on the full sets, unless links already found
   connect the two.
6. The links, at most one a class in each comparison, give the components.

No link that would change a component is lost.  Texts travel deflated, and only
those of kin: a bitmap of at most 2^20 rows tells them.

Edge cases: null and empty texts and texts of white space have no shingle and
stand alone; a text with fewer words than a shingle is one shingle; a row with a
null id links like any other, but gives no name: a component of such rows alone
has a null name; rows repeated under one id get a row each, and links of either
text count for the id; texts of any length are whole; further columns are
ignored, whatever their names; an empty table gives an empty result.  Ids are
below 2^62.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import bitmap, cut, marked
from tilewright.llm.components import components

LEVELS = 6
BLOCK = 256
#: Sketches that one task compares with each other.
SIEVE = 4096
#: A word is hot for a reader from so many of its texts on, among SIGN_KEYS words or so.
HOT, SIGN_KEYS = 32, 1 << 17
#: A run of more rows streams through its task.
HELD = 100_000
#: Nodes from here on stand for texts without an id.
NAMELESS = 1 << 62
#: Kinds of rows of a sketch word, in the order of their sorting.
DIRECT, MARK, COLD = np.arange(3, dtype=np.int8)
SKETCH_WORDS = 32
#: Places of the sketches that are sent, a power of two and no fewer than shingles up to the largest.
LEAST_PLACES, MOST_PLACES = 1 << 11, 1 << 16
U = np.uint64
MASK = (1 << 64) - 1
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of BASE and of its inverse, modulo 2^64."""

    up = np.ones(1, dtype=U)
    down = np.ones(1, dtype=U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", INVERSE)):
                a = np.full(size, base, dtype=U)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word; the data is already lower-cased."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], ~IS_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=U)
    up, down = _Powers.get(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], dtype=U)))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingle_set(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text or its UTF-8; A-Z count as a-z."""
    data = text if isinstance(text, bytes) else (text or "").encode()
    w = word_hashes(data.lower())  # bytes.lower() changes A-Z only
    n = len(w)
    if not n:
        return w
    size = min(n, words)
    h = np.full(n - size + 1, size, dtype=U)
    for k in range(size):
        h = mixed(h * U(0x2545F4914F6CDD1D) + w[k : n - size + 1 + k])
    return np.unique(h)


@cache
def bands(percent: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band; partners are at most one band apart."""
    out, low = [], 1
    while low < 1 << 40:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


@cache
def band_of(n: int, percent: int) -> int:
    found = bands(percent)
    lo, hi = 0, len(found) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if found[mid][1] < n else (lo, mid)
    return lo


@cache
def layout(band: int, percent: int) -> tuple[int, int]:
    """Bound of the symmetric difference in a band, and its spare words."""
    low, high = bands(percent)[band]
    bound = (100 - percent) * 2 * high // (100 + percent)
    load = low * math.sqrt(percent / 100) / (bound + 1)
    return bound, int(1.3 * bound * math.exp(-load)) + (bound >= 12)


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which a set meets every set that it may link to, but equal ones."""
    own = band_of(len(h), percent)
    out = []
    for band in (own, own + 1):
        bound, spare = layout(band, percent)
        if not bound:  # only equal sets link
            continue
        n_words = bound + 1 + spare
        for level in range(LEVELS):
            x = np.sort(mixed(h + U(0xA0761D6478BD642F * (level + 1) & MASK)))
            word = ((x >> U(32)) * U(n_words)) >> U(32)
            starts = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
            tag = U(((band << 8 | level) + 1) * 0xE7037ED1A0B428DB & MASK)
            out.append(mixed(np.bitwise_xor.reduceat(x, starts) + mixed(word[starts] * U(0x8EBC6AF09C88C6E3) + tag)))
            if n_words - len(starts) <= spare:
                break
        else:
            empty = np.setdiff1d(np.arange(n_words, dtype=U), word[starts])
            out.append(mixed(empty * U(0x8EBC6AF09C88C6E3) + (tag ^ U(1))))
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS words of 64 bits; each element flips one bit."""
    bit = mixed(h + U(0x589965CC75374CC3)) >> U(53)  # 11 bits: 2,048 places
    parity = np.bincount(bit.astype(np.int64), minlength=SKETCH_WORDS * 64) & 1
    return np.packbits(parity.astype(np.uint8)).view(U)


def places_of(n: int) -> int:
    """The places of the sketch that a set of ``n`` shingles sends."""
    return min(max(LEAST_PLACES, 1 << max(n - 1, 0).bit_length()), MOST_PLACES)


def long_sketch(h: np.ndarray) -> np.ndarray:
    """Words of 64 bits of a sketch of places_of() places; XORing its halves gives the sketch of half the places."""
    n = places_of(len(h))
    bit = mixed(h + U(0x589965CC75374CC3)) & U(n - 1)
    parity = np.bincount(bit.astype(np.int64), minlength=n) & 1
    return np.packbits(parity.astype(np.uint8)).view(U)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def compare(ids: list[int], sets: list[np.ndarray], sides: list[int], known: list[int], percent: int) -> list[tuple[int, int]]:
    """(member, smallest member of its component) for the components that links make.

    sides: 0 and 1 for two blocks, of which only pairs across are wanted; all 0
    within one block.  known: components found before; their members need no
    comparison.
    """
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = sorted(range(len(ids)), key=ids.__getitem__)  # a root is its component's smallest id
    ids, sets, sides, known = [ids[k] for k in order], [sets[k] for k in order], [sides[k] for k in order], [known[k] for k in order]
    first: dict[int, int] = {}
    for k, component in enumerate(known):
        parent[k] = first.setdefault(component, k)
    size = np.array([len(s) for s in sets])
    sketch = np.stack([parity_sketch(s) for s in sets])
    side = np.array(sides)
    across = bool(side.any())
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        if across:
            j = j[side[j] != side[i]]
        both = size[j] + size[i]
        bound = (100 - percent) * both // (100 + percent)
        j = j[np.abs(size[j] - size[i]) <= bound]
        if not len(j):
            continue
        bound = (100 - percent) * (size[j] + size[i]) // (100 + percent)
        j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1) <= bound]
        for k in j.tolist():
            if find(i) != find(k) and links(sets[i], sets[k], percent):
                low, high = sorted((find(i), find(k)))
                parent[high] = low
    return [(ids[k], ids[find(k)]) for k in range(len(ids)) if find(k) != k]


def alike(nodes: list[int], sizes: list[int], sketches: list[bytes], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all members whose sketches don't tell that they can't link, fewer than members; sides as in compare()."""
    order = sorted(range(len(nodes)), key=sizes.__getitem__)
    node, size, side = (np.array(c)[order] for c in (nodes, sizes, sides))
    across = bool(side.any())
    label = np.arange(len(node))
    ends = np.searchsorted(size, size * 100 // percent, side="right")
    width = np.array([len(sketches[k]) // 8 for k in order])  # no less than that of a smaller set
    out = []
    for w in np.unique(width).tolist():
        first, last = np.searchsorted(width, w), np.searchsorted(width, w, side="right")
        top = int(ends[last - 1])  # partners of this width or more, which are folded to it
        own = [np.frombuffer(sketches[k], dtype=U).reshape(-1, w) for k in order[first:top]]
        sketch = np.stack([np.bitwise_xor.reduce(x, axis=0) for x in own])
        for i in range(first, last):
            j = np.arange(i + 1, ends[i])
            j = j[label[j] != label[i]]
            if across:
                j = j[side[j] != side[i]]
            bound = (100 - percent) * (size[j] + size[i]) // (100 + percent)
            for k in j[np.bitwise_count(sketch[j - first] ^ sketch[i - first]).sum(axis=1) <= bound].tolist():
                if label[k] != label[i]:
                    out.append((int(node[i]), int(node[k])))
                    label[label == label[k]] = label[i]
    return out


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that depend on the set alone."""
    one = int(mixed(h).sum(dtype=U)) - (1 << 63)
    return one, int(np.bitwise_xor.reduce(mixed(h ^ U(0x1D8E4E27C47D124F)), initial=U(0))) - (1 << 63)


def node_of(doc_id: int | None, h: np.ndarray) -> int:
    """The id, or a number of the set's own beyond all ids."""
    return doc_id if doc_id is not None else NAMELESS + (fingerprint(h)[1] & NAMELESS - 1)


def classes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node, n_shingles, rep: the smallest node with an equal set (its own, if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_set(text.as_py(), words)
                rows.append((doc_id, node_of(doc_id, h), len(h), *fingerprint(h)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "node", "n_shingles", "s1", "s2"])

    told = cut(docs.mapInArrow(run, "doc_id long, node long, n_shingles long, s1 long, s2 long"))
    rows = told.count()
    first = cut(told.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("node").alias("rep")), rows)  # so a hot set's rows can be split
    joined = told.join(first, ["s1", "s2", "n_shingles"], "left")
    return cut(joined.select("doc_id", "node", "n_shingles", F.coalesce("rep", "node").alias("rep")), rows)


def runs(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(run, node): documents that share a word of their sketches, equal runs once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with their owners: cold rows, direct rows of hot words, and a mark of each hot word."""
        seen: set[bytes] = set()  # equal sets of one split need one entry
        keys: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            k, node = np.concatenate(keys), np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in keys])
            names, at, counts = np.unique(k, return_inverse=True, return_counts=True)
            kind = np.where(counts[at] >= HOT, DIRECT, COLD).astype(np.int8)
            marks = names[counts >= HOT]
            k, node = np.concatenate((k, marks)), np.concatenate((node, np.zeros(len(marks), np.int64)))
            kind = np.concatenate((kind, np.full(len(marks), MARK, np.int8)))
            keys.clear()
            owners.clear()
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in (k.view(np.int64), node, kind)], names=["key", "node", "kind"])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size > SIGN_KEYS:
                    yield from flush()
                    size = 0
                h = shingle_set(text.as_py(), words)
                if not len(h):
                    continue
                mark = mixed(h).sum(dtype=U).tobytes() + np.bitwise_xor.reduce(h).tobytes()
                if mark in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()  # a later copy signs once more
                seen.add(mark)
                k = signatures(h, percent)
                keys.append(k)
                owners.append(node_of(doc_id, h))
                size += len(k)
        if keys:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        left: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]

        def named(k: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows of runs that their word names."""
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(mixed(k.view(U)).view(np.int64)), pa.array(node)], names=["run", "node"])

        def closed(k: np.ndarray, node: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Runs of two or more among complete words; marks and direct rows come first in a word."""
            hot = np.isin(k, k[kind != COLD])
            yield from named(k[hot & (kind != MARK)], node[hot & (kind != MARK)])
            k, node = k[~hot], node[~hot]
            if not len(k):
                return
            starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
            sizes = np.diff(np.append(starts, len(k)))
            out_r, out_d = [], []
            spread = mixed(node.view(U) + U(0x9FB21C651E98DF25))
            totals = np.add.reduceat(spread, starts)
            for s in np.flatnonzero(sizes > 1).tolist():
                total = int(totals[s])
                if total not in known:
                    if len(known) > 1_000_000:
                        known.clear()
                    known.add(total)
                    a, n = int(starts[s]), int(sizes[s])
                    out_r.append(np.full(n, total, dtype=U).view(np.int64))
                    out_d.append(node[a : a + n])
            if out_r:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_r)), pa.array(np.concatenate(out_d))], names=["run", "node"])

        streaming: int | None = None  # the word of a long run, which its word names
        for batch in batches:
            if not batch.num_rows:
                continue
            k, node, kind = (np.concatenate((a, c.to_numpy(zero_copy_only=False))) for a, c in zip(left, batch.columns, strict=True))
            if streaming is not None:
                rest = int(np.searchsorted(k, streaming, side="right"))
                yield from named(k[:rest], node[:rest])
                k, node, kind = k[rest:], node[rest:], kind[rest:]
                if not len(k):
                    left = [k, node, kind]
                    continue
                streaming = None
            last = int(np.searchsorted(k, k[-1], side="left"))  # its word may go on
            if last:
                yield from closed(k[:last], node[:last], kind[:last])
            k, node, kind = k[last:], node[last:], kind[last:]
            if len(k) > HELD:
                streaming = int(k[0])
                yield from named(k[kind != MARK], node[kind != MARK])
                k, node, kind = k[:0], node[:0], kind[:0]
            left = [k, node, kind]
        if len(left[0]):
            yield from closed(*left)

    keyed = docs.mapInArrow(sign, "key long, node long, kind byte")
    place = F.when(F.col("kind") == int(DIRECT), F.xxhash64("node", "key")).otherwise(F.col("key"))
    return keyed.repartition(place).sortWithinPartitions("key", "kind").mapInArrow(meet, "run long, node long")


def packed(docs: DataFrame, words: int) -> DataFrame:
    """node, packed: the texts deflated, as a large group sends them to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                nodes, data = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    text = text.as_py() or ""
                    nodes.append(doc_id if doc_id is not None else node_of(None, shingle_set(text, words)))
                    data.append(zlib.compress(text.encode(), 1))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], names=["node", "packed"])

    return docs.mapInArrow(run, "node long, packed binary")


def wanted(docs: DataFrame, work: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the nodes of ``work`` stand for, and few others."""
    names = work.select("node").distinct()
    places = bitmap(names.select(F.xxhash64("node").alias("h")), "h")
    nameless = docs.filter("doc_id IS NULL").dropDuplicates(["text"])
    return marked(docs.filter("doc_id IS NOT NULL"), F.xxhash64("doc_id"), places).union(nameless)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """node, size, sketch: the number of shingles and the parity sketch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_set(text.as_py(), words)
                rows.append((node_of(doc_id, h), len(h), long_sketch(h).tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            kinds = pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["node", "size", "sketch"])

    return docs.mapInArrow(run, "node long, size long, sketch binary")


def kin(grouped: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): enough pairs to connect all members of a group (grp, node) that may link by their sketches."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: set[tuple] = set()  # node, size, sketch, side; a row repeated under one id counts once

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            node, size, sketch, side = zip(*sorted(held), strict=True)
            if found := alike(node, size, sketch, side, percent):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            for *key, side, node, size, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(key) != at:
                    yield from close()
                    at, held = tuple(key), set()
                held.add((node, size, sketch, side))
        yield from close()

    key = ["grp", "x", "y"]
    parts = grouped.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / SIEVE).cast("int").alias("parts"))
    own = grouped.join(parts, "grp").select("grp", "node", block_of("parts").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = own.select("grp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node")
    with_sketch = met.join(sketched(wanted(docs, grouped), words), "node").select(*key, "side", "node", "size", "sketch")
    return cut(with_sketch.repartition(*key).sortWithinPartitions(*key).mapInArrow(sift, "a long, b long"))


def compared(work: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links found; work: grp, x, y, side, node, component, of which each (grp, x, y) is compared."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple] = []  # node, set, side, component
        seen: set[tuple[int, int, int]] = set()  # a row repeated under one id counts once

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (found := compare(*map(list, zip(*held, strict=True)), percent)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            for *key, side, component, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(key) != at:
                    yield from close()
                    at, held, seen = tuple(key), [], set()
                mark = (node, side, hash(text))
                if mark not in seen:
                    seen.add(mark)
                    held.append((node, shingle_set(zlib.decompress(text), words), side, component))
        yield from close()

    key = ["grp", "x", "y"]
    with_text = work.join(packed(wanted(docs, work), words), "node").select(*key, "side", "component", "node", "packed")
    ordered = with_text.repartition(*key).sortWithinPartitions(*key)
    return cut(ordered.mapInArrow(check, "a long, b long"))


def block_of(parts: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64(node), {parts}) as int)")


def anchored(met: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(run, grp) and the distinct (grp, node): the runs of ``met`` go to their anchors."""
    busy = cut(met.groupBy("node").agg(F.count(F.lit(1)).alias("n_runs")), rows)
    best = F.max(F.struct(F.col("n_runs"), (-F.col("node")).alias("minus")))
    anchor = met.join(busy, "node").groupBy("run").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    anchor = cut(anchor.select("run", (-F.col("best.minus")).alias("grp")), rows)
    return anchor, cut(met.join(anchor, "run").select("grp", "node").distinct(), rows)


def found_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): class representatives that links connect, enough to connect all that they do."""
    met = runs(docs, words, percent).join(members.select("node", "rep"), "node").select("run", F.col("rep").alias("node"))
    met = cut(met.distinct())
    rows = met.count()
    _, grouped = anchored(met, rows)
    related = cut(components(kin(grouped, docs, words, percent)), rows)
    counts = related.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    related = cut(related.join(counts, "component"), rows)
    own = related.filter(F.col("n") <= BLOCK).select(F.col("component").alias("grp"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "node", F.col("node").alias("component"))
    found = compared(own, docs, words, percent)
    large = related.filter(F.col("n") > BLOCK).select("node", "component")
    if large.isEmpty():
        return found
    shared = cut(met.join(large, "node").select(F.xxhash64("run", "component").alias("run"), "node"), rows)
    return found.union(links_of_large(shared, rows, docs, words, percent))


def links_of_large(met: DataFrame, rows: int, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The links among kin of more than a block; met: their runs, of one kin each."""
    anchor, grouped = anchored(met, rows)
    sizes = cut(grouped.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), rows)

    # each block with its anchor
    placed = grouped.join(sizes, "grp").filter("node <> grp").select("grp", block_of("blocks").alias("x"), "node")
    anchors = sizes.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.col("grp").alias("node"))
    own = placed.union(anchors).withColumn("y", F.col("x")).withColumn("side", F.lit(0)).withColumn("component", F.col("node"))
    found = compared(own, docs, words, percent)

    # runs of large groups that still hold several components
    large = cut(anchor.join(sizes.filter("blocks > 1"), "grp").select("run", "grp"), rows)
    if large.isEmpty():
        return found
    reached = cut(components(found), rows)
    told = met.join(large, "run").join(reached.select("node", F.col("component")), "node", "left").select("run", "grp", "node", F.coalesce("component", "node").alias("component"))
    several = told.groupBy("run").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("run")
    rest = cut(told.join(several, "run").select("grp", "node", "component").distinct(), rows)
    if rest.isEmpty():
        return found
    # blocks of one component where it fills them, else mixed ones
    parts = rest.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    pure = F.col("n") > BLOCK
    mixed_n = F.sum(F.when(~pure, F.col("n"))).alias("mixed_n")
    parts = cut(parts.join(parts.groupBy("grp").agg(mixed_n), "grp"), rows)
    blocks = F.when(pure, F.ceil(F.col("n") / BLOCK)).otherwise(F.ceil(F.col("mixed_n") / BLOCK)).cast("int")
    dealt = rest.join(parts.withColumn("pure", pure).withColumn("blocks", blocks), ["grp", "component"])
    of = F.when(F.col("pure"), F.col("component")).otherwise(F.lit(None).cast("long"))
    dealt = cut(dealt.select("grp", "node", "component", F.struct(of.alias("of"), block_of("blocks").alias("part")).alias("block")), rows)
    listed = cut(dealt.select("grp", "block").distinct(), rows)
    pairs = listed.select("grp", F.col("block").alias("x")).join(listed.select("grp", F.col("block").alias("y")), "grp")
    pairs = pairs.filter((F.col("x") <= F.col("y")) & (F.col("x.of").isNull() | ~F.col("x.of").eqNullSafe(F.col("y.of"))))
    left = dealt.join(pairs.withColumnRenamed("x", "block"), ["grp", "block"]).select("grp", F.col("block").alias("x"), "y", F.lit(0).alias("side"), "node", "component")
    right = dealt.join(pairs.filter("x <> y").withColumnRenamed("y", "block"), ["grp", "block"]).select("grp", "x", F.col("block").alias("y"), F.lit(1).alias("side"), "node", "component")
    # the components found before hold where only their parts meet
    return found.union(compared(left.union(right), docs, words, percent))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row of ``docs``.

    class_id: the smallest id with an equal set; component_id: the smallest id
    that links lead to.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    members = classes(rows, words)
    reached = components(found_links(rows, members, words, percent)).select(F.col("node").alias("rep"), "component")
    joined = members.join(reached, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    name = lambda c: F.when(F.col(c) < NAMELESS, F.col(c))
    return joined.select("doc_id", "n_shingles", name("rep").alias("class_id"), name("component").alias("component_id"))
