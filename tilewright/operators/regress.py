"""Two archives compared: what moved, changed, came and went, and the verdict.

Stages see what the stage before leaves open: spans of equal payloads are done,
then tiles whose features are the same in any order, then single features.
Differences are counted by zoom and layer, weighted by the tiles of a span.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import assemble as A
from tilewright.operators.inspect import zoom_of
from tilewright.sources import files, mvt

# What a difference can be; all but the moves within tolerance fail a run.
CLASSES = ["layer_added", "layer_removed", "extent_mismatch", "missing_features", "added_features", "attr_changed", "tolerance_moved", "structural_moved"]
OUT = "z int, layer string, outcome string, n long"
#: Groups of leftover features up to this size are matched by all their distances, larger ones by their nearest.
SMALL, NEAREST = 24, 8
EXIT_OK, EXIT_DIFFERENT, EXIT_REFUSED, EXIT_NO_BASELINE = 0, 1, 2, 3


def spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """tiles, first, a, b: pairs of different payloads and how many tiles have them; runs as the pmtiles source gives them.

    A tile that one side lacks has a null payload there.
    """
    cuts = lambda runs: runs.select("start_id", "run_length", F.sha2("payload", 256).alias("digest"))
    merged = A.directory_merge(cuts(a), cuts(b)).filter(~F.col("a").eqNullSafe(F.col("b")))
    pairs = merged.groupBy("a", "b").agg(F.sum("span_length").alias("tiles"), F.min("span_start").alias("first"))
    blobs = lambda runs, name: runs.select(F.sha2("payload", 256).alias(name), F.col("payload").alias(f"payload_{name}")).dropDuplicates([name])
    return pairs.join(blobs(a, "a"), "a", "left").join(blobs(b, "b"), "b", "left")


def canonical(layers: dict[str, list[mvt.Feature]]) -> dict[str, list[bytes]]:
    """Digests of each layer's features, sorted: equal however the features are ordered."""
    return {name: sorted(digest(f) for f in features) for name, features in layers.items()}


def digest(f: mvt.Feature) -> bytes:
    """A feature's digest; its points keep their order, its parts don't."""
    parts = sorted(hashlib.md5(repr(p).encode(), usedforsecurity=False).digest() for p in f.parts)
    return hashlib.md5(repr((f.kind, f.id, sorted(f.tags.items(), key=str), parts)).encode(), usedforsecurity=False).digest()


def shape_digest(f: mvt.Feature) -> tuple:
    return f.kind, tuple(sorted(tuple(p) for p in f.parts))


def distance(a: mvt.Feature, b: mvt.Feature) -> float:
    """The farthest that a vertex of either feature is from the other's nearest vertex; infinite between kinds."""
    if a.kind != b.kind:
        return math.inf
    p, q = [x for part in a.parts for x in part], [x for part in b.parts for x in part]
    if not p or not q:
        return math.inf
    far = lambda one, two: max(min(math.dist(x, y) for y in two) for x in one)
    return max(far(p, q), far(q, p))


def paired(a: list[mvt.Feature], b: list[mvt.Feature]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs of features of two sides, and those left on either.

    Equal geometry first, equal attributes before others; of the rest the nearest
    pairs, shortest first, a pair that blocks a shorter total being undone; what is
    still left is paired in order, so that a change of kind is one difference.
    """
    places: dict[tuple, list[int]] = {}
    for j, f in enumerate(b):
        places.setdefault(shape_digest(f), []).append(j)
    found: list[tuple[int, int]] = []
    left: list[int] = []
    for i, f in enumerate(a):
        same = places.get(shape_digest(f), [])
        if same:
            j = next((j for j in same if b[j].tags == f.tags), same[0])
            same.remove(j)
            found.append((i, j))
        else:
            left.append(i)
    right = sorted(j for rest in places.values() for j in rest)
    matched = nearest(a, b, left, right)
    found += matched
    taken_i, taken_j = {i for i, _ in matched}, {j for _, j in matched}
    left, right = [i for i in left if i not in taken_i], [j for j in right if j not in taken_j]
    n = min(len(left), len(right))
    return found + list(zip(left[:n], right[:n], strict=True)), left[n:], right[n:]


def nearest(a: list[mvt.Feature], b: list[mvt.Feature], left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """As many pairs as the nearest candidates allow, of the least total distance.

    Each round adds a pair along the cheapest path of the residual graph, in which
    a pair made before may be undone.
    """
    many = SMALL if max(len(left), len(right)) <= SMALL else NEAREST
    cost: dict[tuple[int, int], float] = {}
    for i in left:
        near = sorted((distance(a[i], b[j]), j) for j in right)
        cost |= {(i, j): d for d, j in near[:many] if d < math.inf}
    owner: dict[int, int] = {}  # of a right
    while True:
        at = {i: 0.0 for i in left if i not in owner.values()}
        reached: dict[int, float] = {}
        back: dict[int, int] = {}
        shorter = True
        while shorter:
            shorter = False
            for (i, j), d in cost.items():
                if i in at and owner.get(j) != i and at[i] + d < reached.get(j, math.inf) - 1e-9:
                    reached[j], back[j], shorter = at[i] + d, i, True
                    if j in owner:
                        at[owner[j]] = min(at.get(owner[j], math.inf), reached[j] - cost[owner[j], j])
        ends = [j for j in reached if j not in owner]
        if not ends:
            return sorted((i, j) for j, i in owner.items())
        j = min(ends, key=lambda j: (reached[j], j))
        held = {i: j for j, i in owner.items()}
        while True:
            i = back[j]
            owner[j] = i
            if i not in held:
                break
            j = held[i]


def differences(a: dict[str, list[mvt.Feature]], b: dict[str, list[mvt.Feature]], tolerance: float, extents: tuple[dict, dict] = ({}, {})) -> list[tuple[str, str]]:
    """(layer, outcome) of each difference between two decoded tiles: baseline and current."""
    out = [(name, "layer_removed") for name in a.keys() - b.keys()] + [(name, "layer_added") for name in b.keys() - a.keys()]
    one, two = canonical(a), canonical(b)
    for name in sorted(a.keys() & b.keys()):
        if extents[0].get(name, 4096) != extents[1].get(name, 4096):
            out.append((name, "extent_mismatch"))
        if one[name] == two[name]:
            continue
        pairs, missing, added = paired(a[name], b[name])
        out += [(name, "missing_features")] * len(missing) + [(name, "added_features")] * len(added)
        for i, j in pairs:
            old, new = a[name][i], b[name][j]
            if old.tags != new.tags or old.id != new.id:
                out.append((name, "attr_changed"))
            if shape_digest(old) != shape_digest(new):
                same = old.kind == new.kind and sorted(map(len, old.parts)) == sorted(map(len, new.parts))
                out.append((name, "tolerance_moved" if same and distance(old, new) <= tolerance else "structural_moved"))
    return out


def extents_of(tile: bytes) -> dict[str, int]:
    """The extent of each layer."""
    out = {}
    for number, _, data in mvt.fields(tile):
        if number == 3:
            told = {n: v for n, _, v in mvt.fields(data) if n in (1, 5)}
            out[told.get(1, b"").decode()] = told.get(5, 4096)
    return out


def regress(a: DataFrame, b: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """z, layer, outcome, n: differences between the runs of a baseline and of a current archive."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            rows = []
            for first, tiles, old, new in zip(*(batch.column(c).to_pylist() for c in ("first", "tiles", "payload_a", "payload_b")), strict=True):
                raw = [gzip.decompress(x) if x is not None else b"" for x in (old, new)]
                found = differences(*(mvt.decode(x, strict=False) for x in raw), tolerance, tuple(map(extents_of, raw)))
                rows += [(zoom_of(first), layer, outcome, tiles) for layer, outcome in found]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["z", "layer", "outcome", "n"])

    told = spans(a, b).select("first", "tiles", "payload_a", "payload_b").mapInArrow(compare, OUT)
    return told.groupBy("z", "layer", "outcome").agg(F.sum("n").alias("n"))


def verdict(counts: dict[str, int], most_moved: int = 0) -> int:
    """0 if there is nothing but moves within tolerance, at most ``most_moved`` of them; else 1."""
    if any(counts.get(c, 0) for c in CLASSES if c != "tolerance_moved"):
        return EXIT_DIFFERENT
    return EXIT_OK if counts.get("tolerance_moved", 0) <= most_moved else EXIT_DIFFERENT


def bless(contract: str, digests: dict[str, str]) -> str:
    """A baseline: the contract under which an archive was built, and its digests by bucket."""
    return json.dumps({"contract": json.loads(contract), "digests": digests}, sort_keys=True)


def check(baseline: str | None, contract: str, digests: dict[str, str]) -> tuple[int, list[str]]:
    """(exit code, lines): a build under another contract is refused first, then trouble with the baseline, then differences."""
    if baseline is not None:
        try:
            told = json.loads(baseline)
            written, known = told["contract"], told["digests"]
        except (ValueError, KeyError, TypeError) as broken:
            return EXIT_NO_BASELINE, [f"the baseline isn't readable: {broken}"]
        if written != json.loads(contract):
            return EXIT_REFUSED, ["the baseline was built under another contract"]
    else:
        return EXIT_NO_BASELINE, ["no baseline"]
    lines = [f"- {k}" for k in sorted(known.keys() - digests.keys())] + [f"+ {k}" for k in sorted(digests.keys() - known.keys())]
    lines += [f"~ {k}" for k in sorted(known.keys() & digests.keys()) if known[k] != digests[k]]
    return (EXIT_DIFFERENT, lines) if lines else (EXIT_OK, [])


def mutated(tiles: DataFrame, how: str, tile_id: int) -> DataFrame:
    """Tiles (tile_id, payload) with one known change: to calibrate what compares archives.

    drop: the tile is missing; nudge: each vertex one unit to the right; version: the
    layers say version 1; regzip: the same content compressed otherwise.
    """
    if how == "drop":
        return tiles.filter(F.col("tile_id") != tile_id)

    def change(payload: bytes) -> bytes:
        raw = gzip.decompress(payload)
        if how == "regzip":
            return gzip.compress(raw, 1, mtime=1)
        out = b""
        for name, features in mvt.decode(raw).items():
            if how == "nudge":
                for f in features:
                    f.parts = [[(x + 1, y) for x, y in part] for part in f.parts]
            layer = mvt.encode_layer(name, features)
            out += layer[:-1] + b"\x01" if how == "version" else layer  # the version is a layer's last field
        return gzip.compress(out, 6, mtime=0)

    if how not in ("nudge", "version", "regzip"):
        raise ValueError(f"mutation {how}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            ids, payloads = batch.column("tile_id").to_pylist(), batch.column("payload").to_pylist()
            made = [change(p) if i == tile_id else p for i, p in zip(ids, payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tile_id"), pa.array(made, pa.binary())], names=["tile_id", "payload"])

    return tiles.select("tile_id", "payload").mapInArrow(run, "tile_id long, payload binary")
