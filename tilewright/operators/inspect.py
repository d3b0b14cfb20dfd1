"""Archives looked into: summary, verification findings and rings of a tile.

``verify_table`` judges archives of any size: a payload once for each zoom and
side of the world it is used at, in Arrow batches, counted for all its addresses.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import geo as G
from tilewright.functions.geo import ZOOM_BASES
from tilewright.kernels.polygons import RING_CAP, full_tile
from tilewright.kernels.rings import area2, is_simple
from tilewright.schema import EXTENT, LAND_RANK, LAYER_FIELDS, LAYERS, STREET_CLASSES, kind_of_key
from tilewright.sources import files, mvt
from tilewright.sources.pmtiles import GZIP, Archive, inflated
from tilewright.sources.pmtiles import metadata as told_metadata

#: A coordinate may lie this many extents outside its tile, a step may span this many.
FAR, STEP = 32, 16
#: In the columns at the world's edges a step may span less.
SEAM_STEP = 4
FIRST_FINDINGS = 20


def zoom_of(tile_id: int) -> int:
    return next(z for z in range(len(ZOOM_BASES) - 1, -1, -1) if tile_id >= ZOOM_BASES[z])


def summary(archive: Archive) -> dict:
    """Header counts, share of deduplicated tiles, tiles for each zoom, metadata."""
    entries = archive.entries()
    tiles = sum(e.run_length for e in entries)
    zooms: Counter = Counter()
    for e in entries:
        zooms[zoom_of(e.tile_id)] += e.run_length
    uniques = len({(e.offset, e.length) for e in entries})
    return {"tiles": tiles, "uniques": uniques, "deduplicated": round(1 - uniques / tiles, 6) if tiles else 0.0, "zooms": dict(sorted(zooms.items())), "metadata": archive.metadata()}


def schema_findings(told: dict) -> list[str]:
    """Layers and fields of an archive's metadata against the catalogue's, clamped to the archive's zooms."""
    zooms = (told.get("minzoom", 0), told.get("maxzoom", 14))
    wanted = {x["id"]: x for x in told_metadata("", zooms)["vector_layers"]}
    found = {x["id"]: x for x in told.get("vector_layers", [])}
    out = [f"layer {name} isn't declared" for name in wanted.keys() - found.keys()] + [f"layer {name} isn't known" for name in found.keys() - wanted.keys()]
    out += [f"layer {name} is declared otherwise" for name in wanted.keys() & found.keys() if wanted[name] != found[name]]
    return sorted(out)


def verify(archive: Archive) -> dict:
    """Findings by kind, all counted and the first of them kept; each payload is judged once. For small archives."""
    known = {x.name: x for x in LAYERS}
    found: Counter = Counter()
    first: list[tuple[int, str]] = []
    judged: dict[tuple[int, int, int], list[str]] = {}
    for e in archive.entries():
        key = (e.offset, e.length, zoom_of(e.tile_id))
        if key not in judged:
            judged[key] = findings(archive.tile(e), key[2], known)
        for kind in judged[key]:
            found[kind] += e.run_length
            if len(first) < FIRST_FINDINGS:
                first.append((e.tile_id, kind))
    return {"findings": dict(sorted(found.items())), "first": first}


def addresses(runs: DataFrame) -> DataFrame:
    """offset, length, z, seam, tiles, first: how often each payload is used at a zoom, in the world's edge columns and elsewhere."""
    at = runs.select("offset", "length", F.explode(F.sequence("start_id", F.col("start_id") + F.col("run_length") - 1)).alias("tile_id"))
    at = at.withColumn("t", G.tile_xy(F.col("tile_id")))
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("t.z").cast("int"))
    seam = (F.col("t.x") == 0) | (F.col("t.x") == side - 1)
    return at.groupBy("offset", "length", F.col("t.z").alias("z"), seam.alias("seam")).agg(F.count(F.lit(1)).alias("tiles"), F.min("tile_id").alias("first"))


def verify_table(runs: DataFrame, compression: int = GZIP) -> DataFrame:
    """finding, z, tiles, first: all findings of an archive's runs (start_id, run_length, offset, length, payload) by zoom, with their addresses."""
    known = {x.name: x for x in LAYERS}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            rows = []
            for z, seam, tiles, first, payload in zip(*(batch.column(c).to_pylist() for c in ("z", "seam", "tiles", "first", "payload")), strict=True):
                try:
                    tile = inflated(payload, compression)
                except (OSError, EOFError) as broken:
                    rows.append((f"unreadable: {broken}", z, tiles, first))
                    continue
                rows += [(kind, z, tiles, first) for kind in sorted(set(findings(tile, z, known, seam)))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["finding", "z", "tiles", "first"])

    blobs = runs.groupBy("offset", "length").agg(F.min("start_id").alias("start_id")).join(runs.select("start_id", "payload"), "start_id").drop("start_id")
    used = addresses(runs).join(blobs, ["offset", "length"])
    told = used.select("z", "seam", "tiles", "first", "payload").mapInArrow(judge, "finding string, z int, tiles long, first long")
    return told.groupBy("finding", "z").agg(F.sum("tiles").alias("tiles"), F.min("first").alias("first"))


def paint_rank(layer: str, tags: dict) -> int | None:
    """The rank that a feature's attributes tell; None where its layer has none."""
    if layer == "land":
        return next((rank for rank, kinds in LAND_RANK.items() if tags.get("kind") in kinds), None)
    if layer == "streets" and tags.get("kind") in STREET_CLASSES:
        level = 0 if tags.get("tunnel") else 2 if tags.get("bridge") else 1
        return STREET_CLASSES.index(tags["kind"]) * 6 + level * 2 + (0 if tags.get("link") else 1)
    return None


def kind_of_value(value: mvt.Value) -> str:
    return "Boolean" if isinstance(value, bool) else "String" if isinstance(value, str) else "Number"


def findings(tile: bytes, zoom: int, known: dict, seam: bool = False) -> list[str]:
    """What is wrong with a tile, a word for each time it occurs."""
    out = []
    try:
        layers = mvt.decode(tile)
    except (ValueError, IndexError, UnicodeDecodeError) as broken:
        return [f"unreadable: {broken}"]
    if [known[n].id for n in layers if n in known] != sorted(known[n].id for n in layers if n in known):
        out.append("layer order")
    step = SEAM_STEP if seam else STEP
    for name, features in layers.items():
        if name not in known:
            out.append("unknown layer")
            continue
        if zoom < known[name].floor:
            out.append("layer below its first zoom")
        ranks = [r for f in features if (r := paint_rank(name, f.tags)) is not None] if zoom >= 11 or name == "land" else []
        if any(a > b for a, b in zip(ranks[:-1], ranks[1:], strict=True)):
            out.append("paint order")
        for f in features:
            for key, value in f.tags.items():
                if key not in LAYER_FIELDS[name]:
                    out.append("undeclared attribute")
                elif kind_of_key(key) != kind_of_value(value):
                    out.append("attribute of another kind")
            if f.kind == mvt.POLYGON and len(f.parts) > RING_CAP:
                out.append("too many rings")
            for part in f.parts:
                if any(abs(c) > FAR * EXTENT for p in part for c in p):
                    out.append("coordinate far outside")
                if any(abs(a - b) > step * EXTENT for p, q in zip(part[:-1], part[1:], strict=True) for a, b in zip(p, q, strict=True)):
                    out.append("long step")
                if f.kind == mvt.POLYGON and not area2(part):
                    out.append("flat ring")
                if f.kind == mvt.POLYGON and name == "ocean" and not is_simple(part):
                    out.append("ocean ring crosses itself")
    return out


def ocean_stats(tiles: DataFrame, compression: int = GZIP) -> DataFrame:
    """z, features, rings, bytes, vertices, most, p99, repeats, full: the ocean layer of tiles (tile_id, payload), by zoom.

    p99: of the vertices of a ring, the element at min(n - 1, n * 99 / 100) of the sorted list.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            rows = []
            for tile_id, payload in zip(batch.column("tile_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                features = mvt.decode(inflated(payload, compression)).get("ocean", [])
                for f in features:
                    size = len(mvt.encode_layer("ocean", [f]))
                    for k, ring in enumerate(f.parts):
                        repeats = sum(a == b for a, b in zip(ring[:-1], ring[1:], strict=True))
                        rows.append((zoom_of(tile_id), int(k == 0), size if k == 0 else 0, len(ring), repeats, int(k == 0 and sorted(ring) == sorted(full_tile()[0]))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names="z first bytes vertices repeats full".split())

    rings = tiles.select("tile_id", "payload").mapInArrow(read, "z long, first long, bytes long, vertices long, repeats long, full long")
    w = Window.partitionBy("z").orderBy("vertices")
    # rings of equally many vertices are one row, so a zoom's window is short
    counted = rings.groupBy("z", "vertices").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("features"), F.sum("bytes").alias("bytes"), F.sum("repeats").alias("repeats"), F.sum("full").alias("full"))
    total, upto = F.sum("n").over(Window.partitionBy("z")), F.sum("n").over(w)
    at = F.least(total - 1, F.floor(total * 99 / 100))
    marked = counted.withColumn("p99", F.when((upto > at) & (upto - F.col("n") <= at), F.col("vertices")))
    return marked.groupBy("z").agg(
        F.sum("features").alias("features"), F.sum("n").alias("rings"), F.sum("bytes").alias("bytes"), F.sum(F.col("n") * F.col("vertices")).alias("vertices"), F.max("vertices").alias("most"), F.max("p99").alias("p99"), F.sum("repeats").alias("repeats"), F.sum("full").alias("full")
    )


def layer_tallies(tiles: DataFrame, compression: int = GZIP) -> DataFrame:
    """layer, features, points, lines, polygons, vertices of tiles (tile_id, payload); what isn't known is skipped."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            sums: dict[str, list[int]] = {}
            for payload in batch.column("payload").to_pylist():
                for name, features in mvt.decode(inflated(payload, compression), strict=False).items():
                    row = sums.setdefault(name, [0] * 5)
                    for f in features:
                        row[0] += 1
                        row[f.kind] += 1
                        row[4] += sum(map(len, f.parts))
            columns = list(zip(*((k, *v) for k, v in sums.items()), strict=True)) if sums else [[]] * 6
            kinds = [pa.string()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names="layer features points lines polygons vertices".split())

    told = tiles.select("payload").mapInArrow(read, "layer string, features long, points long, lines long, polygons long, vertices long")
    return told.groupBy("layer").agg(*[F.sum(c).alias(c) for c in "features points lines polygons vertices".split()])


def compare_tiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """layer, and each tally on side a and side b, over the tiles that both have."""
    both = a.select("tile_id").join(b.select("tile_id"), "tile_id").distinct()
    sides = [layer_tallies(side.join(both, "tile_id", "left_semi")).select("layer", *[F.col(c).alias(f"{c}_{name}") for c in "features points lines polygons vertices".split()]) for side, name in ((a, "a"), (b, "b"))]
    met = sides[0].join(sides[1], "layer", "full")
    return met.fillna(0)


def rings_dump(tiles: DataFrame, compression: int = GZIP) -> DataFrame:
    """tile_id, layer, feature_id, ring, vertices, area2, simple: each ring of the polygons of tiles, to compare with another engine."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            rows = []
            for tile_id, payload in zip(batch.column("tile_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                for name, features in mvt.decode(inflated(payload, compression), strict=False).items():
                    rows += [(tile_id, name, f.id, k, len(r), int(area2(r)), is_simple(r)) for f in features if f.kind == mvt.POLYGON for k, r in enumerate(f.parts)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names="tile_id layer feature_id ring vertices area2 simple".split())

    return tiles.select("tile_id", "payload").mapInArrow(read, "tile_id long, layer string, feature_id long, ring int, vertices int, area2 long, simple boolean")


def ring_census(tiles: DataFrame, cap: int = RING_CAP, compression: int = GZIP) -> DataFrame:
    """layer, polygons, rings, most, over: how many rings the polygons of tiles have, and how many of them more than ``cap``."""
    rings = rings_dump(tiles, compression).groupBy("layer", "tile_id", "feature_id").agg(F.count(F.lit(1)).alias("rings"))
    return rings.groupBy("layer").agg(F.count(F.lit(1)).alias("polygons"), F.sum("rings").alias("rings"), F.max("rings").alias("most"), F.count_if(F.col("rings") > cap).alias("over"))


def repeated_segments(tiles: DataFrame, layer: str = "boundaries", compression: int = GZIP) -> DataFrame:
    """tile_id, segments, repeated: segments of a layer's lines, either way round, and those that occur more than once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            rows = []
            for tile_id, payload in zip(batch.column("tile_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                lines = [part for f in mvt.decode(inflated(payload, compression), strict=False).get(layer, []) if f.kind == mvt.LINE for part in f.parts]
                counts = Counter(tuple(sorted(s)) for part in lines for s in zip(part[:-1], part[1:], strict=True))
                if counts:
                    rows.append((tile_id, len(counts), sum(n > 1 for n in counts.values())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["tile_id", "segments", "repeated"])

    return tiles.select("tile_id", "payload").mapInArrow(read, "tile_id long, segments long, repeated long")


def ring_table(tile: bytes) -> list[tuple[str, int, int, int, int, str, bool]]:
    """(layer, feature, ring, vertices, doubled area, turn, simple) of a tile's polygons."""
    rows = []
    for name, features in mvt.decode(tile, strict=False).items():
        for k, f in enumerate(features):
            if f.kind == mvt.POLYGON:
                rows += [(name, k, i, len(r), int(area2(r)), "outer" if area2(r) > 0 else "inner", is_simple(r)) for i, r in enumerate(f.parts)]
    return rows
