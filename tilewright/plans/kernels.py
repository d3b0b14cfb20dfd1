"""Queries whose geometry runs in kernels, in Arrow batches, one call a feature."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright import bridge as B
from tilewright.kernels import batches as KB
from tilewright.kernels import lines as L
from tilewright.kernels import polygons as P
from tilewright.kernels import rings as K
from tilewright.operators import archive as AR
from tilewright.operators import build as BU
from tilewright.operators import inspect as IN
from tilewright.operators import ocean as OC
from tilewright.operators import regress as RG
from tilewright.plans import build as PB
from tilewright.plans import oracles as O
from tilewright.plans import tiles as T
from tilewright.plans.registry import query
from tilewright.schema import BUFFER, EXTENT
from tilewright.sources import files, mvt, pmtiles
from tilewright.sources.osm_pbf import register

EVERYTHING = BU.Options()


def geometry(spark: SparkSession, d: str, pinned: bool = False) -> DataFrame:
    """way, closed, xs, ys and, where asked for, pins of all ways."""
    return PB.geometry(spark, d, pinned=pinned).withColumnRenamed("id", "way")


def ring_of(row) -> list[tuple[float, float]]:
    return list(zip(map(float, row.xs[:-1]), map(float, row.ys[:-1]), strict=True))


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _rows(df: DataFrame, f, schema: str) -> DataFrame:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            rows = [r for row in batch.to_pandas().itertuples(index=False) for r in f(row)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ARROW[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return df.mapInArrow(run, schema)


@query()
def simplify_lines(spark: SparkSession, d: str) -> DataFrame:
    """Vertices kept at each zoom below 14, shared nodes always."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches, 2000):
            (xs, offsets), (ys, _), (pins, _) = (BU.flat(batch.column(c), k) for c, k in (("xs", float), ("ys", float), ("pins", bool)))
            n = batch.num_rows
            walked = KB.chains(xs, ys, pins, offsets, batch.column("closed").to_numpy(zero_copy_only=False))
            line = np.repeat(np.arange(n), np.diff(walked.offsets))
            kept = [np.bincount(line[walked.over > P.grid_tolerance(z) ** 2], minlength=n) for z in range(14)]
            columns = [np.tile(batch.column("way").to_numpy(), 14), np.repeat(np.arange(14), n), np.tile(np.diff(offsets), 14), np.concatenate(kept)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["way", "z", "points", "kept"])

    return geometry(spark, d, pinned=True).mapInArrow(run, "way long, z int, points int, kept int")


@query()
def clip_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of each way in every buffered zoom-14 tile that it crosses."""

    def clip(row):
        n = 1 << 14
        points = [(float(a) * n, float(b) * n) for a, b in zip(row.xs, row.ys, strict=True)]
        return [(row.way, x, y, len(pieces), sum(map(len, pieces))) for x, y, pieces in L.line_tiles(points, 14, BUFFER / EXTENT)]

    return _rows(geometry(spark, d), clip, "way long, x int, y int, pieces int, points int")


def measured(rows: DataFrame, kind: int) -> DataFrame:
    """Features of one kind with their parts and points, from the packed geometry's length."""
    parts = F.conv(F.hex(F.reverse(F.substring("geom", 1, 4))), 16, 10).cast("int")
    points = ((F.octet_length("geom") / 4 - 1 - F.col("parts")) / 2).cast("int")
    return BU.spread(rows.filter(F.col("kind") == kind)).withColumn("parts", parts).select("feature_id", "layer", "tile_id", "parts", points.alias("points"))


@query()
def emit_lines(spark: SparkSession, d: str) -> DataFrame:
    """A row for each piece of a matched way in a tile, from its layer's own first zoom on."""
    return PB.way_rows(spark, d, EVERYTHING, mvt.LINE).drop("parts")


@query()
def emit_polygons(spark: SparkSession, d: str) -> DataFrame:
    """A row for each shape of a matched closed way in a tile; what crosses itself is resolved."""
    return PB.way_rows(spark, d, EVERYTHING, mvt.POLYGON).withColumnRenamed("parts", "rings")


@query()
def emit_multipolygons(spark: SparkSession, d: str) -> DataFrame:
    """A row for each shape of a matched area relation in a tile, holes included."""
    return PB.relation_rows(spark, d, EVERYTHING, mvt.POLYGON).withColumnRenamed("parts", "rings")


@query()
def normalized_rings(spark: SparkSession, d: str) -> DataFrame:
    """Shapes, rings and doubled area on the zoom-14 grid of what each closed way covers."""

    def resolve(row):
        shapes = P.shape_on_grid([ring_of(row)])
        return [(row.way, len(shapes), sum(map(len, shapes)), sum(int(K.area2(r)) for s in shapes for r in s))]

    return _rows(geometry(spark, d).filter("closed"), resolve, "way long, shapes int, rings int, area2 long")


@query()
def point_on_surface(spark: SparkSession, d: str) -> DataFrame:
    """A label point inside each closed way that has an inside."""

    def label(row):
        ring = ring_of(row)
        p = K.point_on_surface([ring])
        return [(row.way, p[0], p[1], K.inside(p, ring))] if p else []

    return _rows(geometry(spark, d).filter("closed"), label, "way long, x double, y double, inside boolean")


def relation_shapes(spark: SparkSession, d: str) -> DataFrame:
    """id, members as (role, xs, ys) lists: sixteen ways a relation at most."""
    m = B.relations(spark, d).filter("kind = 'area'").select("id", "way", "role")
    return m.join(geometry(spark, d).select("way", "xs", "ys"), "way").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("way", "role", "xs", "ys"))).alias("members"))


@query()
def assemble_multipolygons(spark: SparkSession, d: str) -> DataFrame:
    """Shapes, holes, chains that don't close and the area of each area relation."""

    def build(row):
        shapes, dropped = BU.shapes_of(row.members)
        return [(row.id, len(shapes), sum(len(s) - 1 for s in shapes), dropped, K.area_and_centroid(shapes)[0])]

    return _rows(relation_shapes(spark, d), build, "id long, shapes int, holes int, dropped int, area double")


@query()
def relation_labels(spark: SparkSession, d: str) -> DataFrame:
    """One label of each kind for each relation: the centroid of all, and a point on the largest shape."""

    def label(row):
        shapes, _ = BU.shapes_of(row.members)
        return [(row.id, how, *p) for how in ("centroid", "convex", "surface") if (p := K.label_point(shapes, how))]

    return _rows(relation_shapes(spark, d), label, "id long, how string, x double, y double")


@query()
def line_merge(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a block chained where two ends meet."""
    g = geometry(spark, d).filter("NOT closed").withColumn("block", F.floor(F.col("way") / 16))
    g = g.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("way", "xs", "ys"))).alias("lines"))  # sixteen ways at most

    def chain(row):
        lines = [list(zip(map(float, m["xs"]), map(float, m["ys"]), strict=True)) for m in row.lines]
        lines = [x for x in lines if len(x) > 1]
        merged = L.merge_lines(lines)
        return [(row.block, len(lines), len(merged), sum(map(len, merged)))]

    return _rows(g, chain, "block long, lines int, merged int, points int")


def local_tiles(spark: SparkSession, d: str) -> DataFrame:
    """tile_id, features, payload: each block of sixteen ways as one compressed tile, on the block's own 8 by 8 lattice."""
    v = B.flat_vertices(spark, d).withColumn("k", F.col("node") % 10000)
    at = F.struct("pos", ((F.col("k") % 8) * 512).cast("int").alias("x"), (F.floor(F.col("k") / 8) * 512).cast("int").alias("y"))
    ways = v.groupBy("way", "closed").agg(F.array_sort(F.collect_list(at)).alias("p")).withColumn("tile_id", F.floor(F.col("way") / 16))
    ways = B.dealt(ways, "tile_id", B.vertex_bytes(spark, d))
    g = ways.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("way", "closed", "p"))).alias("ways"))

    def encode(row):
        layers: dict[str, list[mvt.Feature]] = {}
        for m in row.ways:
            part = [(p["x"], p["y"]) for p in m["p"]]
            kind = mvt.POLYGON if m["closed"] else mvt.LINE
            layers.setdefault("land" if m["closed"] else "streets", []).append(mvt.Feature(kind, [part], {"kind": "way", "even": m["way"] % 2 == 0, "n": len(part)}, m["way"]))
        raw = b"".join(mvt.encode_layer(name, f) for name, f in sorted(layers.items()))
        return [(row.tile_id, sum(map(len, layers.values())), gzip.compress(raw, 6, mtime=0))]

    return _rows(g, encode, "tile_id long, features int, payload binary")


@query(
    f"""WITH {O.FV}, c AS (
  SELECT way, way // 16 AS tile_id, pos, node % 10000 AS k, closed, lag(node % 10000) OVER (PARTITION BY way ORDER BY pos) AS before FROM fv
), f AS (  -- repeated points go, and a ring's closing vertex
  SELECT tile_id, way, closed, count(*) - CASE WHEN closed AND count(*) > 1 THEN 1 ELSE 0 END AS points FROM c WHERE before IS NULL OR before <> k GROUP BY tile_id, way, closed
)
SELECT tile_id, count(*)::INT AS given, count(*) FILTER (WHERE points >= CASE WHEN closed THEN 3 ELSE 2 END)::INT AS features,
       coalesce(sum(points) FILTER (WHERE points >= CASE WHEN closed THEN 3 ELSE 2 END), 0)::INT AS points FROM f GROUP BY tile_id"""
)
def mvt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Tiles encoded and strictly decoded again: lines under two points and rings under three vanish, all others stay."""

    def decode(row):
        layers = mvt.decode(gzip.decompress(row.payload))
        features = [f for fs in layers.values() for f in fs]
        return [(row.tile_id, row.features, len(features), sum(len(p) for f in features for p in f.parts))]

    return _rows(local_tiles(spark, d), decode, "tile_id long, given int, features int, points int")


LATTICE = f"""WITH {O.FV}, c AS (
  SELECT way, way // 16 AS tile_id, pos, node % 10000 AS k, closed, lag(node % 10000) OVER (PARTITION BY way ORDER BY pos) AS before,
         lead(node % 10000) OVER (PARTITION BY way ORDER BY pos) AS after FROM fv
), f AS (
  SELECT tile_id, way, closed, count(*) FILTER (WHERE before IS NULL OR before <> k) - CASE WHEN closed AND count(*) FILTER (WHERE before IS NULL OR before <> k) > 1 THEN 1 ELSE 0 END AS points,
         sum(CASE WHEN after IS NOT NULL THEN (k % 8) * (after // 8) - (after % 8) * (k // 8) ELSE 0 END) * 262144 AS area2
  FROM c GROUP BY tile_id, way, closed
), g AS (SELECT * FROM f WHERE points >= CASE WHEN closed THEN 3 ELSE 2 END)"""


@query(
    f"""{LATTICE}, s AS (SELECT CASE WHEN closed THEN 'land' ELSE 'streets' END AS layer, closed, points, tile_id % 11 <> 0 AS on_b FROM g
), t AS (SELECT tile_id FROM g GROUP BY tile_id HAVING tile_id % 11 <> 0)
SELECT layer, count(*) AS features_a, 0::BIGINT AS points_a, count(*) FILTER (WHERE NOT closed) AS lines_a, count(*) FILTER (WHERE closed) AS polygons_a, sum(points)::BIGINT AS vertices_a,
       count(*) AS features_b, 0::BIGINT AS points_b, count(*) FILTER (WHERE NOT closed) AS lines_b, count(*) FILTER (WHERE closed) AS polygons_b, sum(points)::BIGINT AS vertices_b FROM s WHERE on_b GROUP BY layer"""
)
def compare_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Layers of two sets of tiles over the tiles that both have; one lacks every eleventh."""
    tiles = local_tiles(spark, d)
    return IN.compare_tiles(tiles, tiles.filter("tile_id % 11 <> 0"))


@query(f"{LATTICE} SELECT tile_id, 'land' AS layer, way AS feature_id, 0::INT AS ring, points::INT AS vertices, area2::BIGINT AS area2 FROM g WHERE closed")
def rings_dump(spark: SparkSession, d: str) -> DataFrame:
    """Rings of encoded tiles as an engine reads them."""
    return IN.rings_dump(local_tiles(spark, d)).drop("simple")


@query(f"{LATTICE} SELECT 'land' AS layer, count(*) AS polygons, count(*)::BIGINT AS rings, 1::BIGINT AS most, 0::BIGINT AS over FROM g WHERE closed HAVING count(*) > 0")
def ring_census(spark: SparkSession, d: str) -> DataFrame:
    """Rings of the polygons of encoded tiles against the cap."""
    return IN.ring_census(local_tiles(spark, d))


@query(
    f"""{LATTICE}, sg AS (SELECT c.tile_id, least(k, after) AS p, greatest(k, after) AS q FROM c JOIN g USING (way) WHERE NOT c.closed AND after IS NOT NULL AND after <> k
), sc AS (SELECT tile_id, p, q, count(*) AS n FROM sg GROUP BY ALL)
SELECT tile_id, count(*) AS segments, count(*) FILTER (WHERE n > 1) AS repeated FROM sc GROUP BY tile_id"""
)
def repeated_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments that the lines of a tile draw more than once."""
    return IN.repeated_segments(local_tiles(spark, d), "streets")


def local_archive(spark: SparkSession, tiles: DataFrame, name: str) -> DataFrame:
    """Tiles written to an archive and read back as its runs."""
    register(spark)
    path = f"{files.scratch(spark, name)}/tiles.pmtiles"
    AR.write(tiles.select("tile_id", "payload"), path, pmtiles.metadata(name))
    return spark.read.format("pmtiles").load(path)


ZOOM = "floor(log2(3 * tile_id + 1) / 2)::INT"


@query(
    f"""{LATTICE}, tl AS (SELECT tile_id, {ZOOM} AS z, bool_or(closed) AS land, bool_or(NOT closed) AS street, bool_or(closed AND area2 = 0) AS flat FROM g GROUP BY tile_id
), fi AS (
  SELECT 'undeclared attribute' AS finding, z, tile_id FROM tl
  UNION ALL SELECT 'layer below its first zoom', z, tile_id FROM tl WHERE land AND z < 7 OR street AND z < 5
  UNION ALL SELECT 'flat ring', z, tile_id FROM tl WHERE flat)
SELECT finding, z, count(*) AS tiles, min(tile_id) AS first FROM fi GROUP BY finding, z"""
)
def verify_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Findings of an archive whose tiles stand below their layers' zooms, with attributes that no layer declares."""
    return IN.verify_table(local_archive(spark, local_tiles(spark, d), "verify"))


@query(f"{LATTICE}, tl AS (SELECT DISTINCT tile_id, CASE WHEN closed THEN 'land' ELSE 'streets' END AS layer FROM g WHERE tile_id % 11 = 0) SELECT {ZOOM} AS z, layer, 'layer_removed' AS outcome, count(*) AS n FROM tl GROUP BY 1, 2")
def regress_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Differences of two archives by zoom and layer; the second lacks every eleventh tile and packs the others anew."""
    tiles = local_tiles(spark, d)
    packed = RG.mutated(tiles.filter("tile_id % 11 <> 0"), "regzip", 7)
    return RG.regress(local_archive(spark, tiles, "baseline"), local_archive(spark, packed, "current"))


RING_EDGES = f"""{LATTICE}, r0 AS (
  SELECT way, k, pos, row_number() OVER (PARTITION BY way ORDER BY pos) - 1 AS i FROM c JOIN g USING (way) WHERE c.closed AND (before IS NULL OR before <> k)
), r AS (SELECT r0.way, i, k % 8 AS x, k // 8 AS y, points AS n FROM r0 JOIN g USING (way) WHERE i < points
), e AS (SELECT p.way, p.i, p.n, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM r p JOIN r q ON p.way = q.way AND q.i = (p.i + 1) % p.n
), t AS (
  SELECT e.way, (e.x1 - e.x0) * (f.y0 - e.y0) - (e.y1 - e.y0) * (f.x0 - e.x0) AS s, (e.x1 - e.x0) * (f.y1 - e.y0) - (e.y1 - e.y0) * (f.x1 - e.x0) AS t,
         (f.x1 - f.x0) * (e.y0 - f.y0) - (f.y1 - f.y0) * (e.x0 - f.x0) AS u, (f.x1 - f.x0) * (e.y1 - f.y0) - (f.y1 - f.y0) * (e.x1 - f.x0) AS v,
         f.x0 BETWEEN least(e.x0, e.x1) AND greatest(e.x0, e.x1) AND f.y0 BETWEEN least(e.y0, e.y1) AND greatest(e.y0, e.y1) AS on_c,
         f.x1 BETWEEN least(e.x0, e.x1) AND greatest(e.x0, e.x1) AND f.y1 BETWEEN least(e.y0, e.y1) AND greatest(e.y0, e.y1) AS on_d,
         e.x0 BETWEEN least(f.x0, f.x1) AND greatest(f.x0, f.x1) AND e.y0 BETWEEN least(f.y0, f.y1) AND greatest(f.y0, f.y1) AS on_a,
         e.x1 BETWEEN least(f.x0, f.x1) AND greatest(f.x0, f.x1) AND e.y1 BETWEEN least(f.y0, f.y1) AND greatest(f.y0, f.y1) AS on_b
  FROM e JOIN e f ON e.way = f.way AND f.i >= e.i + 2 AND NOT (e.i = 0 AND f.i = e.n - 1)
), crossed AS (
  SELECT way, count(*) AS meets FROM t WHERE s * t < 0 AND u * v < 0 OR s = 0 AND on_c OR t = 0 AND on_d OR u = 0 AND on_a OR v = 0 AND on_b GROUP BY way
), turns AS (
  SELECT p.way, count(DISTINCT sign((p.x1 - p.x0) * (q.y1 - q.y0) - (p.y1 - p.y0) * (q.x1 - q.x0))) FILTER (WHERE (p.x1 - p.x0) * (q.y1 - q.y0) <> (p.y1 - p.y0) * (q.x1 - q.x0)) AS turns
  FROM e p JOIN e q ON p.way = q.way AND q.i = (p.i + 1) % p.n GROUP BY p.way
), steps AS (SELECT way, i, 'x' AS axis, sign(x1 - x0) AS d FROM e WHERE x1 <> x0 UNION ALL SELECT way, i, 'y', sign(y1 - y0) FROM e WHERE y1 <> y0
), flips AS (
  SELECT way, axis, count(*) FILTER (WHERE d <> before) AS flips FROM (
    SELECT *, coalesce(lag(d) OVER (PARTITION BY way, axis ORDER BY i), last(d) OVER (PARTITION BY way, axis ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM steps) GROUP BY way, axis
), bent AS (SELECT way, bool_and(flips = 2) AND count(*) = 2 AS fair FROM flips GROUP BY way)"""


@query(f"{RING_EDGES} SELECT g.way AS feature_id, coalesce(meets, 0) = 0 AS simple, turns = 1 AND coalesce(fair, false) AS convex FROM g LEFT JOIN crossed USING (way) JOIN turns USING (way) LEFT JOIN bent USING (way) WHERE closed")
def lattice_rings(spark: SparkSession, d: str) -> DataFrame:
    """Whether the rings of encoded tiles are simple and convex."""

    def judge(row):
        features = mvt.decode(gzip.decompress(row.payload)).get("land", [])
        return [(f.id, K.is_simple(f.parts[0]), K.is_convex(f.parts[0])) for f in features]

    return _rows(local_tiles(spark, d), judge, "feature_id long, simple boolean, convex boolean")


@query(f"{T.RUNS} SELECT start_id, run_length, length, digest FROM ra JOIN bl USING (digest)")
def archive_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """An archive written in parts by tile range and read back through the data source."""
    register(spark)
    path = f"{files.scratch(spark, 'roundtrip')}/tiles.pmtiles"
    AR.write(T.tiles(spark, d).withColumn("payload", F.col("payload").cast("binary")), path, pmtiles.metadata("roundtrip"))
    back = spark.read.format("pmtiles").load(path)
    return back.select("start_id", "run_length", "length", F.sha2("payload", 256).alias("digest"))


RECTS = """rc AS (SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT * 7 % 200 AS x0, n_nationkey::BIGINT * 11 % 200 AS y0 FROM nation
), rt AS (SELECT id, 8::BIGINT AS z, x, y FROM rc, range(256) a(x), range(256) b(y) WHERE x BETWEEN x0 AND x0 + 37 AND y BETWEEN y0 AND y0 + 21)"""


@query(f"WITH RECURSIVE {RECTS}, {O.hilbert('rt')}, pl AS (SELECT id, d, d - row_number() OVER (PARTITION BY id ORDER BY d) AS g FROM rt JOIN hid ON rt.x = hid.x AND rt.y = hid.y) SELECT id, min(d) AS first, count(*) AS tiles FROM pl GROUP BY id, g")
def rect_to_hilbert_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of zoom-8 tile places in one rectangle for each nation."""
    n = B.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return _rows(n, lambda r: [(r.id, a, b) for a, b in P.hilbert_ranges(8, r.id * 7 % 200, r.id * 11 % 200, r.id * 7 % 200 + 37, r.id * 11 % 200 + 21, P.curve_place)], "id long, first long, tiles long")


@query()
def ocean_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of the sea to zoom 9: by zoom, features, rings, points and covered tiles."""
    rows = measured(OC.features(PB.sea_pieces(spark, d), (0, 9)), mvt.POLYGON)
    z = F.floor(F.log2(3.0 * F.col("tile_id") + 1) / 2).cast("int").alias("z")
    return rows.groupBy(z).agg(F.count(F.lit(1)).alias("features"), F.count_distinct("tile_id").alias("tiles"), F.sum("parts").alias("rings"), F.sum("points").alias("points"), F.count_if(F.col("feature_id") == OC.FULL_ID).alias("full"))


RECTANGLES = """rs AS (SELECT n_nationkey::BIGINT AS piece, (n_nationkey * 41 % 200) / 256.0 + 1 / 1024.0 AS x0, (n_nationkey * 53 % 200) / 256.0 + 1 / 1024.0 AS y0 FROM nation
), rz AS (SELECT *, x0 + 5 / 128.0 AS x1, y0 + 3 / 128.0 AS y1, z FROM rs, range(8, 11) t(z)
), rx AS (SELECT piece, z, x, y, x0, y0, x1, y1, 1::BIGINT << z AS n FROM rz, range(1024) a(x), range(1024) b(y)
          WHERE x < 1::BIGINT << z AND y < 1::BIGINT << z AND (x + 1 + 1 / 32.0) / (1::BIGINT << z) > x0 AND (x - 1 / 32.0) / (1::BIGINT << z) < x1
            AND (y + 1 + 1 / 32.0) / (1::BIGINT << z) > y0 AND (y - 1 / 32.0) / (1::BIGINT << z) < y1)"""


@query(f"WITH {RECTANGLES} SELECT piece, z::INT AS z, count(*) AS tiles, count(*) FILTER (WHERE (x - 1 / 32.0) / n >= x0 AND (x + 1 + 1 / 32.0) / n <= x1 AND (y - 1 / 32.0) / n >= y0 AND (y + 1 + 1 / 32.0) / n <= y1) AS full_tiles FROM rx GROUP BY piece, z")
def ocean_rectangles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of one rectangle of sea for each nation at zooms 8 to 10, and those covered whole."""
    n = B.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("piece"))
    x0, y0 = ((F.col("piece") * k % 200) / 256.0 + 1 / 1024.0 for k in (41, 53))
    corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    w, h = 5 / 128.0, 3 / 128.0
    pieces = n.select("piece", F.array(F.array(corner(0, 0), corner(w, 0), corner(w, h), corner(0, h), corner(0, 0))).alias("rings"))
    rows = BU.spread(OC.features(pieces, (8, 10)))
    z = F.floor(F.log2(3.0 * F.col("tile_id") + 1) / 2).cast("int").alias("z")
    xs = F.col("feature_id")
    # a covered tile names no piece: its piece is found by its place, as rectangles are told apart by their tiles alone
    return placed_pieces(rows.select("tile_id", z, (xs == OC.FULL_ID).alias("is_full"), xs.alias("piece")), n)


def placed_pieces(rows: DataFrame, nations: DataFrame) -> DataFrame:
    """Counts by rectangle and zoom; a covered tile counts for every rectangle that covers its cell."""
    from tilewright.functions import geo as G

    at = rows.withColumn("t", G.tile_xy(F.col("tile_id")))
    at = at.withColumn("x", F.col("t.x")).withColumn("y", F.col("t.y"))
    own = at.filter("NOT is_full").groupBy("piece", "z").agg(F.count_distinct("tile_id").alias("part"))
    pad, n = 1 / 32.0, F.pow(F.lit(2.0), F.col("z"))
    x0, y0 = ((F.col("nation") * k % 200) / 256.0 + 1 / 1024.0 for k in (41, 53))
    w, h = 5 / 128.0, 3 / 128.0
    covers = ((F.col("x") - pad) / n >= x0) & ((F.col("x") + 1 + pad) / n <= x0 + w) & ((F.col("y") - pad) / n >= y0) & ((F.col("y") + 1 + pad) / n <= y0 + h)
    full = at.filter("is_full").select("tile_id", "z", "x", "y").distinct().join(F.broadcast(nations.withColumnRenamed("piece", "nation")), covers)  # 25 nations
    full = full.groupBy(F.col("nation").alias("piece"), "z").agg(F.count(F.lit(1)).alias("full_tiles"))
    got = own.join(full, ["piece", "z"], "full").fillna(0, ["part", "full_tiles"])
    return got.select("piece", "z", (F.col("part") + F.col("full_tiles")).alias("tiles"), "full_tiles")
