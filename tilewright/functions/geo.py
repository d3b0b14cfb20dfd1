"""Projection, tile keys and measures as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.schema import EARTH, EXTENT, LAYERS, MAX_LAT, NAMESPACED

#: First id of each zoom: (4^z - 1) / 3.
ZOOM_BASES = [(4**z - 1) // 3 for z in range(16)]
SPLIT_ZOOM = 7
PARTITION_BASES = [sum(4 ** min(k, SPLIT_ZOOM) for k in range(z)) for z in range(16)]
MAX_OSM_ID = (2**53 - 1 - 3) // 10


def merc_x(lon_e7: Column) -> Column:
    return (lon_e7 / 1e7 + 180.0) / 360.0


def merc_y(lat_e7: Column) -> Column:
    lat = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat_e7 / 1e7))
    s = F.sin(F.radians(lat))
    return 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def lat_of(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y))))


def from_metres(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres to the unit square."""
    return x / EARTH + 0.5, 0.5 - y / EARTH


def zigzag(v: Column) -> Column:
    """A signed 32-bit number as the tile format packs it: small sizes first, of either sign."""
    return F.call_function("shiftleft", v.cast("bigint"), F.lit(1)).bitwiseXOR(F.call_function("shiftright", v.cast("bigint"), F.lit(31)))


def command(kind: Column, count: Column) -> Column:
    """A command integer: 1 move, 2 line, 7 close, with its repeats."""
    return F.call_function("shiftleft", count.cast("bigint"), F.lit(3)).bitwiseOR(kind.cast("bigint"))


def simplify_tolerance(z: Column) -> Column:
    """One pixel of a zoom in the unit square."""
    return 1 / (256 * F.pow(F.lit(2.0), z))


def tile_index(p: Column, z: Column) -> Column:
    """Tile number of a unit coordinate, clamped to the world."""
    n = F.pow(F.lit(2.0), z)
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor(p * n))).cast("bigint")


def tile_pixel(p: Column, z: Column, tile: Column) -> Column:
    """Position inside a tile, half away from zero."""
    return F.round((p * F.pow(F.lit(2.0), z) - tile) * EXTENT).cast("bigint")


def hilbert(z: Column, x: Column, y: Column) -> Column:
    """Place of a tile on its zoom's Hilbert curve, without the zoom's base."""
    start = F.struct(F.lit(0).cast("bigint").alias("d"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), z.cast("int")) - 1

    def step(a: Column, i: Column) -> Column:
        low = z.cast("int") - i.cast("int")
        bit = lambda v: F.call_function("shiftright", v, low).bitwiseAND(F.lit(1).cast("bigint"))
        rx, ry = bit(a["x"]), bit(a["y"])
        turned = lambda v: F.when(rx == 1, side - v).otherwise(v)
        d = a["d"] + F.call_function("shiftleft", (3 * rx).bitwiseXOR(ry), 2 * low)
        nx = F.when(ry == 0, turned(a["y"])).otherwise(a["x"])
        ny = F.when(ry == 0, turned(a["x"])).otherwise(a["y"])
        return F.struct(d.alias("d"), nx.alias("x"), ny.alias("y"))

    steps = F.filter(F.sequence(F.lit(1), F.greatest(z.cast("int"), F.lit(1))), lambda i: i <= z)
    return F.aggregate(steps, start, step)["d"]


def hilbert_at(z: int, x: Column, y: Column) -> Column:
    """Place of a tile on the curve of a fixed zoom."""
    return hilbert(F.lit(z), x, y)


def zoom_base(z: Column) -> Column:
    return ((F.pow(F.lit(4.0), z) - 1) / 3).cast("bigint")


def tile_id(z: Column, x: Column, y: Column) -> Column:
    return zoom_base(z) + hilbert(z, x, y)


def zoom_of(tile: Column) -> Column:
    found = F.when(tile < ZOOM_BASES[1], F.lit(0))
    for z in range(1, 15):
        found = found.when(tile < ZOOM_BASES[z + 1], F.lit(z))
    return found


def tile_xy(tile: Column) -> Column:
    """struct(z, x, y) of a tile id: the curve walked from its finest square."""
    z = zoom_of(tile)
    local = tile - zoom_base(z)
    zero = F.lit(0).cast("bigint")
    start = F.struct(local.alias("t"), zero.alias("x"), zero.alias("y"))

    def step(a: Column, i: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("bigint"), (i - 1).cast("int"))
        rx = F.call_function("shiftright", a["t"], F.lit(1)).bitwiseAND(F.lit(1).cast("bigint"))
        ry = a["t"].bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("bigint"))
        flip = lambda v: F.when(rx == 1, s - 1 - v).otherwise(v)
        x = F.when(ry == 0, flip(a["y"])).otherwise(a["x"]) + s * rx
        y = F.when(ry == 0, flip(a["x"])).otherwise(a["y"]) + s * ry
        return F.struct(F.call_function("shiftright", a["t"], F.lit(2)).alias("t"), x.alias("x"), y.alias("y"))

    steps = F.filter(F.sequence(F.lit(1), F.greatest(z, F.lit(1))), lambda i: i <= z)
    end = F.aggregate(steps, start, step)
    return F.struct(z.alias("z"), end["x"].alias("x"), end["y"].alias("y"))


def sort_key(tile: Column, layer: Column, rank: Column) -> Column:
    return tile * 65536 + layer * 256 + rank


def partition_of(tile: Column) -> Column:
    """Hilbert range bucket: the curve's prefix at zoom 7."""
    z = zoom_of(tile)
    base = F.element_at(F.array(*[F.lit(b) for b in PARTITION_BASES]), z + 1)
    deep = F.greatest(z - SPLIT_ZOOM, F.lit(0))
    return base + F.floor((tile - zoom_base(z)) / F.pow(F.lit(4.0), deep)).cast("bigint")


def feature_id(layer: Column, source: Column, osm_id: Column) -> Column:
    """The id in the archive; source: 1 node, 2 way, 3 relation."""
    return F.when(layer.isin(*NAMESPACED), osm_id * 10 + source).otherwise(osm_id)


def unwrapped_step(now: Column, before: Column) -> Column:
    """Worlds to add when a step crosses the antimeridian."""
    return F.when(now - before > 0.5, F.lit(-1)).when(now - before < -0.5, F.lit(1)).otherwise(F.lit(0))


LAYER_ROWS = [(x.id, x.name, x.floor, x.capped, x.kinds) for x in LAYERS]
