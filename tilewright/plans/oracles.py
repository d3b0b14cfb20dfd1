"""Oracle SQL for DuckDB, written from the semantics and not from the Spark expressions."""

from __future__ import annotations

from tilewright import schema as S
from tilewright.bridge import NODE_CASES, WAY_CASES


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def cases(name: str, rows: list[str]) -> str:
    listed = ", ".join(f"({k}, {quoted([s])})" for k, s in enumerate(rows))
    return f"""{name} AS (
  SELECT idx, map_from_entries(list_transform(string_split(s, '|'), lambda e: {{'k': split_part(e, '=', 1), 'v': split_part(e, '=', 2)}})) AS tags
  FROM (VALUES {listed}) AS c(idx, s))"""


PTS = f"""{cases("ncase", NODE_CASES)}, pts AS (
  SELECT id, key, (key * 7919 % 36000) * 100000 - 1800000000 AS lon_e7, (key * 104729 % 16000) * 100000 - 800000000 AS lat_e7, tags
  FROM (SELECT c_custkey AS key, c_custkey AS id FROM customer UNION ALL SELECT event_id, event_id + 10000000 FROM events) k
  JOIN ncase ON key % {len(NODE_CASES)} = idx)"""

WV = """wv AS (
  SELECT way, ln, k, b * 10000 + k AS node,
         CASE WHEN b % 97 = 0 THEN CASE WHEN e > 1800000000 THEN e - 3600000000 ELSE e END
              ELSE ((b * 7919) % 3400) * 1000000 - 1700000000 + (k % 8) * 60000 END AS lon_e7,
         ((b * 104729) % 1400) * 1000000 - 700000000 + (k // 8) * 60000 AS lat_e7
  FROM (SELECT l_orderkey AS way, l_linenumber::BIGINT AS ln, l_orderkey // 16 AS b, l_partkey % 64 AS k, 1799800000 + (l_partkey % 64 % 8) * 60000 AS e FROM lineitem))"""

WAYS = f"""{cases("wcase", WAY_CASES)}, {WV}, wn AS (
  SELECT way, count(*) AS n FROM wv GROUP BY way
), ways AS (
  SELECT o_orderkey AS id, tags, coalesce(n, 0) AS n, o_orderstatus = 'F' AND coalesce(n, 0) >= 3 AS closed
  FROM orders JOIN wcase ON o_orderkey % {len(WAY_CASES)} = idx LEFT JOIN wn ON way = o_orderkey)"""

FV = f"""{WV}, fv0 AS (
  SELECT way, row_number() OVER (PARTITION BY way ORDER BY ln, k) - 1 AS pos, node, lon_e7, lat_e7, count(*) OVER (PARTITION BY way) AS n FROM wv
), fv1 AS (SELECT fv0.*, o_orderstatus = 'F' AND n >= 3 AS closed FROM fv0 JOIN orders ON o_orderkey = way
), fv AS (
  SELECT way, pos, node, lon_e7, lat_e7, closed FROM fv1
  UNION ALL SELECT way, n, node, lon_e7, lat_e7, closed FROM fv1 WHERE closed AND pos = 0)"""

RELS = """rels AS (
  SELECT o_orderkey // 16 AS id, 'area' AS kind, NULL::INT AS admin_level, false AS disputed, o_orderkey AS way, ['outer', 'inner', ''][(o_orderkey % 3 + 1)::INT] AS role FROM orders
  UNION ALL SELECT n_nationkey::BIGINT + 1000000000, 'admin', 4, n_nationkey % 5 = 0, o_orderkey, 'outer' FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 4 <> 0
  UNION ALL SELECT n_regionkey::BIGINT + 2000000000, 'admin', 2, n_nationkey % 5 = 0, o_orderkey, 'outer' FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 10 = 0)"""

FOLD = """fold AS (SELECT way, min(admin_level) AS lv, bool_or(disputed) AS dis FROM rels WHERE kind = 'admin' GROUP BY way)"""

X = "((lon_e7 / 1e7 + 180.0) / 360.0)"
SIN = f"sin(radians(greatest(-{S.MAX_LAT}, least({S.MAX_LAT}, lat_e7 / 1e7))))"
Y = f"(0.5 - ln((1 + {SIN}) / (1 - {SIN})) / (4 * pi()))"


def tile(p: str, z: str) -> str:
    return f"greatest(0, least((1 << {z}) - 1, floor({p} * (1 << {z}))))::BIGINT"


def hilbert(source: str) -> str:
    """CTEs h and hid(z, x, y, d) for the distinct tiles of ``source``."""
    return f"""h0 AS (SELECT DISTINCT z::BIGINT AS z, x, y FROM {source}
), h AS (
  SELECT z, x, y, z - 1 AS s, 0::BIGINT AS d, x AS cx, y AS cy FROM h0
  UNION ALL
  SELECT z, x, y, s - 1, d + (xor(3 * rx, ry) << (2 * s)),
         CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN (1::BIGINT << z) - 1 - cy ELSE cy END ELSE cx END,
         CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN (1::BIGINT << z) - 1 - cx ELSE cx END ELSE cy END
  FROM (SELECT *, (cx >> s) & 1 AS rx, (cy >> s) & 1 AS ry FROM h WHERE s >= 0)
), hid AS (SELECT z, x, y, d, ((1::BIGINT << (2 * z)) - 1) // 3 + d AS tile_id FROM h WHERE s = -1)"""


def one_of(expression: str, values) -> str:
    return f"{expression} IN ({quoted(values)})"


def choose(rows, column: int, default: str = "NULL") -> str:
    lines = " ".join(f"WHEN tags['{r[0]}'] = {quoted([r[1]])} THEN {r[column] if isinstance(r[column], int) else quoted([r[column]])}" for r in rows)
    return f"CASE {lines} ELSE {default} END"


def by_value(expression: str, groups: dict, default: str = "NULL") -> str:
    lines = " ".join(f"WHEN {one_of(expression, v)} THEN {k}" for k, v in groups.items())
    return f"CASE {lines} ELSE {default} END"


NAMED = "coalesce(tags['name'], '') <> ''"
TUNNEL = f"(coalesce(tags['tunnel'] IN ({quoted(S.TUNNELS)}), false) OR coalesce(tags['covered'] = 'yes', false))"
BRIDGE = f"coalesce(tags['bridge'] IN ({quoted(S.BRIDGES)}), false)"
POI = "(" + " OR ".join(f"coalesce(tags['{k}'] IN ({quoted(v)}), false)" for k, v in S.POIS.items()) + ")"
POI_VALUE = "CASE " + " ".join(f"WHEN tags['{k}'] IN ({quoted(v)}) THEN " + ("'pass'" if k == "mountain_pass" else f"tags['{k}']") for k, v in S.POIS.items()) + " END"


def select(source: str, layer: str, where: str, zoom: str, kind: str, rank: str = "0") -> str:
    return f"SELECT id, {S.LAYER_ID[layer]} AS layer, ({zoom})::INT AS min_zoom, {kind} AS kind, ({rank})::INT AS paint_rank FROM {source} WHERE {where}"


def address_and_poi(source: str) -> list[str]:
    return [
        select(source, "addresses", f"(tags['addr:housenumber'] IS NOT NULL OR tags['addr:housename'] IS NOT NULL) AND NOT {POI}", "14", "NULL::VARCHAR"),
        select(source, "public_transport", f"({choose(S.PUBLIC_TRANSPORT, 2)}) IS NOT NULL", choose(S.PUBLIC_TRANSPORT, 3), choose(S.PUBLIC_TRANSPORT, 2)),
        select(source, "pois", POI, "14", POI_VALUE),
    ]


def node_layers(source: str) -> str:
    p = "tags['place']"
    kind = f"CASE WHEN {p} = 'city' AND tags['capital'] = 'yes' THEN 'capital' WHEN {p} = 'city' AND tags['capital'] = '4' THEN 'state_capital' ELSE {p} END"
    zoom = f"CASE WHEN tags['capital'] = 'yes' AND {p} IN ('city', 'town', 'village', 'hamlet') THEN 4 WHEN tags['capital'] = '4' AND {p} = 'city' THEN 4 WHEN {p} = 'city' THEN 6 WHEN {p} = 'town' THEN 7 ELSE 10 END"
    rows = [select(source, "place_labels", f"{NAMED} AND {one_of(p, [x for x, _, _ in S.PLACES])}", zoom, kind)]
    rows += [select(source, "street_labels_points", "tags['highway'] = 'motorway_junction'", "12", "'motorway_junction'")]
    return " UNION ALL ".join(rows + address_and_poi(source))


def line_layers(source: str) -> str:
    """Layers of open and closed ways; source has lv and dis."""
    w = "tags['waterway']"
    raw = choose([(k, v, v) for k, v, _, _ in S.STREETS], 2)
    cls = f"regexp_replace({raw}, '_link$', '')"
    zoom = f"CASE WHEN ({raw}) IN ('rail', 'narrow_gauge') AND coalesce(tags['service'], '') <> '' THEN 8 ELSE {choose([(k, v, z) for k, v, z, _ in S.STREETS], 2)} END"
    level = f"CASE WHEN {TUNNEL} THEN 0 WHEN {BRIDGE} THEN 4 ELSE 2 END"
    ranks = " ".join(f"WHEN '{c}' THEN {6 * k}" for k, c in enumerate(S.STREET_CLASSES))
    own = "CASE WHEN tags['boundary'] = 'administrative' AND tags['admin_level'] IN ('2', '02', '+2') THEN 2 WHEN tags['boundary'] = 'administrative' AND tags['admin_level'] IN ('4', '04', '+4') THEN 4 END"
    lv = f"least({own}, lv)"
    names = [x for x, _, _ in S.WATER_LINES]
    return " UNION ALL ".join(
        [
            select(source, "water_lines", one_of(w, names), f"CASE WHEN {w} IN ('canal', 'river') THEN 9 ELSE 14 END", w),
            select(source, "water_lines_labels", f"{one_of(w, names)} AND {NAMED}", f"CASE WHEN {w} IN ('canal', 'river') THEN 12 ELSE 14 END", w),
            select(source, "dam_lines", f"{w} = 'dam'", "12", "'dam'"),
            select(source, "pier_lines", one_of("tags['man_made']", S.PIERS), "12", "tags['man_made']"),
            select(source, "boundaries", f"{lv} IS NOT NULL", f"CASE {lv} WHEN 2 THEN 0 ELSE 7 END", "NULL::VARCHAR"),
            select(source, "land", "tags['natural'] = 'cliff'", "12", "'cliff'", "6"),
            select(source, "streets", f"({raw}) IS NOT NULL", zoom, cls, f"CASE {cls} {ranks} END + {level} + CASE WHEN ({raw}) LIKE '%\\_link' ESCAPE '\\' THEN 0 ELSE 1 END"),
            select(source, "street_labels", f"({raw}) IS NOT NULL AND ({NAMED} OR tags['ref'] IS NOT NULL)", choose([(k, v, z) for k, v, _, z in S.STREETS], 2), raw),
            select(source, "aerialways", one_of("tags['aerialway']", S.AERIALWAYS), "12", "tags['aerialway']"),
            select(source, "ferries", "tags['route'] = 'ferry'", "CASE WHEN tags['motor_vehicle'] = 'no' THEN 12 ELSE 10 END", "'ferry'"),
        ]
    )


def area_layers(source: str) -> str:
    """Layers of closed ways and multipolygons."""
    land = choose([(k, v, "forest" if v == "wood" else v) for k, values in S.LAND.items() for v in values], 2)
    area = choose(S.STREET_POLYGONS, 2)
    level = f"CASE WHEN {TUNNEL} THEN 0 WHEN {BRIDGE} THEN 4 ELSE 2 END"
    ranks = " ".join(f"WHEN '{c}' THEN {6 * k}" for k, c in enumerate(S.STREET_CLASSES))
    water = choose(S.WATER, 2)
    label = choose([(k, v, v) for k, v in S.STREET_POLYGON_LABELS], 2)
    return " UNION ALL ".join(
        [
            select(source, "water_polygons", f"({water}) IS NOT NULL", choose(S.WATER, 3), water),
            select(source, "water_polygons_labels", f"({water}) IS NOT NULL AND {NAMED}", "14", water),
            select(source, "dam_polygons", "tags['waterway'] = 'dam'", "12", "'dam'"),
            select(source, "pier_polygons", one_of("tags['man_made']", S.PIERS), "12", "tags['man_made']"),
            select(source, "boundary_labels", "tags['boundary'] = 'administrative' AND regexp_full_match(tags['admin_level'], '\\+?0*[24]')", "5", "NULL::VARCHAR"),
            select(source, "land", f"({land}) IS NOT NULL", by_value(land, S.LAND_ZOOM, "10"), land, by_value(land, S.LAND_RANK)),
            select(source, "sites", f"({choose(S.SITES, 2)}) IS NOT NULL", "14", choose(S.SITES, 2)),
            select(source, "buildings", "tags['building'] <> 'no'", "14", "NULL::VARCHAR"),
            select(source, "street_polygons", f"({area}) IS NOT NULL", choose(S.STREET_POLYGONS, 3), area, f"CASE {area} {ranks} END + {level} + 1"),
            select(source, "streets_polygons_labels", f"({label}) IS NOT NULL AND {NAMED}", "14", label),
            select(source, "bridges", "tags['man_made'] = 'bridge'", "12", "'bridge'"),
            *address_and_poi(source),
        ]
    )
