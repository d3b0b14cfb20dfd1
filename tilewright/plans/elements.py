"""Queries on elements: classification, parsing, resolution and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright import bridge as B
from tilewright.functions import geo as G
from tilewright.functions import tags as T
from tilewright.operators import classify as C
from tilewright.operators import emit as E
from tilewright.operators import resolve as R
from tilewright.plans import oracles as O
from tilewright.plans.registry import query

COLUMNS = ["id", "layer", "min_zoom", "kind", "paint_rank"]


def point_matches(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(B.points(spark, d), "node", ["id", "lon_e7", "lat_e7"])


def tagged_ways(spark: SparkSession, d: str) -> DataFrame:
    """id, tags, closed, parent_level, parent_disputed, without building ref lists."""
    n = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), B._case(F.col("o_orderkey"), B.WAY_CASES).alias("tags"))
    fold = B.boundary_of_ways(spark, d).withColumnRenamed("way", "id")
    joined = o.join(n, "id", "left").join(fold, "id", "left")
    return joined.select("id", "tags", ((F.col("status") == "F") & (F.coalesce("n", F.lit(0)) >= 3)).alias("closed"), "parent_level", "parent_disputed")


@query(
    f"""WITH RECURSIVE {O.PTS}, m AS ({O.node_layers("pts")}), e AS (
  SELECT m.id, layer, unnest(range(min_zoom, 15)) AS z, {O.X} AS px, {O.Y} AS py FROM m JOIN pts ON pts.id = m.id
), t AS (SELECT id, layer, z, {O.tile("px", "z")} AS x, {O.tile("py", "z")} AS y FROM e
), {O.hilbert("t")}
SELECT layer, t.z::INT AS z, tile_id, count(DISTINCT id) AS features FROM t JOIN hid ON hid.z = t.z AND hid.x = t.x AND hid.y = t.y GROUP BY ALL"""
)
def flagship_point_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Distinct point features for each layer, zoom and tile."""
    rows = E.point_tiles(point_matches(spark, d))
    return rows.groupBy("layer", "z", "tile_id").agg(F.count_distinct("id").alias("features"))


@query(f"WITH {O.PTS} {O.node_layers('pts')}")
def classify_nodes(spark: SparkSession, d: str) -> DataFrame:
    return point_matches(spark, d).select(*COLUMNS)


@query(f"WITH {O.WAYS}, {O.RELS}, {O.FOLD}, s AS (SELECT ways.*, lv, dis FROM ways LEFT JOIN fold ON fold.way = id WHERE NOT closed) {O.line_layers('s')}")
def classify_open_ways(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(tagged_ways(spark, d).filter(~F.col("closed")), "open_way").select(*COLUMNS)


@query(f"WITH {O.WAYS}, {O.RELS}, {O.FOLD}, s AS (SELECT ways.*, lv, dis FROM ways LEFT JOIN fold ON fold.way = id WHERE closed) {O.line_layers('s')} UNION ALL {O.area_layers('s')}")
def classify_closed_ways(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(tagged_ways(spark, d).filter("closed"), "closed_way").select(*COLUMNS)


@query(f"WITH {O.cases('wcase', B.WAY_CASES)}, s AS (SELECT id, tags FROM (SELECT DISTINCT o_orderkey // 16 AS id FROM orders) JOIN wcase ON id % {len(B.WAY_CASES)} = idx) {O.area_layers('s')}")
def classify_relations(spark: SparkSession, d: str) -> DataFrame:
    ids = B.table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 16).alias("id")).distinct()
    return C.classify(ids.select("id", B._case(F.col("id"), B.WAY_CASES).alias("tags")), "multipolygon").select(*COLUMNS)


# --- value parsing, on values spelled from driver keys -------------------------------------
FORMS = ["{a}", "{a},5", "{a} m", "{a} ft", "{a}'6\"", "{a};7", " {a}", "+{a}", "1,{b}", "{a}.25 meters", "-{a}", "x{a}", "{a},500,000", "", "{a} feet", ".5", "{a}'", "2", "02", "4"]


def spelled(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (key % len(FORMS) + 1).cast("int"))
    text = F.replace(F.replace(form, F.lit("{a}"), (key % 211).cast("string")), F.lit("{b}"), F.lpad((key % 1000).cast("string"), 3, "0"))
    return B.table(spark, d, "part").select(key.alias("id"), text.alias("raw"))


SPELLED = f"""sp AS (SELECT p_partkey AS id, replace(replace([{O.quoted(FORMS)}][(p_partkey % {len(FORMS)} + 1)::INT], '{{a}}', (p_partkey % 211)::VARCHAR), '{{b}}', lpad((p_partkey % 1000)::VARCHAR, 3, '0')) AS raw FROM part)"""


def dec(t: str) -> str:
    """A decimal with the comma policy, as SQL."""
    number = f"CASE WHEN NOT contains({t}, ',') THEN {t} WHEN contains({t}, '.') OR length({t}) - length(replace({t}, ',', '')) > 1 THEN replace({t}, ',', '') WHEN regexp_full_match({t}, '.+,.{{3}}') THEN replace({t}, ',', '') ELSE replace({t}, ',', '.') END"
    return f"(CASE WHEN regexp_full_match({number}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN CAST({number} AS DOUBLE) END)"


LENGTH = f"""len1 AS (SELECT id, raw, trim(split_part(lower(trim(raw)), ';', 1)) AS v FROM sp
), len2 AS (SELECT *, split_part(v, '''', 1) AS ft, regexp_extract(v, '^[^'']*''(.*)"$', 1) AS inch, trim(regexp_replace(v, '(feet|ft|''|meters|meter|m)$', '')) AS bare FROM len1
), len AS (SELECT id, CASE WHEN regexp_full_match(v, '[^'']*''.*"') THEN {dec("ft")} * 0.3048 + {dec("inch")} * 0.0254
  WHEN regexp_matches(v, '(feet|ft|'')$') THEN {dec("bare")} * 0.3048 ELSE {dec("bare")} END AS metres FROM len2)"""


@query(f"WITH {SPELLED}, {LENGTH} SELECT id, round(metres, 6) AS metres FROM len")
def parse_lengths(spark: SparkSession, d: str) -> DataFrame:
    return spelled(spark, d).select("id", F.round(T.length_m(F.col("raw")), 6).alias("metres"))


@query(f"WITH {SPELLED}, c AS (SELECT id, trim(split_part(raw, ';', 1)) AS t FROM sp) SELECT id, CASE WHEN {dec('t')} >= 0 THEN {dec('t')} END AS count FROM c")
def parse_counts(spark: SparkSession, d: str) -> DataFrame:
    return spelled(spark, d).select("id", T.count(F.col("raw")).alias("count"))


@query(f"WITH {SPELLED} SELECT id, CASE WHEN regexp_full_match(replace(raw, ',', ''), '[+-]?[0-9]+') THEN replace(raw, ',', '')::BIGINT END AS value FROM sp")
def parse_ints(spark: SparkSession, d: str) -> DataFrame:
    return spelled(spark, d).select("id", T.strict_int(F.col("raw")).alias("value"))


@query(f"WITH {SPELLED} SELECT id, CASE WHEN regexp_full_match(raw, '\\+?0*2') THEN 2 WHEN regexp_full_match(raw, '\\+?0*4') THEN 4 END AS level FROM sp")
def parse_admin_level(spark: SparkSession, d: str) -> DataFrame:
    return spelled(spark, d).select("id", T.admin_level(F.col("raw")).alias("level"))


@query(f"WITH {SPELLED}, {LENGTH} SELECT id, round(metres)::BIGINT AS ele FROM len")
def parse_ele(spark: SparkSession, d: str) -> DataFrame:
    return spelled(spark, d).select("id", T.elevation(F.col("raw")).alias("ele"))


@query(f"WITH {O.WAYS} SELECT id, {O.TUNNEL} AS tunnel, {O.BRIDGE} AS bridge FROM ways")
def street_flags(spark: SparkSession, d: str) -> DataFrame:
    return tagged_ways(spark, d).select("id", T.is_tunnel().alias("tunnel"), T.is_bridge().alias("bridge"))


@query(f"WITH {O.WAYS} SELECT id, replace(tags['ref'], ';', chr(10)) AS ref, CASE WHEN tags['ref'] = '' THEN 0 ELSE len(string_split(tags['ref'], ';')) END AS ref_rows, coalesce(list_max(list_transform(string_split(tags['ref'], ';'), lambda s: len(s))), 0) AS ref_cols FROM ways WHERE tags['ref'] IS NOT NULL")
def street_ref_shape(spark: SparkSession, d: str) -> DataFrame:
    return tagged_ways(spark, d).filter(T.has("ref")).select("id", *[v.alias(k) for k, v in T.ref_lines(T.tag("ref")).items()])


@query(f"WITH {O.WAYS} SELECT id, nullif(tags['name'], '') AS name, nullif(tags['name:en'], '') AS name_en, nullif(tags['name:de'], '') AS name_de FROM ways")
def name_attrs(spark: SparkSession, d: str) -> DataFrame:
    return tagged_ways(spark, d).select("id", *[T.non_empty(k).alias(k.replace(":", "_")) for k in ("name", "name:en", "name:de")])


STREET_ATTRS = " UNION ALL ".join(
    f"SELECT id, '{k}' AS key, {z} AS from_zoom FROM s WHERE {c}"
    for k, z, c in [("kind", 0, "true"), ("link", 11, "raw LIKE '%\\_link' ESCAPE '\\'"), ("rail", 0, "rail"), ("tunnel", 11, O.TUNNEL), ("bridge", 11, O.BRIDGE), ("oneway", 14, "NOT rail AND tags['oneway'] IN ('yes', '1', 'true', '-1')"), ("oneway_reverse", 14, "NOT rail AND tags['oneway'] = '-1'")]
    + [(k, 11, f"tags['{k}'] IS NOT NULL") for k in ("tracktype", "surface", "service")]
    + [(k, 14, f"tags['{k}'] IS NOT NULL") for k in ("bicycle", "horse")]
)


@query(
    f"""WITH {O.WAYS}, s0 AS (SELECT id, tags, {O.choose([(k, v, v) for k, v, _, _ in O.S.STREETS], 2)} AS raw FROM ways WHERE NOT closed
), s AS (SELECT *, raw IN ({O.quoted(O.S.RAIL)}) AS rail FROM s0 WHERE raw IS NOT NULL), a AS ({STREET_ATTRS})
SELECT id, z::INT AS z, count(*) AS attrs FROM a JOIN (VALUES (10), (11), (14)) v(z) ON from_zoom <= z GROUP BY ALL"""
)
def zoom_gated_attrs(spark: SparkSession, d: str) -> DataFrame:
    """Number of attributes that a street shows at zooms 10, 11 and 14."""
    m = C.classify(tagged_ways(spark, d).filter(~F.col("closed")), "open_way").filter(F.col("layer") == O.S.LAYER_ID["streets"])
    at = m.withColumn("z", F.explode(F.array(F.lit(10), F.lit(11), F.lit(14))))
    return at.select("id", "z", F.expr("size(filter(attrs, a -> a.from_zoom <= z))").cast("bigint").alias("attrs"))


STREET_VALUES = " UNION ALL ".join(
    f"SELECT id, '{k}' AS key, {z} AS from_zoom, {v} AS value FROM s WHERE {c}"
    for k, z, c, v in [
        ("kind", 0, "true", "regexp_replace(raw, '_link$', '')"),
        ("link", 11, "raw LIKE '%\\_link' ESCAPE '\\'", "'true'"),
        ("rail", 0, "rail", "'true'"),
        ("tunnel", 11, O.TUNNEL, "'true'"),
        ("bridge", 11, O.BRIDGE, "'true'"),
        ("oneway", 14, "NOT rail AND tags['oneway'] IN ('yes', '1', 'true', '-1')", "'true'"),
        ("oneway_reverse", 14, "NOT rail AND tags['oneway'] = '-1'", "'true'"),
    ]
    + [(k, 11, f"tags['{k}'] IS NOT NULL", f"tags['{k}']") for k in ("tracktype", "surface", "service")]
    + [(k, 14, f"tags['{k}'] IS NOT NULL", f"tags['{k}']") for k in ("bicycle", "horse")]
)


def attribute_rows(matches: DataFrame, layer: str) -> DataFrame:
    """id, key, from_zoom, value: a row for each attribute of a layer's matches."""
    own = matches.filter(F.col("layer") == O.S.LAYER_ID[layer]).select("id", F.explode("attrs").alias("a"))
    return own.select("id", "a.key", F.col("a.from_zoom").cast("int").alias("from_zoom"), "a.value")


@query(
    f"""WITH {O.WAYS}, s0 AS (SELECT id, tags, {O.choose([(k, v, v) for k, v, _, _ in O.S.STREETS], 2)} AS raw FROM ways WHERE NOT closed
), s AS (SELECT *, raw IN ({O.quoted(O.S.RAIL)}) AS rail FROM s0 WHERE raw IS NOT NULL) {STREET_VALUES}"""
)
def street_attrs(spark: SparkSession, d: str) -> DataFrame:
    """Every attribute of every street, with the zoom that it starts at."""
    return attribute_rows(C.classify(tagged_ways(spark, d).filter(~F.col("closed")), "open_way"), "streets")


POI_VALUES = " UNION ALL ".join(
    f"SELECT id, '{key}' AS key, {value} AS value FROM s WHERE {where}"
    for key, value, where in [("kind", "value", "true")]
    + [(k, "value", f"category = '{k}'") for k in O.S.POIS if k != "mountain_pass"]
    + [(k.replace(":", "_"), f"tags['{k}']", f"coalesce(tags['{k}'], '') <> ''") for k in ("name", "name:en", "name:de")]
    + [(k, f"tags['addr:{k}']", f"tags['addr:{k}'] IS NOT NULL") for k in ("housename", "housenumber")]
    + [
        ("cuisine", "tags['cuisine']", "category = 'amenity' AND value IN ('restaurant', 'fast_food', 'pub', 'bar', 'cafe') AND tags['cuisine'] IS NOT NULL"),
        ("atm", "(coalesce(tags['atm'] = 'yes', false))::VARCHAR", "category = 'amenity' AND value = 'bank'"),
        ("information", "tags['information']", "category = 'tourism' AND value = 'information' AND tags['information'] IS NOT NULL"),
    ]
    + [(f"recycling:{k}", f"(coalesce(tags['recycling:{k}'] = 'yes', false))::VARCHAR", "category = 'amenity' AND value = 'recycling'") for k in ("glass_bottles", "paper", "clothes", "scrap_metal")]
)
POI_CATEGORY = "CASE " + " ".join(f"WHEN tags['{k}'] IN ({O.quoted(v)}) THEN '{'natural' if k == 'mountain_pass' else k}'" for k, v in O.S.POIS.items()) + " END"


@query(f"WITH {O.PTS}, s AS (SELECT id, tags, {POI_CATEGORY} AS category, {O.POI_VALUE} AS value FROM pts WHERE {O.POI}) {POI_VALUES}")
def poi_attrs(spark: SparkSession, d: str) -> DataFrame:
    """Every attribute of every point of interest but its elevation, which parse_ele covers."""
    return attribute_rows(point_matches(spark, d), "pois").filter("key <> 'ele'").select("id", "key", "value")


HEIGHTS = {"12,5 m": 12.5, "40 ft": 12.192, "6'2\"": 1.8796}


@query(
    f"""WITH {O.WAYS}, h(raw, metres) AS (VALUES {", ".join(f"({O.quoted([k])}, {v}::DOUBLE)" for k, v in HEIGHTS.items())})
SELECT id, round(a.metres, 6) AS height, round(b.metres, 6) AS min_height, CASE tags['building:levels'] WHEN '3' THEN 3.0::DOUBLE WHEN '2,5;3' THEN 2.5::DOUBLE END AS levels
FROM ways LEFT JOIN h a ON a.raw = tags['height'] LEFT JOIN h b ON b.raw = tags['min_height'] WHERE closed AND tags['building'] IS NOT NULL AND tags['building'] <> 'no'"""
)
def building_attrs(spark: SparkSession, d: str) -> DataFrame:
    """Heights and levels of all buildings."""
    m = C.classify(tagged_ways(spark, d).filter("closed"), "closed_way").filter(F.col("layer") == O.S.LAYER_ID["buildings"])
    value = lambda key: F.round(F.expr(f"get(filter(attrs, a -> a.key = '{key}'), 0).value").cast("double"), 6)
    return m.select("id", value("height").alias("height"), value("min_height").alias("min_height"), value("building:levels").alias("levels"))


@query(f"WITH {O.PTS} SELECT id, {O.POI} AS is_poi, NOT {O.POI} AND (tags['addr:housenumber'] IS NOT NULL OR tags['addr:housename'] IS NOT NULL) AS is_address FROM pts")
def poi_anti_addresses(spark: SparkSession, d: str) -> DataFrame:
    poi = C.poi_category()[0].isNotNull()
    return B.points(spark, d).select("id", poi.alias("is_poi"), (~poi & (T.has("addr:housenumber") | T.has("addr:housename"))).alias("is_address"))


# --- resolution ------------------------------------------------------------------------------
def partial_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of ways, every seventh missing."""
    return B.way_nodes(spark, d).filter("id % 7 <> 0")


@query(f"WITH {O.FV} SELECT way AS id, count(*) FILTER (node % 7 <> 0) AS points, count(*) FILTER (node % 7 = 0) AS missing, first(lon_e7 ORDER BY pos) FILTER (node % 7 <> 0) AS first_lon, last(lat_e7 ORDER BY pos) FILTER (node % 7 <> 0) AS last_lat FROM fv GROUP BY way HAVING count(*) FILTER (node % 7 <> 0) > 0".replace("FILTER (node", "FILTER (WHERE node"))
def resolve_way_coords(spark: SparkSession, d: str) -> DataFrame:
    got = R.way_coordinates(B.ways(spark, d), partial_nodes(spark, d))
    return got.select("id", F.size("locations").cast("bigint").alias("points"), "missing", F.element_at("locations", 1)["lon_e7"].alias("first_lon"), F.element_at("locations", -1)["lat_e7"].alias("last_lat"))


@query(f"WITH {O.FV}, w AS (SELECT o_orderkey AS id, count(node) AS refs, count(node) FILTER (WHERE node % 7 <> 0) AS hits FROM orders LEFT JOIN fv ON way = o_orderkey GROUP BY 1) SELECT sum(refs)::BIGINT AS refs, sum(hits)::BIGINT AS resolved, sum(refs - hits)::BIGINT AS missing, count(*) FILTER (WHERE refs > hits) AS ways_with_missing, count(*) FILTER (WHERE hits = 0) AS ways_without_coordinates FROM w")
def missing_refs(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_refs(B.ways(spark, d), partial_nodes(spark, d))


@query(f"WITH {O.RELS} SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT way FROM rels WHERE kind = 'area' AND id % 3 = 0)")
def member_way_semijoin(spark: SparkSession, d: str) -> DataFrame:
    areas = B.relations(spark, d).filter("kind = 'area' AND id % 3 = 0")
    return R.needed_ways(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), areas)


@query(f"WITH {O.FV}, {O.RELS}, n AS (SELECT way, count(*) AS n FROM fv GROUP BY way) SELECT id, count(*) AS members, count(n) AS found, count(*) - count(n) AS missing, coalesce(sum(n), 0)::BIGINT AS points FROM rels LEFT JOIN n USING (way) WHERE kind = 'area' GROUP BY id HAVING count(n) > 0")
def relation_member_geoms(spark: SparkSession, d: str) -> DataFrame:
    sizes = B.flat_vertices(spark, d).groupBy("way").agg(F.count(F.lit(1)).alias("n"))
    return R.member_geometry(B.relations(spark, d).filter("kind = 'area'"), sizes)


@query(f"WITH {O.RELS}, {O.FOLD} SELECT way, lv AS parent_level, dis AS parent_disputed FROM fold")
def boundary_fold(spark: SparkSession, d: str) -> DataFrame:
    return B.boundary_of_ways(spark, d)


@query(
    f"""WITH {O.WAYS}, {O.RELS}, {O.FOLD}, s AS (
  SELECT id, tags, least(CASE WHEN tags['boundary'] = 'administrative' AND regexp_full_match(tags['admin_level'], '\\+?0*[24]') THEN right(tags['admin_level'], 1)::INT END, lv) AS admin_level, coalesce(dis, false) OR coalesce(tags['disputed'] = 'yes', false) AS disputed FROM ways LEFT JOIN fold ON way = id)
SELECT id, admin_level, CASE admin_level WHEN 2 THEN 0 ELSE 7 END AS min_zoom, disputed, coalesce(tags['maritime'] = 'yes', false) OR coalesce(tags['natural'] = 'coastline', false) AS maritime FROM s WHERE admin_level IS NOT NULL"""
)
def boundary_lines(spark: SparkSession, d: str) -> DataFrame:
    m = C.classify(tagged_ways(spark, d), "open_way").filter(F.col("layer") == O.S.LAYER_ID["boundaries"])
    value = lambda key: F.expr(f"filter(attrs, a -> a.key = '{key}')[0].value")
    return m.select("id", value("admin_level").cast("int").alias("admin_level"), "min_zoom", value("disputed").cast("boolean").alias("disputed"), value("maritime").cast("boolean").alias("maritime"))


@query(f"WITH {O.WV} SELECT node, count(*) AS uses FROM wv GROUP BY node HAVING count(*) >= 2")
def shared_node_pins(spark: SparkSession, d: str) -> DataFrame:
    return R.shared_nodes(B.vertices(spark, d))


@query(f"WITH {O.WV}, {O.RELS} SELECT id, node, count(DISTINCT rels.way) AS members FROM rels JOIN wv ON wv.way = rels.way WHERE kind = 'area' GROUP BY id, node HAVING count(DISTINCT rels.way) >= 2")
def relation_shared_vertices(spark: SparkSession, d: str) -> DataFrame:
    return R.relation_shared_vertices(B.relations(spark, d).filter("kind = 'area'"), B.vertices(spark, d))


@query(
    f"""WITH {O.WV}, a AS (SELECT min(lon_e7) AS lo, max(lon_e7) AS hi, min(CASE WHEN lon_e7 < 0 THEN lon_e7 + 3600000000 ELSE lon_e7 END) AS slo, max(CASE WHEN lon_e7 < 0 THEN lon_e7 + 3600000000 ELSE lon_e7 END) AS shi, min(lat_e7) AS south, max(lat_e7) AS north FROM wv)
SELECT lo AS west, hi AS east, south, north, shi - slo < hi - lo AS crosses_antimeridian FROM a"""
)
def data_extent(spark: SparkSession, d: str) -> DataFrame:
    """Extent of all vertices and whether it crosses the antimeridian."""
    lon = F.col("lon_e7")
    moved = F.when(lon < 0, lon + 3_600_000_000).otherwise(lon)
    a = B.vertices(spark, d).agg(F.min(lon).alias("west"), F.max(lon).alias("east"), F.min("lat_e7").alias("south"), F.max("lat_e7").alias("north"), F.min(moved).alias("a"), F.max(moved).alias("b"))
    return a.select("west", "east", "south", "north", (F.col("b") - F.col("a") < F.col("east") - F.col("west")).alias("crosses_antimeridian"))


@query(f"WITH {O.PTS}, m AS ({O.node_layers('pts')}) SELECT id, layer, CASE WHEN layer IN ({', '.join(map(str, G.NAMESPACED))}) THEN id * 10 + 1 ELSE id END AS feature_id FROM m")
def feature_ids(spark: SparkSession, d: str) -> DataFrame:
    return point_matches(spark, d).select("id", "layer", G.feature_id(F.col("layer"), F.lit(1), F.col("id")).alias("feature_id"))


@query("SELECT o_orderkey AS id, (o_totalprice * 100)::BIGINT AS km2, CASE WHEN (o_totalprice * 100)::BIGINT >= 2000000 THEN 2 WHEN (o_totalprice * 100)::BIGINT >= 700000 THEN 3 WHEN (o_totalprice * 100)::BIGINT >= 100000 THEN 4 ELSE 5 END AS min_zoom FROM orders")
def boundary_label_zoom(spark: SparkSession, d: str) -> DataFrame:
    km2 = F.round(F.col("o_totalprice") * 100).cast("bigint")
    zoom = F.when(km2 >= 2_000_000, 2).when(km2 >= 700_000, 3).when(km2 >= 100_000, 4).otherwise(5)
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), km2.alias("km2"), zoom.alias("min_zoom"))


@query(f"WITH {O.WAYS}, {O.RELS}, {O.FOLD}, s AS (SELECT ways.*, lv, dis FROM ways LEFT JOIN fold ON fold.way = id), m AS (SELECT * FROM ({O.line_layers('s')}) UNION ALL SELECT * FROM ({O.area_layers('s')})) SELECT layer, kind, paint_rank, count(*) AS n FROM m WHERE layer IN (11, 15, 16) GROUP BY ALL")
def paint_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = tagged_ways(spark, d)
    m = C.classify(w, "closed_way")
    return m.filter(F.col("layer").isin(11, 15, 16)).groupBy("layer", "kind", "paint_rank").agg(F.count(F.lit(1)).alias("n"))
