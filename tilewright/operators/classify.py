"""Rule-based classification of elements into layers.

Every layer is one Column that is a match struct or null; the elements of one
geometry kind get an array of the layers that take the kind, without nulls,
exploded.  No rule is evaluated for a kind that its layer doesn't take.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright import schema as S
from tilewright.functions import tags as T

KINDS = {"node": "N", "open_way": "O", "closed_way": "C", "multipolygon": "M"}


def attr(key: str, value: Column, from_zoom: int = 0, simple: bool = True) -> Column:
    """An attribute, or null without a value; ``simple`` values are cheap to stand in the plan twice."""
    told = lambda v: F.when(v.isNotNull(), F.struct(F.lit(key).alias("key"), F.lit(from_zoom).alias("from_zoom"), v.cast("string").alias("value")))
    return told(value) if simple else T.let(value, told)


def when_true(key: str, condition: Column, from_zoom: int = 0) -> Column:
    return attr(key, F.when(condition, F.lit("true")), from_zoom)


def names() -> list[Column]:
    return [attr(k.replace(":", "_"), T.non_empty(k)) for k in ("name", "name:en", "name:de")]


def match(layer: str, condition: Column, min_zoom: Column | int, kind: Column | None, attrs: list[Column] = (), rank: Column | int = 0, geom: str = "own") -> Column:
    zoom = F.lit(min_zoom) if isinstance(min_zoom, int) else min_zoom
    rank = F.lit(rank) if isinstance(rank, int) else rank
    kind = F.lit(None).cast("string") if kind is None else kind
    listed = F.array_compact(F.array(attr("kind", kind), *attrs)) if attrs else F.array_compact(F.array(attr("kind", kind)))
    return F.when(
        F.coalesce(condition, F.lit(False)),
        F.struct(F.lit(S.LAYER_ID[layer]).alias("layer"), zoom.cast("int").alias("min_zoom"), kind.alias("kind"), rank.cast("int").alias("paint_rank"), F.lit(geom).alias("geom"), listed.alias("attrs")),
    )


def land_kind() -> Column:
    rows = [(key, v, "forest" if v == "wood" else v) for key, values in S.LAND.items() for v in values]
    return T.first_match(rows, 2)


def poi_category() -> tuple[Column, Column]:
    """(category key, value) of the first category that fits."""
    whens = {k: T.any_of(f"tags['{k}']", values) for k, values in S.POIS.items()}
    category = " ".join(f"WHEN {w} THEN '{'natural' if k == 'mountain_pass' else k}'" for k, w in whens.items())
    value = " ".join(f"WHEN {w} THEN " + ("'pass'" if k == "mountain_pass" else f"tags['{k}']") for k, w in whens.items())
    return F.expr(f"CASE {category} END"), F.expr(f"CASE {value} END")


def street_rank(kind: Column, link: Column | bool) -> Column:
    cls = F.array_position(F.expr(f"array({', '.join(map(T.literal, S.STREET_CLASSES))})"), kind) - 1
    level = F.when(F.col("_tunnel"), 0).when(F.col("_bridge"), 2).otherwise(1)
    return cls * 6 + level * 2 + (F.when(link, 0).otherwise(1) if isinstance(link, Column) else F.lit(0 if link else 1))


def shared_columns(kind: str) -> dict[str, Column]:
    """Values that several rules use, computed once for each element."""
    category, value = poi_category()
    out = {"_poi": category, "_poi_value": value}
    if kind != "node":
        out |= {"_water": T.first_match(S.WATER, 2), "_land": land_kind(), "_street": T.first_match([(k, v, v) for k, v, _, _ in S.STREETS], 2), "_area": T.first_match(S.STREET_POLYGONS, 2), "_tunnel": T.is_tunnel(), "_bridge": T.is_bridge()}
    return out


@cache
def rules(kind: str) -> dict[str, Column]:
    """The match column of every layer that takes a geometry kind, on ``shared_columns``."""
    takes = {x.name for x in S.LAYERS if KINDS[kind] in x.kinds}
    tag, has = T.tag, T.has
    tunnel, bridge, named = F.col("_tunnel"), F.col("_bridge"), T.named()
    flags = [when_true("tunnel", tunnel), when_true("bridge", bridge)]
    out: dict[str, Column] = {}

    water, water_zoom = F.col("_water"), T.first_match(S.WATER, 3)
    if "water_polygons" in takes:
        out["water_polygons"] = match("water_polygons", water.isNotNull(), water_zoom, water)
    if "water_polygons_labels" in takes:
        out["water_polygons_labels"] = match("water_polygons_labels", water.isNotNull() & named, 14, water, names(), geom="label")
    line = T.first_match([("waterway", w, w) for w, _, _ in S.WATER_LINES], 2)
    by_zoom = lambda column: T.pick("tags['waterway']", {z: [w[0] for w in S.WATER_LINES if w[column] == z] for z in sorted({w[column] for w in S.WATER_LINES})})
    if "water_lines" in takes:
        out["water_lines"] = match("water_lines", line.isNotNull(), by_zoom(1), line, flags)
    if "water_lines_labels" in takes:
        out["water_lines_labels"] = match("water_lines_labels", line.isNotNull() & named, by_zoom(2), line, flags + names())
    for name in takes & {"dam_lines", "dam_polygons"}:
        out[name] = match(name, tag("waterway") == "dam", 12, F.lit("dam"))
    for name in takes & {"pier_lines", "pier_polygons"}:
        out[name] = match(name, T.is_any("man_made", S.PIERS), 12, tag("man_made"))

    level = F.when(tag("boundary") == "administrative", T.admin_level(tag("admin_level")))
    parent_level = F.col("parent_level") if kind in ("open_way", "closed_way") else F.lit(None).cast("int")
    parent_disputed = F.coalesce(F.col("parent_disputed"), F.lit(False)) if kind in ("open_way", "closed_way") else F.lit(False)
    line_level = F.least(level, parent_level)
    disputed = parent_disputed | F.coalesce(tag("disputed") == "yes", F.lit(False))
    maritime = F.coalesce(tag("maritime") == "yes", F.lit(False)) | F.coalesce(tag("natural") == "coastline", F.lit(False))
    if "boundaries" in takes:
        out["boundaries"] = match("boundaries", line_level.isNotNull(), F.when(line_level == 2, 0).otherwise(7), None, [attr("admin_level", line_level), attr("maritime", maritime), attr("disputed", disputed)])
    if "boundary_labels" in takes:
        out["boundary_labels"] = match("boundary_labels", level.isNotNull(), 5, None, [attr("admin_level", level), *names()], geom="label")

    place = T.first_match([("place", p, p) for p, _, _ in S.PLACES], 2)
    capital, state = F.coalesce(tag("capital") == "yes", F.lit(False)), F.coalesce(tag("capital") == "4", F.lit(False))
    place_kind = F.when((place == "city") & capital, "capital").when((place == "city") & state, "state_capital").otherwise(place)
    usual = T.pick("tags['place']", {z: [p for p, pz, _ in S.PLACES if pz == z] for z in (6, 7, 10)})
    place_zoom = F.when((capital & place.isin(*S.CAPITAL_ZOOM)) | (state & (place == "city")), 4).otherwise(usual)
    people = F.coalesce(T.strict_int(tag("population")), T.pick("tags['place']", {n: [p for p, _, pn in S.PLACES if pn == n] for n in sorted({pn for _, _, pn in S.PLACES})}))
    if "place_labels" in takes:
        out["place_labels"] = match("place_labels", named & place.isNotNull(), place_zoom, place_kind, [attr("population", people), *names()])

    land = F.col("_land")
    land_zoom, land_rank = T.pick("_land", S.LAND_ZOOM, 10), T.pick("_land", S.LAND_RANK)
    polygon = match("land", land.isNotNull(), land_zoom, land, rank=land_rank)
    cliff = match("land", tag("natural") == "cliff", 12, F.lit("cliff"), rank=6, geom="line")
    if kind == "open_way":
        out["land"] = cliff
    elif "land" in takes:
        out["land"] = polygon
        if kind == "closed_way":
            out["land_cliff"] = cliff
    site = T.first_match(S.SITES, 2)
    if "sites" in takes:
        out["sites"] = match("sites", site.isNotNull(), 14, site)
    size = [attr(k, T.length_m(tag(k)), simple=False) for k in ("height", "min_height")] + [attr("building:levels", T.count(tag("building:levels")), simple=False)]
    if "buildings" in takes:
        out["buildings"] = match("buildings", has("building") & (tag("building") != "no"), 14, None, size)

    category, value = F.col("_poi"), F.col("_poi_value")
    address = [attr("housename", tag("addr:housename")), attr("housenumber", tag("addr:housenumber"))]
    if "addresses" in takes:
        out["addresses"] = match("addresses", (has("addr:housenumber") | has("addr:housename")) & category.isNull(), 14, None, address, geom="label")

    raw = F.col("_street")
    link = raw.endswith("_link")
    street = F.regexp_replace(raw, "_link$", "")
    rail = T.is_rail()
    zoom = T.pick("_street", {z: [v for _, v, own, _ in S.STREETS if own == z] for z in sorted({r[2] for r in S.STREETS})})
    zoom = F.when(raw.isin("rail", "narrow_gauge") & F.coalesce(tag("service") != "", F.lit(False)), 8).otherwise(zoom)
    oneway = tag("oneway").isin("yes", "1", "true", "-1")
    street_attrs = [
        when_true("link", link, 11),
        when_true("rail", rail),
        when_true("tunnel", tunnel, 11),
        when_true("bridge", bridge, 11),
        when_true("oneway", ~rail & oneway, 14),
        when_true("oneway_reverse", ~rail & (tag("oneway") == "-1"), 14),
        *[attr(k, tag(k), 11) for k in ("tracktype", "surface", "service")],
        *[attr(k, tag(k), 14) for k in ("bicycle", "horse")],
    ]
    if "streets" in takes:
        out["streets"] = match("streets", raw.isNotNull(), zoom, street, street_attrs, street_rank(street, link))
    area = F.col("_area")
    if "street_polygons" in takes:
        out["street_polygons"] = match("street_polygons", area.isNotNull(), T.first_match(S.STREET_POLYGONS, 3), area, [when_true("bridge", bridge), when_true("tunnel", tunnel), attr("service", tag("service")), attr("surface", tag("surface"))], street_rank(area, False))
    label_zoom = T.pick("_street", {z: [v for _, v, _, own in S.STREETS if own == z] for z in sorted({r[3] for r in S.STREETS})})
    ref = T.ref_lines(tag("ref"))
    if "street_labels" in takes:
        out["street_labels"] = match("street_labels", raw.isNotNull() & (named | has("ref")), label_zoom, raw, [*[attr(k, F.when(has("ref"), v)) for k, v in ref.items()], when_true("tunnel", tunnel), *names()])
    if "street_labels_points" in takes:
        out["street_labels_points"] = match("street_labels_points", tag("highway") == "motorway_junction", 12, F.lit("motorway_junction"), [attr("ref", tag("ref")), *names()])
    area_label = T.first_match([(k, v, v) for k, v in S.STREET_POLYGON_LABELS], 2)
    if "streets_polygons_labels" in takes:
        out["streets_polygons_labels"] = match("streets_polygons_labels", named & area_label.isNotNull(), 14, area_label, names(), geom="label")
    if "bridges" in takes:
        out["bridges"] = match("bridges", tag("man_made") == "bridge", 12, F.lit("bridge"))
    if "aerialways" in takes:
        out["aerialways"] = match("aerialways", T.is_any("aerialway", S.AERIALWAYS), 12, tag("aerialway"))
    if "ferries" in takes:
        out["ferries"] = match("ferries", tag("route") == "ferry", F.when(tag("motor_vehicle") == "no", 12).otherwise(10), F.lit("ferry"), names())
    stop = T.first_match(S.PUBLIC_TRANSPORT, 2)
    if "public_transport" in takes:
        out["public_transport"] = match("public_transport", stop.isNotNull(), T.first_match(S.PUBLIC_TRANSPORT, 3), stop, [attr("iata", tag("iata")), *names()], geom="label")

    is_poi = lambda key, *values: F.coalesce((category == key) & value.isin(*values), F.lit(False))
    recycling = [attr(f"recycling:{k}", F.when(is_poi("amenity", "recycling"), F.coalesce(tag(f"recycling:{k}") == "yes", F.lit(False)))) for k in ("glass_bottles", "paper", "clothes", "scrap_metal")]
    extras = [
        attr("cuisine", F.when(is_poi("amenity", "restaurant", "fast_food", "pub", "bar", "cafe"), tag("cuisine"))),
        attr("vending", F.when(is_poi("amenity", "vending_machine"), tag("vending"))),
        *[attr(k, F.when(is_poi("amenity", "place_of_worship"), tag(k))) for k in ("religion", "denomination")],
        *recycling,
        attr("atm", F.when(is_poi("amenity", "bank"), F.coalesce(tag("atm") == "yes", F.lit(False)))),
        attr("sport", F.when(is_poi("leisure", "pitch", "sports_centre"), tag("sport"))),
        attr("tower:type", F.when(is_poi("man_made", "tower"), tag("tower:type"))),
        attr("information", F.when(is_poi("tourism", "information"), tag("information"))),
        attr("ele", F.when(category == "natural", T.elevation(tag("ele"))), simple=False),
    ]
    own = [attr(k, F.when(category == k, value)) for k in S.POIS if k != "mountain_pass"]
    if "pois" in takes:
        out["pois"] = match("pois", category.isNotNull(), 14, value, [*own, *names(), *address, *extras], geom="label")
    return out


def classify(elements: DataFrame, kind: str, keep: list[str] = ("id",)) -> DataFrame:
    """One row for each (element, layer) match, with the columns of ``keep``.

    elements: tags, and for ways parent_level and parent_disputed, the folded
    boundary metadata of relations that a way belongs to (null without).
    """
    found = F.array_compact(F.array(*rules(kind).values()))
    told = elements.withColumns(shared_columns(kind))
    return told.select(*keep, F.explode(found).alias("m")).select(*keep, "m.*")
