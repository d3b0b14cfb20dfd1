"""The catalogue against values written down a second time, from the layers' public description."""

from tilewright import schema as S

FLOORS = """water_polygons 4|water_polygons_labels 4|water_lines 9|water_lines_labels 9|dam_lines 12|dam_polygons 12|pier_lines 12|pier_polygons 12|boundaries 0
boundary_labels 2|place_labels 4|land 7|sites 14|buildings 14|addresses 14|streets 5|street_polygons 11|street_labels 10|street_labels_points 12
streets_polygons_labels 14|bridges 12|aerialways 12|ferries 10|public_transport 11|pois 14|ocean 0"""
STREETS = """motorway 5|trunk 6|primary 8|secondary 9|tertiary 10|unclassified 12|residential 12|living_street 13|service 13|pedestrian 13|track 13|footway 13
steps 13|path 13|cycleway 13|runway 11|taxiway 13|rail 10|narrow_gauge 10|light_rail 10|subway 10|tram 10|funicular 10|monorail 10|busway 12|bus_guideway 12"""
PLACES = "city 6|town 7|village 10|hamlet 10|suburb 10|quarter 10|neighbourhood 10|isolated_dwelling 10|farm 10|island 10|locality 10"


def pairs(text: str) -> dict[str, int]:
    return {k: int(v) for k, v in (row.split() for row in text.replace("\n", "|").split("|"))}


def test_layers_and_their_first_zooms():
    assert {x.name: x.floor for x in S.LAYERS} == pairs(FLOORS)
    assert [x.id for x in S.LAYERS] == list(range(26)) and [x.name for x in S.LAYERS][-1] == "ocean"


def test_streets_and_places_start_where_they_should():
    known = {v: z for _, v, z, _ in S.STREETS}
    assert {k: known[k] for k in pairs(STREETS)} == pairs(STREETS) and len(S.STREETS) == 31
    assert {p: z for p, z, _ in S.PLACES} == pairs(PLACES)


def test_land_covers_its_kinds_once():
    kinds = {("forest" if v == "wood" else v) for values in S.LAND.values() for v in values} | {"cliff"}
    ranked = [v for values in S.LAND_RANK.values() for v in values]
    assert len(ranked) == len(set(ranked)) and set(ranked) == kinds
    assert len(S.POIS["amenity"]) == 55 and len(S.POIS["shop"]) == 38 and len(S.POIS["tourism"]) == 14 and len(S.BRIDGES) == 8


def test_declared_fields_have_a_kind():
    assert set(S.LAYER_FIELDS) == {x.name for x in S.LAYERS}
    assert S.kind_of_key("tunnel") == "Boolean" and S.kind_of_key("height") == "Number" and S.kind_of_key("name") == "String"
