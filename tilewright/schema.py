"""The 26-layer catalogue as plain data.

Everything in this module is a fixed value of the Shortbread layer schema: layer
ids and names, accepted geometry kinds, tag values, zooms and ranks.
"""

from __future__ import annotations

from typing import NamedTuple


class Layer(NamedTuple):
    id: int
    name: str
    floor: int
    capped: bool
    kinds: str  # N node, O open way, C closed way, M multipolygon


# Layers in archive order.
LAYERS = [
    Layer(0, "water_polygons", 4, True, "CM"),
    Layer(1, "water_polygons_labels", 4, False, "CM"),
    Layer(2, "water_lines", 9, False, "OC"),
    Layer(3, "water_lines_labels", 9, False, "OC"),
    Layer(4, "dam_lines", 12, False, "OC"),
    Layer(5, "dam_polygons", 12, True, "CM"),
    Layer(6, "pier_lines", 12, False, "OC"),
    Layer(7, "pier_polygons", 12, True, "CM"),
    Layer(8, "boundaries", 0, False, "OC"),
    Layer(9, "boundary_labels", 2, False, "CM"),
    Layer(10, "place_labels", 4, False, "N"),
    Layer(11, "land", 7, True, "OCM"),
    Layer(12, "sites", 14, True, "CM"),
    Layer(13, "buildings", 14, True, "CM"),
    Layer(14, "addresses", 14, False, "NCM"),
    Layer(15, "streets", 5, False, "OC"),
    Layer(16, "street_polygons", 11, True, "CM"),
    Layer(17, "street_labels", 10, False, "OC"),
    Layer(18, "street_labels_points", 12, False, "N"),
    Layer(19, "streets_polygons_labels", 14, False, "CM"),
    Layer(20, "bridges", 12, True, "CM"),
    Layer(21, "aerialways", 12, False, "OC"),
    Layer(22, "ferries", 10, False, "OC"),
    Layer(23, "public_transport", 11, False, "NCM"),
    Layer(24, "pois", 14, False, "NCM"),
    Layer(25, "ocean", 0, False, ""),
]
LAYER_ID = {x.name: x.id for x in LAYERS}
#: Layers that take at least two of node, way and relation carry namespaced feature ids.
NAMESPACED = [x.id for x in LAYERS if ("N" in x.kinds) + bool(set("OC") & set(x.kinds)) + ("M" in x.kinds) >= 2]
MAX_ZOOM, EXTENT, BUFFER, PIXEL = 14, 4096, 128, 16
EARTH, MAX_LAT, EDGE_SLACK = 40_075_016.686, 85.051129, 1e-8

# Fixed values: (key, value, kind, min zoom) in order of precedence.
WATER = [
    ("natural", "water", "water", 4),
    ("natural", "glacier", "glacier", 4),
    ("waterway", "riverbank", "riverbank", 4),
    ("waterway", "dock", "dock", 10),
    ("waterway", "canal", "canal", 10),
    ("landuse", "reservoir", "reservoir", 4),
    ("landuse", "basin", "basin", 4),
]
WATER_LINES = [("canal", 9, 12), ("river", 9, 12), ("stream", 14, 14), ("ditch", 14, 14)]
PIERS = "pier breakwater groyne".split()
# place, zoom, default population
PLACES = [
    ("city", 6, 100000),
    ("town", 7, 5000),
    ("village", 10, 100),
    ("hamlet", 10, 50),
    ("suburb", 10, 1000),
    ("quarter", 10, 500),
    ("neighbourhood", 10, 100),
    ("isolated_dwelling", 10, 5),
    ("farm", 10, 5),
    ("island", 10, 0),
    ("locality", 10, 0),
]
CAPITAL_ZOOM = {"city": 4, "town": 4, "village": 4, "hamlet": 4}

LAND = {
    "amenity": ["grave_yard"],
    "landuse": "forest farmland farmyard meadow orchard vineyard allotments brownfield cemetery commercial garages grass greenfield greenhouse_horticulture industrial landfill plant_nursery quarry railway recreation_ground residential retail village_green".split(),
    "leisure": "garden golf_course miniature_golf park playground".split(),
    "natural": "wood bare_rock beach grassland heath sand scree scrub shingle".split(),
    "wetland": "bog marsh string_bog swamp wet_meadow".split(),
}
NATURAL_LAND = "bare_rock scree shingle sand beach grassland heath scrub bog marsh string_bog swamp wet_meadow".split()
LAND_ZOOM = {7: ["forest"], 11: "park golf_course garden playground miniature_golf grass".split() + NATURAL_LAND, 12: ["cliff"], 13: ["cemetery", "grave_yard"]}
LAND_RANK = {
    0: "residential commercial retail industrial garages railway brownfield greenfield landfill quarry farmyard".split(),
    1: "farmland meadow orchard vineyard allotments plant_nursery greenhouse_horticulture".split(),
    2: "park golf_course recreation_ground village_green cemetery grave_yard".split(),
    3: NATURAL_LAND,
    4: "grass garden playground miniature_golf".split(),
    5: ["forest"],
    6: ["cliff"],
}
SITES = [
    ("military", "danger_area", "danger_area"),
    ("leisure", "sports_centre", "sports_center"),
    ("landuse", "construction", "construction"),
    ("amenity", "bicycle_parking", "bicycle_parking"),
    ("amenity", "college", "college"),
    ("amenity", "hospital", "hospital"),
    ("amenity", "parking", "parking"),
    ("amenity", "prison", "prison"),
    ("amenity", "university", "university"),
]

# key, value, street zoom, label zoom
STREETS = [
    ("highway", "motorway", 5, 10),
    ("highway", "trunk", 6, 12),
    ("highway", "motorway_link", 9, 13),
    ("highway", "trunk_link", 9, 13),
    ("highway", "primary", 8, 12),
    ("highway", "primary_link", 8, 13),
    ("highway", "secondary", 9, 13),
    ("highway", "secondary_link", 9, 13),
    ("highway", "tertiary", 10, 13),
    ("highway", "tertiary_link", 10, 14),
    ("highway", "unclassified", 12, 14),
    ("highway", "residential", 12, 14),
    ("highway", "busway", 12, 14),
    ("highway", "bus_guideway", 12, 14),
    ("highway", "living_street", 13, 14),
    ("highway", "service", 13, 14),
    ("highway", "pedestrian", 13, 14),
    ("highway", "track", 13, 14),
    ("highway", "footway", 13, 14),
    ("highway", "steps", 13, 14),
    ("highway", "path", 13, 14),
    ("highway", "cycleway", 13, 14),
    ("aeroway", "runway", 11, 11),
    ("aeroway", "taxiway", 13, 13),
    ("railway", "rail", 10, 10),
    ("railway", "narrow_gauge", 10, 10),
    ("railway", "light_rail", 10, 10),
    ("railway", "subway", 10, 10),
    ("railway", "tram", 10, 10),
    ("railway", "funicular", 10, 10),
    ("railway", "monorail", 10, 10),
]
STREET_CLASSES = "track footway steps path cycleway pedestrian living_street service busway bus_guideway taxiway runway unclassified residential tertiary secondary primary trunk motorway funicular monorail tram light_rail subway narrow_gauge rail".split()
RAIL = "rail narrow_gauge light_rail subway tram funicular monorail".split()
STREET_POLYGONS = [("area:aeroway", "runway", "runway", 11), ("area:aeroway", "taxiway", "taxiway", 13), ("highway", "pedestrian", "pedestrian", 14), ("highway", "service", "service", 14)]
STREET_POLYGON_LABELS = [("aeroway", "runway"), ("aeroway", "taxiway"), ("highway", "pedestrian"), ("highway", "service")]
AERIALWAYS = "cable_car gondola goods chair_lift drag_lift t-bar j-bar platter rope_tow".split()
PUBLIC_TRANSPORT = [
    ("aeroway", "aerodrome", "aerodrome", 11),
    ("aeroway", "helipad", "helipad", 13),
    ("amenity", "bus_station", "bus_station", 13),
    ("amenity", "ferry_terminal", "ferry_terminal", 12),
    ("railway", "station", "station", 13),
    ("railway", "halt", "halt", 13),
    ("railway", "tram_stop", "tram_stop", 14),
    ("highway", "bus_stop", "bus_stop", 14),
    ("aerialway", "station", "aerialway_station", 13),
]
# category: values, in order of precedence
POIS = {
    "amenity": "arts_centre atm bank bar bench bicycle_parking bicycle_rental biergarten bus_station cafe car_sharing cinema clinic charging_station college community_centre courthouse dentist doctors drinking_water embassy fast_food fire_station fountain fuel hospital hunting_stand ice_cream kindergarten library marketplace nightclub nursing_home parking pharmacy place_of_worship police post_box post_office prison pub recycling restaurant school shelter swimming_pool taxi telephone theatre toilets townhall university vending_machine veterinary waste_basket".split(),
    "emergency": "defibrillator fire_hydrant phone fire_extinguisher fire_water_pond water_tank suction_point".split(),
    "highway": ["emergency_access_point"],
    "historic": "archaeological_site battlefield castle fort memorial monument ruins wayside_cross wayside_shrine".split(),
    "leisure": "dog_park golf_course ice_rink miniature_golf pitch playground sports_centre".split(),
    "man_made": "lighthouse mast tower water_tower water_well windmill".split(),
    "natural": ["peak", "volcano"],
    "mountain_pass": ["yes"],
    "office": ["diplomatic"],
    "shop": "alcohol bakery beauty beverages bicycle books butcher car car_parts car_repair chemist clothes computer confectionery convenience department_store doityourself electronics florist furniture garden_centre gift greengrocer hairdresser hardware jewelry kiosk laundry mall mobile_phone optician outdoor pet shoes sports stationery supermarket toys".split(),
    "tourism": "alpine_hut artwork attraction camp_site caravan_site gallery guest_house hostel hotel information motel museum picnic_site viewpoint".split(),
}
BRIDGES = "yes viaduct boardwalk cantilever covered low_water_crossing movable trestle".split()
TUNNELS = ["yes", "building_passage"]

#: Layers whose own geometry is a line, whether the way is closed or not.
LINE_LAYERS = "water_lines water_lines_labels dam_lines pier_lines boundaries streets street_labels aerialways ferries".split()
#: Line layers that are drawn however small they are.
ALWAYS_DRAWN = ("boundaries", "streets")
#: How a polygon's label point is found; the others: a point on its surface.
LABEL_RULES = {"water_polygons_labels": "centroid", "addresses": "convex"}
# Fixed values: (square kilometres, first zoom) of boundary labels; smaller ones: 5.
BOUNDARY_LABEL_AREAS = [(2_000_000, 2), (700_000, 3), (100_000, 4)]
# Attributes that aren't text.
BOOLEAN_KEYS = "tunnel bridge link rail oneway oneway_reverse maritime disputed atm recycling:glass_bottles recycling:paper recycling:clothes recycling:scrap_metal".split()
INTEGER_KEYS = "admin_level population ref_rows ref_cols ele".split()
DECIMAL_KEYS = "height min_height building:levels way_area".split()

# The attributes that each layer declares; kind_of_key tells their kinds.
NAMES = "name name_en name_de".split()
LAYER_FIELDS: dict[str, list[str]] = {
    "water_polygons": ["kind"],
    "water_polygons_labels": ["kind", *NAMES],
    "water_lines": ["kind", "tunnel", "bridge"],
    "water_lines_labels": ["kind", "tunnel", "bridge", *NAMES],
    "dam_lines": ["kind"],
    "dam_polygons": ["kind"],
    "pier_lines": ["kind"],
    "pier_polygons": ["kind"],
    "boundaries": ["admin_level", "maritime", "disputed"],
    "boundary_labels": ["admin_level", "way_area", *NAMES],
    "place_labels": ["kind", "population", *NAMES],
    "land": ["kind"],
    "sites": ["kind"],
    "buildings": ["height", "min_height", "building:levels"],
    "addresses": ["housename", "housenumber"],
    "streets": "kind link rail tunnel bridge oneway oneway_reverse tracktype surface service bicycle horse".split(),
    "street_polygons": "kind bridge tunnel service surface".split(),
    "street_labels": ["kind", "ref", "ref_rows", "ref_cols", "tunnel", *NAMES],
    "street_labels_points": ["kind", "ref", *NAMES],
    "streets_polygons_labels": ["kind", *NAMES],
    "bridges": ["kind"],
    "aerialways": ["kind"],
    "ferries": ["kind", *NAMES],
    "public_transport": ["kind", "iata", *NAMES],
    "pois": ["kind", *[k for k in POIS if k != "mountain_pass"], *NAMES, "housename", "housenumber", *"cuisine vending religion denomination recycling:glass_bottles recycling:paper recycling:clothes recycling:scrap_metal atm sport tower:type information ele".split()],
    "ocean": [],
}


def kind_of_key(key: str) -> str:
    """Boolean, Number or String, as metadata tells it."""
    return "Boolean" if key in BOOLEAN_KEYS else "Number" if key in INTEGER_KEYS or key in DECIMAL_KEYS else "String"
