"""The driver's tables seen as nodes, ways and relations.

All rules are integer arithmetic on keys.  A way is an order, its vertices the
order's lines on a local grid; closed where the status is F and three lines
exist.  Points are customers and events.  Tags come from a list of cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright import schema as S
from tilewright.functions.tags import literal


def _cases() -> tuple[list[str], list[str]]:
    nodes = [f"place={p}|name=P{k}" for k, (p, _, _) in enumerate(S.PLACES)]
    nodes += ["place=city|capital=yes|name=A|population=1,234", "place=city|capital=4|name=B", "place=town|capital=4|name=C", "place=town|capital=yes|name=D|population=x", "place=village|name="]
    nodes += [f"{k}={v}|name=N" for k, values in S.POIS.items() for v in values]
    nodes += [f"{k}={v}" for k, v, _, _ in S.PUBLIC_TRANSPORT]
    nodes += ["highway=motorway_junction|ref=12", "addr:housenumber=5", "addr:housename=", "amenity=cafe|addr:housenumber=7|cuisine=cake", "amenity=nothing|shop=bakery", "shop=none|tourism=hotel", "natural=peak|ele=1,234 ft|name=X", "natural=volcano|ele=812,5", "mountain_pass=yes|ele=900 m", "amenity=bank|atm=yes", "amenity=recycling|recycling:paper=yes", "amenity=cafe|shop=bakery", "highway=emergency_access_point", "foo=bar", "aeroway=aerodrome|iata=ABC|amenity=bus_station", "railway=tram_stop|highway=bus_stop"]
    ways = [f"{k}={v}|name=W" for k, v, _, _ in S.WATER] + [f"waterway={w}" for w, _, _ in S.WATER_LINES]
    ways += [f"{k}={v}" for k, values in S.LAND.items() for v in values]
    ways += [f"{k}={v}" for k, v, _ in S.SITES] + [f"{k}={v}|ref=A 1;B 22" for k, v, _, _ in S.STREETS]
    ways += [f"{k}={v}|surface=paved" for k, v, _, _ in S.STREET_POLYGONS] + [f"{k}={v}|name=L" for k, v in S.STREET_POLYGON_LABELS]
    ways += [f"aerialway={a}" for a in S.AERIALWAYS] + [f"man_made={p}" for p in S.PIERS] + [f"bridge={b}|highway=primary" for b in S.BRIDGES]
    ways += ["waterway=dam", "man_made=bridge", "route=ferry|motor_vehicle=no", "route=ferry|name=F", "building=yes|height=12,5 m|building:levels=3", "building=no", "building=|height=40 ft", "building=house|min_height=6'2\"|building:levels=2,5;3"]
    ways += ["boundary=administrative|admin_level=2|maritime=yes", "boundary=administrative|admin_level=+4|disputed=yes", "boundary=administrative|admin_level= 2", "boundary=administrative|admin_level=02|name=Land", "natural=coastline", "admin_level=4"]
    ways += ["natural=cliff", "natural=wood|landuse=meadow", "landuse=nothing|leisure=park", "amenity=grave_yard|landuse=forest", "railway=rail|service=yard", "railway=narrow_gauge|service=", "railway=tram|oneway=yes", "highway=residential|oneway=-1|tunnel=yes|bicycle=no", "highway=motorway_link|oneway=1|covered=yes", "highway=track|tracktype=grade2|horse=yes", "highway=service|tunnel=building_passage|bridge=yes", "highway=proposed|railway=rail", "highway=footway|name=|ref=", "highway=primary|name=Road|name:en=Road E|name:de=Weg", "natural=water|name=See|landuse=basin", "waterway=river|tunnel=yes|name=R", "addr:housenumber=3|building=yes", "amenity=parking|leisure=pitch|sport=chess", "tourism=information|information=map", "foo=bar"]
    return nodes, ways


NODE_CASES, WAY_CASES = _cases()


def _case(key: Column, cases: list[str]) -> Column:
    """Tags of case key % n, as a map; the cases are a constant of the query."""
    listed = F.expr(f"array({', '.join(map(literal, cases))})")
    return F.str_to_map(F.element_at(listed, (key % len(cases) + 1).cast("int")), F.lit("[|]"), F.lit("="))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the line items' files whose vertices are one task's.
TASK_BYTES = 2 << 20


def dealt(df: DataFrame, key: str, size: int, task: int = TASK_BYTES) -> DataFrame:
    """Rows dealt by key to a task for each ``task`` of ``size`` bytes, where the session's number of partitions would make tasks grow with the input."""
    parts = -(-size // task)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def vertex_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Size of the line items' files."""
    return int(str(table(spark, sf_dir, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon_e7, lat_e7, tags: customers and events as nodes."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("id"))
    keys = keys.union(table(spark, sf_dir, "events").select("event_id", F.col("event_id") + 10_000_000))
    lon = (F.col("key") * 7919 % 36000) * 100000 - 1_800_000_000
    lat = (F.col("key") * 104729 % 16000) * 100000 - 800_000_000
    return keys.select("id", lon.alias("lon_e7"), lat.alias("lat_e7"), _case(F.col("key"), NODE_CASES).alias("tags"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, ln, k, node, lon_e7, lat_e7: a row for each line of an order."""
    b = F.floor(F.col("l_orderkey") / 16)
    k = F.col("l_partkey") % 64
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_linenumber").cast("bigint").alias("ln"), b.alias("b"), k.alias("k"))
    edge = 1_799_800_000 + (F.col("k") % 8) * 60000
    edge = F.when(edge > 1_800_000_000, edge - 3_600_000_000).otherwise(edge)
    inner = (F.col("b") * 7919 % 3400) * 1_000_000 - 1_700_000_000 + (F.col("k") % 8) * 60000
    lat = (F.col("b") * 104729 % 1400) * 1_000_000 - 700_000_000 + F.floor(F.col("k") / 8) * 60000
    return v.select("way", "ln", "k", (F.col("b") * 10000 + F.col("k")).alias("node"), F.when(F.col("b") % 97 == 0, edge).otherwise(inner).alias("lon_e7"), lat.alias("lat_e7"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon_e7, lat_e7: the nodes that ways refer to."""
    return vertices(spark, sf_dir).select(F.col("node").alias("id"), "lon_e7", "lat_e7").distinct()


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, refs, tags; a closed way repeats its first ref."""
    listed = vertices(spark, sf_dir).groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "k", "node"))), lambda v: v["node"]).alias("refs"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    joined = orders.join(listed, orders["id"] == listed["way"], "left").select("id", "status", F.coalesce("refs", F.array().cast("array<bigint>")).alias("refs"))
    closed = (F.col("status") == "F") & (F.size("refs") >= 3)
    refs = F.when(closed, F.concat("refs", F.slice("refs", 1, 1))).otherwise(F.col("refs"))
    return joined.select("id", refs.alias("refs"), _case(F.col("id"), WAY_CASES).alias("tags"))


def flat_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, pos, node, lon_e7, lat_e7, closed, with the closing vertex: no list is built."""
    v = dealt(vertices(spark, sf_dir), "way", vertex_bytes(spark, sf_dir))
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way"), (F.col("o_orderstatus") == "F").alias("f"))
    w = Window.partitionBy("way")
    v = v.join(status, "way").withColumn("pos", F.row_number().over(w.orderBy("ln", "k")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    v = v.withColumn("closed", F.col("f") & (F.col("n") >= 3))
    at = F.when((F.col("pos") == 0) & F.col("closed"), F.array(F.lit(0).cast("bigint"), F.col("n"))).otherwise(F.array(F.col("pos").cast("bigint")))
    return v.select("way", F.explode(at).alias("pos"), "node", "lon_e7", "lat_e7", "closed")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, admin_level, disputed, way, role, seq: a row for each member.

    Area relations are blocks of orders; admin relations are nations (level 4)
    and regions (level 2).
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way"), F.col("o_custkey").alias("cust"))
    role = F.element_at(F.array(F.lit("outer"), F.lit("inner"), F.lit("")), (F.col("way") % 3 + 1).cast("int"))
    none = F.lit(None)
    area = o.select(F.floor(F.col("way") / 16).alias("id"), F.lit("area").alias("kind"), none.cast("int").alias("admin_level"), F.lit(False).alias("disputed"), "way", role.alias("role"), F.col("way").alias("seq"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").cast("bigint").alias("nation"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("nation"), F.col("n_regionkey").cast("bigint").alias("region"))
    member = o.join(c, "cust").join(F.broadcast(n), "nation")  # 25 nations
    disputed = F.col("nation") % 5 == 0
    four = member.filter("way % 4 <> 0").select((F.col("nation") + 1_000_000_000).alias("id"), F.lit("admin"), F.lit(4), disputed, "way", F.lit("outer"), F.col("way"))
    two = member.filter("way % 10 = 0").select((F.col("region") + 2_000_000_000).alias("id"), F.lit("admin"), F.lit(2), disputed, "way", F.lit("outer"), F.col("way"))
    return area.union(four).union(two)


def relation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tags of the area relations; every fifth isn't an area by its type."""
    ids = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 16).alias("id")).distinct()
    kind = F.when(F.col("id") % 5 == 4, "site").when(F.col("id") % 2 == 0, "multipolygon").otherwise("boundary")
    return ids.select("id", F.map_concat(_case(F.col("id"), WAY_CASES), F.create_map(F.lit("type"), kind)).alias("tags"))


def boundary_of_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, parent_level, parent_disputed: the fold over the admin relations of a way."""
    from tilewright.operators.resolve import boundary_fold

    return boundary_fold(relations(spark, sf_dir).filter("kind = 'admin'"))
