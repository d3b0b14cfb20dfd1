"""Coordinates, members and boundary metadata by joins and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def way_coordinates(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, locations (in ref order), missing: a join in place of a node store.

    Refs without a node are dropped and counted; ways without a coordinate vanish.
    """
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    found = refs.join(nodes.select(F.col("id").alias("ref"), "lon_e7", "lat_e7"), "ref", "left")
    at = F.when(F.col("lon_e7").isNotNull(), F.struct("pos", "lon_e7", "lat_e7"))
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(at)).alias("at"), F.sum(F.col("lon_e7").isNull().cast("int")).alias("missing"))
    return listed.filter(F.size("at") > 0).select("id", F.transform("at", lambda p: F.struct(p["lon_e7"].alias("lon_e7"), p["lat_e7"].alias("lat_e7"))).alias("locations"), "missing")


def missing_refs(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counters of refs: all, resolved, missing, ways touched, ways with no coordinate."""
    refs = ways.select("id", F.explode_outer("refs").alias("ref"))
    found = refs.join(nodes.select(F.col("id").alias("ref"), F.lit(1).alias("hit")), "ref", "left")
    per_way = found.groupBy("id").agg(F.count("ref").alias("refs"), F.count("hit").alias("hits"))
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n)
    return per_way.agg(total(F.col("refs"), "refs"), total(F.col("hits"), "resolved"), total(F.col("refs") - F.col("hits"), "missing"), total((F.col("refs") > F.col("hits")).cast("int"), "ways_with_missing"), total((F.col("hits") == 0).cast("int"), "ways_without_coordinates"))


def area_relations(relations: DataFrame) -> DataFrame:
    """Relations that are areas by their type; that a layer matches them is told by their classification."""
    return relations.filter(F.col("tags")["type"].isin("multipolygon", "boundary"))


def needed_ways(ways: DataFrame, members: DataFrame) -> DataFrame:
    """The ways that an area relation names: a semi-join."""
    return ways.join(members.select(F.col("way").alias("id")), "id", "left_semi")


def boundary_fold(members: DataFrame) -> DataFrame:
    """way, parent_level, parent_disputed: smallest level and any dispute of its relations."""
    told = members.filter(F.col("admin_level").isin(2, 4) | F.col("disputed"))
    level = F.when(F.col("admin_level").isin(2, 4), F.col("admin_level"))
    return told.groupBy("way").agg(F.min(level).alias("parent_level"), F.bool_or("disputed").alias("parent_disputed"))


def shared_nodes(vertices: DataFrame) -> DataFrame:
    """node, uses: nodes that occur at least twice, closing vertices aside."""
    return vertices.groupBy("node").agg(F.count(F.lit(1)).alias("uses")).filter("uses >= 2")


def relation_shared_vertices(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, node: vertices of at least two different members of a relation."""
    at = members.select("id", "way").distinct().join(vertices.select("way", "node").distinct(), "way")
    return at.groupBy("id", "node").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2")


def member_geometry(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, members, found, missing, points: what of a relation's members resolves."""
    at = members.join(sizes, "way", "left")
    agg = at.groupBy("id").agg(F.count(F.lit(1)).alias("members"), F.count("n").alias("found"), F.sum(F.col("n").isNull().cast("int")).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))
    return agg.filter("found > 0")


def rings(vertices: DataFrame) -> DataFrame:
    """Edges of closed ways on integers relative to the ring's first vertex.

    way, pos, x0, y0, x1, y1: one row for each edge, the closing one included.
    """
    w = Window.partitionBy("way").orderBy("pos")
    first = Window.partitionBy("way").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    v = vertices.filter("closed").select("way", "pos", (F.col("lon_e7") - F.first("lon_e7").over(first)).alias("x0"), (F.col("lat_e7") - F.first("lat_e7").over(first)).alias("y0"))
    return v.withColumn("x1", F.lead("x0").over(w)).withColumn("y1", F.lead("y0").over(w)).filter("x1 IS NOT NULL")
