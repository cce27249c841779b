"""Checks of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roads_without_zero(edges: DataFrame, markers: DataFrame) -> DataFrame:
    return edges.select("road_code").distinct().join(markers.where("code = 0").select("road_code"), "road_code", "left_anti")


def broken_chains(edges: DataFrame) -> DataFrame:
    """Roads whose links do not make one chain of all their edges."""
    out = edges.groupBy("road_code").agg(F.count("*").alias("edges"), F.count("previous_edge_id").alias("previous"), F.count("next_edge_id").alias("next"))
    return out.where("previous + 1 != edges or next + 1 != edges")


def unknown_roads(edges: DataFrame, markers: DataFrame, roads: DataFrame) -> DataFrame:
    r = roads.select("road_code")
    return edges.join(r, "road_code", "left_anti").groupBy("road_code").agg(F.lit("edges").alias("table_name"), F.count("*").alias("n")).unionByName(
        markers.join(r, "road_code", "left_anti").groupBy("road_code").agg(F.lit("markers").alias("table_name"), F.count("*").alias("n")))


def constraint_report(edges: DataFrame, nodes: DataFrame, markers: DataFrame, roads: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(rule, n) of the rules that are broken: unique keys, references to other tables, values in bounds; road classes (code) if given."""
    def rule(name: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).count().where("count > 1")

    known = nodes.select(F.col("id").alias("n"))
    found = [rule("edges.id is unique", repeated(edges, "id")), rule("nodes.geom is unique", repeated(nodes, "x", "y")), rule("markers key is unique", repeated(markers, "road_code", "code", "abscissa")), rule("roads.road_code is unique", repeated(roads, "road_code")),
             rule("edges.start_node is known", edges.where("start_node is not null").join(known, F.col("start_node") == F.col("n"), "left_anti")), rule("edges.end_node is known", edges.where("end_node is not null").join(known, F.col("end_node") == F.col("n"), "left_anti")),
             rule("edges.road_code is known", edges.join(roads.select("road_code"), "road_code", "left_anti")), rule("markers are not negative", markers.where("code < 0 or abscissa < 0")), rule("road_type is known", roads.where("road_type is null or road_type not in ('road', 'roundabout')"))]
    found.append(rule("markers.road_code is known", markers.join(roads.select("road_code"), "road_code", "left_anti")))
    if classes is not None:
        found.append(rule("roads.road_class is known", roads.where("road_class is not null").join(classes.select(F.col("code").alias("road_class")), "road_class", "left_anti")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """(n, least, most) of the edges whose lines are equal on the 0.1 grid."""
    key = F.transform("geom", lambda p: F.struct(F.round(p["x"], 1).alias("x"), F.round(p["y"], 1).alias("y")))
    return edges.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).where("n > 1").drop("k")
