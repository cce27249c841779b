"""Import of a network from template tables: validation, neighbours, nodes, roads, markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.functions import geometry as g
from linref.functions.lineage import dealt, ranged
from linref.operators.references import edge_references
from linref.operators.segments import road_segments

# The columns of the import templates, and the classes and types a road may have.
EDGE_COLUMNS = ["edge_order", "road_code", "road_class", "road_type", "road_class_code", "is_active", "road_topic", "is_access_road", "geom"]
MARKER_COLUMNS = ["road_code", "code", "abscissa", "is_virtual", "geom"]
ROAD_TYPES = ["road", "roundabout"]
# The natures of roads, as whole names and by their beginnings, and the classes they stand for.
NATURES = {"AUT": "Autoroute", "RN": "Nationale", "SEMOP": "Départementale", "Vprivée": "Voie privée"}
NATURE_STARTS = {"RD": "Départementale", "VCdC": "Intercommunale", "VC": "Communale"}
OTHER = "Autre"
INACTIVE = ["Détruite", "PROG"]


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def bad_values(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(field, n, bad): how many rows have an unknown road_type or road_class, and the sorted distinct bad values."""
    def report(field: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.lit(field).alias("field"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(field)), ",").alias("bad"))

    types = edges.where(~F.coalesce(F.col("road_type").isin(ROAD_TYPES), F.lit(False)))
    return report("road_type", types).unionByName(report("road_class", edges.join(classes.select(F.col("code").alias("road_class")), "road_class", "left_anti")))


def nodes(edges: DataFrame) -> DataFrame:
    """(x, y, starts, ends): each distinct end point with the sorted ids of the edges that start and end there."""
    both = edges.select("id", F.lit(True).alias("s"), g.start_point(F.col("geom")).alias("p")).unionByName(edges.select("id", F.lit(False).alias("s"), g.end_point(F.col("geom")).alias("p")))
    pick = lambda start: F.array_sort(F.collect_set(F.when(F.col("s") == start, F.col("id"))))
    return both.groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(pick(True).alias("starts"), pick(False).alias("ends"))


def numbered(df: DataFrame, keys: list[str], name: str = "id", settled: bool = False) -> DataFrame:
    """Ids from 1 in the order of the keys: the place within ranges of the keys plus the count before each range, of which there are few.

    Rows are put in order within their range before it is settled, so they are dealt out once; monotonically_increasing_id holds the range above the place (33 bits)."""
    strip = ranged(df, keys, "__p", place=True, settled=settled)
    b = F.shiftright("__p", 33)
    counts = strip.groupBy(b.alias("__b")).agg(F.count("*").alias("count"))
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__before")
    at = strip.withColumn("__b", b).join(F.broadcast(before), "__b")
    return at.withColumn(name, F.col("__p").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("__before")).drop("__b", "__p", "__before")


def with_nodes(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edges with start_node and end_node: the node (id, x, y) at each end, null where there is none."""
    s, e = g.start_point(F.col("geom")), g.end_point(F.col("geom"))
    n = known.select(F.col("id").alias("__n"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    out = edges.drop("start_node", "end_node").withColumn("__sx", s["x"]).withColumn("__sy", s["y"]).withColumn("__ex", e["x"]).withColumn("__ey", e["y"])
    out = out.join(dealt(n.toDF("start_node", "__sx", "__sy")), ["__sx", "__sy"], "left")
    return out.join(dealt(n.toDF("end_node", "__ex", "__ey")), ["__ex", "__ey"], "left").drop("__sx", "__sy", "__ex", "__ey")


def insert_absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose keys are not in old, one per key."""
    return new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)


def marker_zero(edges: DataFrame, markers: DataFrame, near: float = 1.0) -> DataFrame:
    """(road_code, code 0, abscissa 0, geom) at the start of each road's first edge, unless the road has a marker within `near` of it."""
    w = Window.partitionBy("road_code").orderBy("edge_order", "id")
    first = edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("road_code", g.start_point(F.col("geom")).alias("geom"))
    m = markers.select(F.col("road_code").alias("m_road"), F.col("geom").alias("m"))
    close = (F.col("road_code") == F.col("m_road")) & (g.distance(F.col("geom.x"), F.col("geom.y"), F.col("m.x"), F.col("m.y")) <= near)
    return first.join(dealt(m), close, "left_anti").select("road_code", F.lit(0).alias("code"), F.lit(0.0).alias("abscissa"), "geom")


def import_network(edges: DataFrame, markers: DataFrame, classes: DataFrame) -> dict[str, DataFrame]:
    """The tables of a network from template tables; raises on missing columns or unknown classes and types."""
    require(edges, EDGE_COLUMNS)
    require(markers, MARKER_COLUMNS)
    wrong = [r["field"] for r in bad_values(edges, classes).where("n > 0").collect()]
    if wrong:
        raise ValueError(f"unknown values in {', '.join(wrong)}")
    from linref.operators.order import neighbours

    linked = neighbours(edges if "id" in edges.columns else numbered(edges.withColumn("__x", g.start_point(F.col("geom"))["x"]), ["__x", "road_code", "edge_order"]).drop("__x"))
    points = numbered(nodes(linked).select("x", "y"), ["x", "y"])
    full = with_nodes(linked, points)
    roads = edges.select("road_code", "road_type", "road_class", "road_class_code", "is_active", "road_topic", "is_access_road").dropDuplicates(["road_code"])
    every = markers.select("road_code", "code", "abscissa", "geom").dropDuplicates(["road_code", "code", "abscissa"])
    every = every.unionByName(marker_zero(linked, every))
    refs = edge_references(full, road_segments(edges if "id" in edges.columns else linked), every)
    return {"roads": roads, "nodes": points, "edges": full.join(refs.drop("road_code"), "id", "left"), "markers": every}


def classify_roads(df: DataFrame, code: str, nature: str) -> DataFrame:
    """Road attributes from a road's code and nature: type, class, class code, activity, topic and access flag.

    Without a nature a road is of the other class, inactive and an access road."""
    n = F.col(nature)
    whole = [F.when(n == k, v) for k, v in NATURES.items()]
    starts = [F.when(F.startswith(n, F.lit(k)), v) for k, v in sorted(NATURE_STARTS.items(), key=lambda i: -len(i[0]))]
    return df.select("*", F.when(F.startswith(F.upper(F.col(code)), F.lit("GIR")), "roundabout").otherwise("road").alias("road_type"), F.coalesce(*whole, *starts, F.lit(OTHER)).alias("road_class"),
                     F.when(F.startswith(n, F.lit("RD")), F.regexp_replace(n, "RD|_VDess|_Port", "")).alias("road_class_code"), F.coalesce(~n.isin(INACTIVE), F.lit(False)).alias("is_active"),
                     F.when(F.contains(n, F.lit("Port")), "Port").alias("road_topic"), F.coalesce(F.contains(n, F.lit("VDess")), F.lit(True)).alias("is_access_road"))


def stamp(df: DataFrame, old: DataFrame | None = None, key: str = "id") -> DataFrame:
    """created_at, kept from the old row where there is one, and updated_at: now, to the second."""
    now = F.date_trunc("second", F.current_timestamp())
    if old is None:
        return df.withColumn("created_at", now).withColumn("updated_at", now)
    before = old.select(key, F.col("created_at").alias("__created"))
    return df.drop("created_at", "updated_at").join(before, key, "left").withColumn("created_at", F.coalesce("__created", now)).withColumn("updated_at", now).drop("__created")


def reduce_precision(edges: DataFrame, step: float = 0.1) -> DataFrame:
    """Lines on a grid; roundabouts are left as they are."""
    skip = F.col("road_type") == "roundabout" if "road_type" in edges.columns else F.lit(False)
    return edges.withColumn("geom", F.when(F.coalesce(skip, F.lit(False)), F.col("geom")).otherwise(g.on_grid(F.col("geom"), step)))
