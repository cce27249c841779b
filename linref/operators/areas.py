"""The area around changed objects: the outline of the union of discs, exactly."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.functions import geometry as g
from linref.functions.lineage import settle
from linref.operators.clusters import nearest_nodes, with_new_nodes
from linref.operators.importing import numbered
from linref.operators.order import walked
from linref.operators.planar import stretches_between

#: Arc ends nearer than this are one point.
SAME = 1e-4


def _hidden(circles: DataFrame, discs: DataFrame, radius: float) -> DataFrame:
    """(table_name, id, lo, hi): the part of each circle, in turns from 0 to 1, that lies in each disc of its table: it is centred on the way to the disc's middle."""
    cell = 2 * radius
    at = g.in_cells(circles, "x", "y", "x", "y", cell, cell)
    other = discs.select("table_name", F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    d = g.distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))
    pair = at.join(other, ["table_name", "cx", "cy"]).withColumn("d", d).where((F.col("d") > 0) & (F.col("d") < 2 * radius))
    half, mid = F.acos(F.col("d") / (2 * radius)) / (2 * math.pi), F.atan2(F.col("oy") - F.col("y"), F.col("ox") - F.col("x")) / (2 * math.pi)
    pair = pair.withColumn("lo", mid - half).withColumn("hi", mid + half)
    # One that runs over the full turn is two.
    span = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    parts = F.when(lo >= 0, F.when(hi <= 1, F.array(span(lo, hi))).otherwise(F.array(span(lo, F.lit(1.0)), span(F.lit(0.0), hi - 1)))).when(hi <= 0, F.array(span(lo + 1, hi + 1))).otherwise(F.array(span(lo + 1, F.lit(1.0)), span(F.lit(0.0), hi)))
    return pair.select("table_name", "id", F.explode(parts).alias("p")).select("table_name", "id", "p.lo", "p.hi")


def outline(objects: DataFrame, radius: float = 10.0) -> DataFrame:
    """(table_name, id, x, y, a1, a2) of objects (table_name, x, y): the arcs, counterclockwise about (x, y) from angle a1 to a2, that bound the union of all
    discs of the radius around each table's objects.

    What other discs hide of each circle is found in two steps: first by one disc of each small cell, which is all it takes for nearly every
    circle amid a crowd; only circles that still show meet all their neighbours."""
    discs = settle(objects.select("table_name", "x", "y").where("x is not null and y is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    small = radius / 4
    few = discs.groupBy("table_name", F.floor(F.col("x") / small).alias("u"), F.floor(F.col("y") / small).alias("v")).agg(F.min(F.struct("x", "y")).alias("p")).select("table_name", "p.x", "p.y")
    key = ["table_name", "id"]
    shown = settle(stretches_between(_hidden(discs, few, radius), discs, key).select(*key).distinct())
    left = settle(discs.join(shown, key, "left_semi"))
    arcs = stretches_between(_hidden(left, discs, radius), left, key)
    return settle(arcs.join(left, key).select(*key, "x", "y", (F.col("t1") * 2 * math.pi).alias("a1"), (F.col("t2") * 2 * math.pi).alias("a2")))


def outline_rings(arcs: DataFrame, radius: float = 10.0) -> DataFrame:
    """(table_name, ring, arcs, length, area) of the closed lines that arcs (see outline) form; the area of a hole is negative."""
    end = lambda e, a: F.struct(F.lit(e).alias("end"), (F.col("x") + radius * F.cos(a)).alias("px"), (F.col("y") + radius * F.sin(a)).alias("py"))
    own = settle(numbered(arcs, ["table_name", "id", "a1"], "arc"))
    ends = own.select("table_name", "arc", F.explode(F.array(end(0, F.col("a1")), end(1, F.col("a2")))).alias("e"))
    ends = settle(ends.select("table_name", "arc", "e.end", (F.col("arc") * 2 + F.col("e.end")).alias("rank"), F.col("e.px").alias("x"), F.col("e.py").alias("y")))
    none = ends.select(F.col("rank").alias("id"), "x", "y").limit(0)
    node = settle(ends.join(nearest_nodes(ends, with_new_nodes(ends, none, SAME), SAME, ["rank"]), "rank").select("table_name", "arc", "end", "node"))
    # The nth arc that ends in a point is followed by the nth that starts there; mostly there is one of each.
    nth = F.row_number().over(Window.partitionBy("table_name", "node", "end").orderBy("arc"))
    node = node.withColumn("nth", nth)
    into, out = node.where("end = 1").select("table_name", "node", "nth", F.col("arc").alias("to")), node.where("end = 0").select("table_name", "node", "nth", F.col("arc").alias("id"))
    done, _ = walked(out.join(into, ["table_name", "node", "nth"], "left").select("id", F.lit("").alias("road_code"), "to"))
    a1, a2 = F.col("a1"), F.col("a2")
    # Twice the area under an arc, by Green's theorem; coordinates are taken from a point of the table, so that large ones cost no digits.
    base = own.groupBy("table_name").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    twice = radius * radius * (a2 - a1) + radius * (F.col("x") - F.col("x0")) * (F.sin(a2) - F.sin(a1)) - radius * (F.col("y") - F.col("y0")) * (F.cos(a2) - F.cos(a1))
    part = own.join(base, "table_name").select("table_name", "arc", (twice / 2).alias("area"), (radius * (a2 - a1)).alias("length"))
    return part.join(done.select(F.col("id").alias("arc"), F.col("head").alias("ring")), "arc").groupBy("table_name", "ring").agg(F.count("*").alias("arcs"), F.sum("length").alias("length"), F.sum("area").alias("area"))
