"""Order of the edges of roads along their links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.functions import geometry as g
from linref.functions.lineage import settle

NEAR = 0.2


def successors(edges: DataFrame, near: float = NEAR) -> DataFrame:
    """(id, road_code, next): the declared link, or where it is null the edge of the road that starts within `near` of the end."""
    ends = edges.where("next_edge_id is null").select("id", "road_code", g.end_point(F.col("geom")).alias("e"))
    ends = ends.withColumn("c", F.explode(g.cells(F.col("e.x"), F.col("e.y"), F.col("e.x"), F.col("e.y"), 1.0, near)))
    starts = edges.select(F.col("id").alias("n"), "road_code", g.start_point(F.col("geom")).alias("s")).withColumn("c", F.struct(F.floor("s.x").alias("cx"), F.floor("s.y").alias("cy")))
    d = g.distance(F.col("e.x"), F.col("e.y"), F.col("s.x"), F.col("s.y"))
    close = ends.join(starts, ["road_code", "c"]).where((F.col("id") != F.col("n")) & (d <= near)).groupBy("id").agg(F.min(F.struct(d.alias("d"), "n"))["n"].alias("n"))
    return edges.select("id", "road_code", "next_edge_id").join(close, "id", "left").select("id", "road_code", F.coalesce("next_edge_id", "n").alias("next"))


def ordered_edges(edges: DataFrame, near: float = NEAR) -> DataFrame:
    """(road_code, id, edge_order) from each road's first edge, by pointer doubling: log2 of the longest chain joins over all roads at once.

    Each edge points 2^k steps back; an edge's order is its distance to the chain's head. In a ring, which has no head, the edge of
    the least id is made the head. Chains of one road follow each other by the id of their heads."""
    return _chains(edges, near)[0].withColumn("edge_order", F.row_number().over(Window.partitionBy("road_code").orderBy("head", "steps", "id"))).select("road_code", "id", "edge_order")


def edges_from(edges: DataFrame, starts: DataFrame, upstream: bool = False, near: float = NEAR) -> DataFrame:
    """(start_id, id, edge_order): the edges from each start (id) on, itself the first, down to the end of its chain or up to its head; a ring is gone round once."""
    chain, rings = _chains(edges, near)
    own = chain.join(rings.withColumn("ring", F.lit(True)), ["road_code", "head"], "left") if rings is not None else chain.withColumn("ring", F.lit(None).cast("boolean")).withColumn("size", F.lit(None).cast("long"))
    at = own.join(starts.select("id").distinct(), "id").select("road_code", "head", F.col("id").alias("start_id"), F.col("steps").alias("from"))
    ahead = (F.col("from") - F.col("steps")) if upstream else (F.col("steps") - F.col("from"))
    ahead = F.when(F.col("ring"), F.pmod(ahead, F.col("size"))).otherwise(ahead)
    return own.join(at, ["road_code", "head"]).withColumn("ahead", ahead).where("ahead >= 0").select("start_id", "id", (F.col("ahead") + 1).cast("int").alias("edge_order"))


def _chains(edges: DataFrame, near: float) -> tuple[DataFrame, DataFrame | None]:
    """(id, road_code, head, steps) of all edges: the head of each one's chain and how far it is from it; and (road_code, head, size) of the rings."""
    link = successors(edges, near)
    back = link.where("next is not null").groupBy(F.col("next").alias("id")).agg(F.min("id").alias("to"))
    return walked(link.select("id", "road_code").join(back, "id", "left"))


def walked(back: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, road_code, head, steps) of rows (id, road_code, to) that each point at the row before them, or nowhere: the head of each row's chain and how far it
    is from it; and (road_code, head, size) of the rings, None if there are none. A ring is cut before its least id."""
    first = settle(back.select("id", "road_code", "to", F.when(F.col("to").isNull(), 0).otherwise(1).alias("steps"), F.least("id", F.coalesce("to", "id")).alias("low"), F.coalesce("to", "id").alias("head")))
    done, live = _walked(first)
    sizes = None
    # What still points somewhere is in a ring: cut it before its least id and walk again.
    if live is not None:
        heads = live.where("id = low").select("id", F.lit(True).alias("h"))
        rings = first.join(live.select("id"), "id", "left_semi").join(heads, "id", "left")
        cut = settle(rings.select("id", "road_code", F.when(F.col("h"), F.lit(None)).otherwise(F.col("to")).alias("to"), F.when(F.col("h"), 0).otherwise(F.col("steps")).alias("steps"), "low", F.when(F.col("h"), F.col("id")).otherwise(F.col("head")).alias("head")))
        ring = _walked(cut)[0]
        done, sizes = done.unionByName(ring), ring.groupBy("road_code", "head").agg(F.count("*").alias("size"))
    return done, sizes


def _walked(first: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Each pointer `to` led on to where the row it points at leads, until none points anywhere or only rings are left; steps and the least id on the way go along.

    Rows that point nowhere any more are set aside; returns those, and what still points somewhere if anything does. Where a round changes no
    row's least id and sets none aside, every row has seen its whole ring."""
    done, live = first.where("to is null"), first.where("to is not null")
    while True:
        if live.isEmpty():
            return done, None
        o = done.unionByName(live).select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"), F.col("head").alias("head2"))
        low = F.least("low", F.coalesce("low2", "low"))
        step = live.join(o, "to", "left").select("id", "road_code", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), low.alias("low"), F.coalesce("head2", "head").alias("head"), ((low != F.col("low")) | F.col("to2").isNull()).alias("news"))
        step = settle(step)
        news = not step.where("news").isEmpty()
        step = step.drop("news")
        done, live = done.unionByName(step.where("to is null")), step.where("to is not null")
        if not news:
            return done, live


def neighbours(order: DataFrame) -> DataFrame:
    """previous_edge_id and next_edge_id by edge_order within each road."""
    w = Window.partitionBy("road_code").orderBy("edge_order", "id")
    return order.withColumn("previous_edge_id", F.lag("id").over(w)).withColumn("next_edge_id", F.lead("id").over(w))
