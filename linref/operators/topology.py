"""Upkeep of the graph as passes over whole tables: snapping, links, crossings, splits, merges, roundabouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.functions import geometry as g
from linref.functions.lineage import dealt, settle
from linref.operators.chains import merge_graph, merge_with_markers
from linref.operators.clusters import nodes_in_reach, with_new_nodes
from linref.operators.order import neighbours, ordered_edges
from linref.operators.planar import exterior_rings, lines_in_rings
from linref.operators.references import update_edge_references
from linref.operators.segments import road_segments

SNAP = 0.5


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("id", "road_code", F.explode(F.array(F.struct(F.lit(0).alias("end"), g.start_point(F.col("geom")).alias("p")), F.struct(F.lit(1).alias("end"), g.end_point(F.col("geom")).alias("p")))).alias("e")).select("id", "road_code", "e.end", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def _flat(edges: DataFrame, *more: str) -> DataFrame:
    """The edges' segments: id, seg_idx, n_seg, x1 to y2, and the edge's own length before each."""
    p = edges.select("id", "road_code", *more, F.size("geom").alias("n_pts"), F.posexplode(g.pieces(F.col("geom"))).alias("seg_idx", "p")).select(
        "id", "road_code", *more, "n_pts", "seg_idx", F.col("p.a.x").alias("x1"), F.col("p.a.y").alias("y1"), F.col("p.b.x").alias("x2"), F.col("p.b.y").alias("y2"))
    p = p.withColumn("len", g.distance(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    w = Window.partitionBy("id").orderBy("seg_idx")
    return p.withColumn("m2", F.sum("len").over(w)).withColumn("m1", F.col("m2") - F.col("len")).withColumn("total", F.sum("len").over(Window.partitionBy("id")))


def snap_ends(edges: DataFrame, nodes: DataFrame, near: float = SNAP) -> tuple[DataFrame, DataFrame]:
    """edges whose ends lie on nodes, with start_node and end_node, and nodes (id, x, y) with those that were missing.

    As if the edges came one after the other by id, start before end: an end takes of the nodes in reach the one of the least id, one made for an end
    before it too; where none is in reach it becomes a node itself, numbered on."""
    ends = _ends(edges).select("id", "end", (F.col("id") * 2 + F.col("end")).alias("rank"), "x", "y")
    every = with_new_nodes(ends, nodes, near)
    # New ids grow with the rank of the end that made the node, so the least id in reach is the first node there was.
    # Both ends of an edge are picked at once, by its id, by which the edge is joined too.
    pick = lambda e, name: F.min(F.when(F.col("end") == e, F.struct(F.col("n.node").alias("node"), F.struct(F.col("n.nx").alias("x"), F.col("n.ny").alias("y")).alias("p")))).alias(name)
    moved = nodes_in_reach(ends, every, near, ["id", "end"]).groupBy("id").agg(pick(0, "__s"), pick(1, "__e"))
    out = edges.join(dealt(moved), "id").withColumns({"geom": g.set_end(g.set_start(F.col("geom"), F.col("__s.p")), F.col("__e.p")), "start_node": F.col("__s.node"), "end_node": F.col("__e.node")})
    return out.select(*edges.columns, *[c for c in ("start_node", "end_node") if c not in edges.columns]), every


def infer_neighbours(edges: DataFrame) -> DataFrame:
    """Null links of edges filled from the edges of the same road that share the node, the least id.

    Only the ids of edges without a link look for one, and only ids and nodes are looked through; the edges themselves are joined by their id."""
    after = edges.select("road_code", F.col("start_node").alias("end_node"), F.col("id").alias("n")).where("end_node is not null").groupBy("road_code", "end_node").agg(F.min("n").alias("__next"))
    before = edges.select("road_code", F.col("end_node").alias("start_node"), F.col("id").alias("n")).where("start_node is not null").groupBy("road_code", "start_node").agg(F.min("n").alias("__prev"))
    found = edges.where("next_edge_id is null").select("id", "road_code", "end_node").join(after, ["road_code", "end_node"]).groupBy("id").agg(F.min("__next").alias("__next"))
    led = edges.where("previous_edge_id is null").select("id", "road_code", "start_node").join(before, ["road_code", "start_node"]).groupBy("id").agg(F.min("__prev").alias("__prev"))
    out = edges.join(found, "id", "left").join(led, "id", "left")
    return out.withColumn("next_edge_id", F.coalesce("next_edge_id", "__next")).withColumn("previous_edge_id", F.coalesce("previous_edge_id", "__prev")).select(*edges.columns)


def bridge_deleted(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """What is left of the edges, links led past deleted ones: chains of deleted edges are crossed by pointer doubling.

    Only ids go along links; the edges themselves are joined by their id."""
    deleted = deleted.select("id").distinct()
    gone = settle(edges.join(deleted, "id", "left_semi").select("id", F.col("next_edge_id").alias("to")))
    longest = gone.count()
    for _ in range(max(1, longest.bit_length())):
        o = gone.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.lit(True).alias("hop"))
        step = gone.join(o, "to", "left")
        gone = settle(step.select("id", F.when(F.col("hop"), F.col("to2")).otherwise(F.col("to")).alias("to"), "hop"))
        if not gone.where("hop").limit(1).count():
            break
        gone = gone.drop("hop")
    jump = gone.select(F.col("id").alias("next_edge_id"), F.col("to").alias("__to"), F.lit(True).alias("__hop"))
    links = settle(edges.select("id", "next_edge_id", "previous_edge_id").join(deleted, "id", "left_anti").join(jump, "next_edge_id", "left").select("id", F.when(F.col("__hop"), F.col("__to")).otherwise(F.col("next_edge_id")).alias("__next"), "previous_edge_id"))
    back = links.where("__next is not null").select(F.col("__next").alias("id"), F.col("id").alias("__p")).groupBy("id").agg(F.min("__p").alias("__p"))
    lost = links.join(deleted.select(F.col("id").alias("previous_edge_id")), "previous_edge_id", "left_semi").select("id", F.lit(True).alias("__lost"))
    left = edges.join(links.select("id", "__next"), "id").join(back, "id", "left").join(lost, "id", "left")
    return left.withColumns({"next_edge_id": F.col("__next"), "previous_edge_id": F.coalesce("__p", F.when(F.col("__lost").isNull(), F.col("previous_edge_id")))}).select(*edges.columns)


def move_edge_road(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """edges with moves (id, new_road) applied: the old neighbours are linked past a moved edge, and it takes links of its new road by shared nodes."""
    kept = bridge_deleted(edges, moves)
    moved = edges.join(moves, "id").withColumn("road_code", F.col("new_road")).withColumn("previous_edge_id", F.lit(None).cast("long")).withColumn("next_edge_id", F.lit(None).cast("long")).select(*edges.columns)
    names = ["road_code", "start_node", "end_node", "previous_edge_id", "next_edge_id"]
    every = settle(kept.select("id", *names).unionByName(moved.select("id", *names)))
    rest = edges.select("id", *[c for c in edges.columns if c not in ("id", *names)])
    return infer_neighbours(every).join(rest, "id").select(*edges.columns)


def move_edges(edges: DataFrame, moves: DataFrame, markers: DataFrame) -> DataFrame:
    """move_edge_road, with the order of the roads that edges left or came to, and the references of their edges, computed anew."""
    moved = settle(move_edge_road(edges, moves))
    roads = edges.join(moves.select("id"), "id", "left_semi").select("road_code").unionByName(moves.select(F.col("new_road").alias("road_code"))).distinct()
    return with_references(moved, markers, roads)


def with_references(edges: DataFrame, markers: DataFrame, roads: DataFrame) -> DataFrame:
    """edges with the order and the references of the given roads' (road_code) edges computed anew, by their links."""
    own = edges.join(roads.select("road_code").distinct(), "road_code", "left_semi")
    order = ordered_edges(own)
    segments = road_segments(settle(own.select("id", "road_code", "geom").join(order, ["road_code", "id"])))
    return update_edge_references(edges, segments, markers, roads)


def marker_change_references(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """edges with the references of all roads of changed markers computed anew."""
    return with_references(edges, new, settle(changed_marker_roads(old, new)))


def intersections(edges: DataFrame, nodes: DataFrame, near: float = SNAP, cell: float = 100.0, ring=None) -> DataFrame:
    """(a, b, x, y): points where two edges cross, away from nodes by more than `near`, inside the ring if one is given."""
    seg = _flat(edges).select("id", "x1", "y1", "x2", "y2")
    seg = seg.withColumn("c", F.explode(g.cells_along(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], cell, 1e-6)))
    a, b = seg.toDF("a", "ax1", "ay1", "ax2", "ay2", "c"), seg.toDF("b", "bx1", "by1", "bx2", "by2", "c")
    pair = a.join(dealt(b), "c").where("a < b")
    of = lambda s: {k: F.col(s + k) for k in ("x1", "y1", "x2", "y2")}
    meets, x, y = g.crossing(of("a"), of("b"))
    hit = pair.where(meets).select("a", "b", F.round(x, 6).alias("x"), F.round(y, 6).alias("y")).distinct()
    if ring is not None:
        hit = hit.where(g.inside(F.col("x"), F.col("y"), ring))
    n = nodes.select(F.col("x").alias("nx"), F.col("y").alias("ny")).withColumn("c", F.explode(g.cells(F.col("nx"), F.col("ny"), F.col("nx"), F.col("ny"), 1.0, near)))
    at = hit.withColumn("c", F.struct(F.floor("x").alias("cx"), F.floor("y").alias("cy")))
    close = (at.c == n.c) & (g.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")) <= near)
    return at.join(dealt(n), close, "left_anti").select("a", "b", "x", "y")


def touching_nodes(edges: DataFrame, nodes: DataFrame, near: float = SNAP, cell: float = 100.0) -> DataFrame:
    """(edge_id, node_id, m): nodes within `near` of an edge's interior that are not its own, with the length at which they touch it."""
    seg = _flat(edges, "start_node", "end_node").withColumn("c", F.explode(g.cells_along(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], cell, near)))
    n = nodes.select(F.col("id").alias("node_id"), "x", "y").withColumn("c", F.struct(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")))
    s = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    pair = seg.join(dealt(n), "c").where("node_id != coalesce(start_node, -1) and node_id != coalesce(end_node, -1)").withColumn("t", g.clamp(g.fraction(F.col("x"), F.col("y"), *s)))
    pair = pair.withColumn("d", g.distance(F.col("x"), F.col("y"), s[0] + F.col("t") * (s[2] - s[0]), s[1] + F.col("t") * (s[3] - s[1]))).withColumn("m", F.col("m1") + F.col("t") * F.col("len"))
    pair = pair.where((F.col("d") <= near) & (F.col("m") > near) & (F.col("m") < F.col("total") - near))
    return pair.groupBy(F.col("id").alias("edge_id"), "node_id").agg(F.round(F.min_by("m", "d"), 6).alias("m"))


def split_edges(edges: DataFrame, touching: DataFrame) -> DataFrame:
    """(edge_id, piece, start_m, end_m, geom): each edge cut at all nodes that touch it at once; edges without keep one piece."""
    cuts = touching.groupBy(F.col("edge_id").alias("id")).agg(F.array_sort(F.collect_set("m")).alias("cuts"))
    seg = _flat(edges).join(cuts, "id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    bounds = F.concat(F.array(F.lit(0.0)), F.col("cuts"), F.array(F.col("total")))
    spans = F.zip_with(F.slice(bounds, 1, F.size(bounds) - 1), F.slice(bounds, 2, F.size(bounds) - 1), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    # Segments without a length are in no piece, but for an edge that has none at all.
    part = seg.select("id", "seg_idx", "x1", "y1", "x2", "y2", "len", "m1", "m2", "total", F.posexplode(spans).alias("piece", "s")).where("len > 0 and s.lo < m2 and s.hi > m1 or total = 0")
    share = lambda m: F.coalesce((m - F.col("m1")) / F.nullif(F.col("len"), F.lit(0.0)), F.lit(0.0))
    t1, t2 = share(F.greatest("s.lo", "m1")), share(F.least("s.hi", "m2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    row = F.struct("seg_idx", (F.col("x1") + t1 * dx).alias("x1"), (F.col("y1") + t1 * dy).alias("y1"), (F.col("x1") + t2 * dx).alias("x2"), (F.col("y1") + t2 * dy).alias("y2"))
    out = part.groupBy(F.col("id").alias("edge_id"), "piece", F.col("s.lo").alias("start_m"), F.col("s.hi").alias("end_m")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    geom = F.concat(F.transform("r", lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y"))), F.array(F.struct(F.element_at("r", -1)["x2"].alias("x"), F.element_at("r", -1)["y2"].alias("y"))))
    return out.select("edge_id", "piece", "start_m", "end_m", geom.alias("geom"))


def split_graph(edges: DataFrame, touching: DataFrame) -> DataFrame:
    """edges after all splits at once, as edits of the graph: the first piece keeps the edge's id, the others get new ones above all ids, in the
    order of edge and piece; pieces are linked to each other and to the neighbouring edges' nearest pieces, and meet at the touching nodes.

    Adds edge_id, piece, and start_m and end_m along the old edge."""
    pieces = settle(split_edges(edges, touching))
    top = edges.agg(F.max("id")).first()[0] or 0
    from linref.operators.importing import numbered

    # All is joined by the old edge's id, by which pieces and edges are dealt out once; only ids go along links.
    fresh = numbered(pieces.where("piece > 0").select("edge_id", "piece"), ["edge_id", "piece"], "new").groupBy("edge_id").agg((F.min("new") + top).alias("base"))
    size = pieces.groupBy("edge_id").agg(F.max("piece").alias("most"), F.count(F.when(F.col("piece") > 0, 1)).alias("more"))
    size = size.join(fresh, "edge_id", "left")
    led = size.where("more > 0").select(F.col("edge_id").alias("previous_edge_id"), (F.col("base") + F.col("more") - 1).alias("before"))
    led = edges.select(F.col("id").alias("edge_id"), "previous_edge_id").where("previous_edge_id is not null").join(led, "previous_edge_id").select("edge_id", "before")
    old = edges.select(F.col("id").alias("edge_id"), *[c for c in edges.columns if c not in ("id", "geom")]).join(size, "edge_id").join(led, "edge_id", "left").join(cut_nodes(touching, "edge_id"), "edge_id", "left")
    w = Window.partitionBy("edge_id").orderBy("piece")
    nth = F.sum(F.when(F.col("piece") > 0, 1).otherwise(0)).over(w)
    out = pieces.withColumn("nth", nth).join(old, "edge_id").withColumn("id", F.when(F.col("piece") > 0, F.col("base") + F.col("nth") - 1).otherwise(F.col("edge_id")))
    out = out.withColumns({"p": F.lag("id").over(w), "x": F.lead("id").over(w)})
    out = out.withColumns({"previous_edge_id": F.when(F.col("piece") == 0, F.coalesce("before", "previous_edge_id")).otherwise(F.col("p")), "next_edge_id": F.when(F.col("piece") < F.col("most"), F.col("x")).otherwise(F.col("next_edge_id")),
                           "start_node": F.when(F.col("piece") == 0, F.col("start_node")).otherwise(at_start("cuts")["node_id"]), "end_node": F.when(F.col("piece") < F.col("most"), at_end("cuts")["node_id"]).otherwise(F.col("end_node"))})
    return out.select(*edges.columns, "edge_id", "piece", "start_m", "end_m")


def cut_nodes(touching: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, cuts): of each edge the places m at which it is cut, in their order, with the least node_id there and what else is asked for. Piece k ends at the k-th of them, from 0."""
    every = touching.where("m is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("m", "node_id", *more))).alias("cuts"))
    return every.select(key, F.filter("cuts", lambda c, i: (i == 0) | (c["m"] != F.get(F.col("cuts"), i - 1)["m"])).alias("cuts"))


def at_start(cuts: str) -> Column:
    """Of the cuts of a row's edge the one at which its piece begins; null where that is the edge's own start."""
    return F.when(F.col("piece") > 0, F.get(F.col(cuts), F.col("piece") - 1))


def at_end(cuts: str) -> Column:
    return F.get(F.col(cuts), F.col("piece"))


def node_degree(edges: DataFrame) -> DataFrame:
    """(node, edges, roads, pass_through): how many edges and roads meet at each node; pass-through: two edges of one road."""
    both = edges.select(F.col("start_node").alias("node"), "id", "road_code").unionByName(edges.select(F.col("end_node").alias("node"), "id", "road_code")).where("node is not null")
    out = both.groupBy("node").agg(F.countDistinct("id").alias("edges"), F.countDistinct("road_code").alias("roads"))
    return out.withColumn("pass_through", (F.col("edges") == 2) & (F.col("roads") == 1))


def merge_pass_through(edges: DataFrame) -> DataFrame:
    """(id, road_code, merged, geom): runs of edges joined at pass-through nodes, under the least id of each run; see chains.merge_graph."""
    return merge_graph(edges).select("id", "road_code", "merged", "geom")


def merge_and_reference(edges: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges after all merges, with the references of the roads that have merged edges computed anew, and markers of which each marker 0 on a lost node
    lies at its merged edge's start."""
    merged, moved = merge_with_markers(edges, markers)
    moved = settle(moved)
    return with_references(merged, moved, merged.where("merged > 1").select("road_code").distinct()), moved


def split_and_reference(edges: DataFrame, touching: DataFrame, markers: DataFrame) -> DataFrame:
    """split_graph, with the order and the references of the roads that have split edges computed anew."""
    pieces = settle(split_graph(edges, touching))
    return with_references(pieces, markers, pieces.where("piece > 0").select("road_code").distinct())


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select(F.col("start_node").alias("id")).unionByName(edges.select(F.col("end_node").alias("id")))
    return nodes.join(used, "id", "left_anti")


def propagate_node_moves(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """edges whose end vertices follow the moved nodes (id, x, y)."""
    at = moved.select(F.col("id").alias("n"), F.struct("x", "y").alias("p"))
    out = edges.join(at.toDF("start_node", "__s"), "start_node", "left").join(at.toDF("end_node", "__e"), "end_node", "left")
    geom = F.when(F.col("__s").isNotNull(), g.set_start(F.col("geom"), F.col("__s"))).otherwise(F.col("geom"))
    return out.withColumn("geom", geom).withColumn("geom", F.when(F.col("__e").isNotNull(), g.set_end(F.col("geom"), F.col("__e"))).otherwise(F.col("geom"))).select(*edges.columns)


def moved_nodes(nodes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, x, y) of the nodes that the ends of changed edges have moved to: an edge whose end vertex is elsewhere takes its node along, the edge of the least id where several do."""
    def at(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("start_node").alias("node"), g.start_point(F.col("geom")).alias("p")), F.struct(F.lit(1).alias("end"), F.col("end_node").alias("node"), g.end_point(F.col("geom")).alias("p")))).alias("e")).select("id", "e.end", "e.node", F.col("e.p").alias(name))

    moved = at(new, "p").join(at(old, "was").drop("node"), ["id", "end"]).where("p != was and node is not null")
    to = moved.groupBy(F.col("node").alias("id")).agg(F.min_by("p", F.struct("id", "end")).alias("p")).select("id", "p.x", "p.y")
    return to.join(nodes.select("id"), "id", "left_semi")


def marker_zero_upkeep(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """markers with marker 0 at the start of each road's first edge: moved there, or made."""
    w = Window.partitionBy("road_code").orderBy("edge_order", "id")
    first = edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("road_code", g.start_point(F.col("geom")).alias("__p"))
    zero = (F.col("code") == 0) & (F.col("abscissa") == 0)
    out = markers.join(first, "road_code", "left").withColumn("geom", F.when(zero, F.coalesce("__p", "geom")).otherwise(F.col("geom"))).drop("__p")
    made = first.join(markers.where(zero), "road_code", "left_anti").select("road_code", F.lit(0).alias("code"), F.lit(0.0).alias("abscissa"), F.col("__p").alias("geom"))
    return out.select("road_code", "code", "abscissa", "geom").unionByName(made)


def changed_marker_roads(old: DataFrame, new: DataFrame) -> DataFrame:
    """Roads of markers that were added, removed, moved or recoded: old and new road alike."""
    flat = lambda df, by: df.select("road_code", "code", "abscissa", F.col("geom.x").alias("x"), F.col("geom.y").alias("y"), F.lit(by).alias("by"))
    both = flat(old, 1).unionByName(flat(new, -1)).groupBy("road_code", "code", "abscissa", "x", "y").agg(F.sum("by").alias("n"))
    return both.where("n != 0").select("road_code").distinct()


def ring_marker_check(markers: DataFrame, edges: DataFrame, roads: DataFrame, near: float = SNAP) -> DataFrame:
    """(road_code, code, problem): markers of roundabouts that are no marker 0, or that lie at no node of the ring."""
    rings = roads.where("road_type = 'roundabout'").select("road_code")
    m = markers.join(rings, "road_code", "left_semi")
    ends = _ends(edges.join(rings, "road_code", "left_semi")).select(F.col("road_code").alias("r"), "x", "y")
    close = (F.col("road_code") == F.col("r")) & (g.distance(F.col("geom.x"), F.col("geom.y"), F.col("x"), F.col("y")) <= near)
    far = m.join(ends, close, "left_anti").select("road_code", "code", F.lit("away from ring nodes").alias("problem"))
    return m.where("code != 0").select("road_code", "code", F.lit("not marker 0").alias("problem")).unionByName(far)


def ring_neighbours(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Links of ring edges from their geometric order alone; starts (road_code, node): the ring's order begins at the edge that leaves the node."""
    order = ordered_edges(edges.withColumn("next_edge_id", F.lit(None).cast("long")))
    if starts is not None:
        first = edges.select("road_code", "id", F.col("start_node").alias("node")).join(starts, ["road_code", "node"]).join(order, ["road_code", "id"]).groupBy("road_code").agg(F.min("edge_order").alias("first"))
        n = order.groupBy("road_code").agg(F.count("*").alias("n"))
        turned = (F.pmod(F.col("edge_order") - F.col("first"), F.col("n")) + 1).cast("int")
        order = order.join(first, "road_code", "left").join(n, "road_code").withColumn("edge_order", F.coalesce(turned, F.col("edge_order"))).drop("first", "n")
    return neighbours(order)


def orient_rings(edges: DataFrame) -> DataFrame:
    """Closed lines that run clockwise are reversed."""
    geom = F.col("geom")
    return edges.withColumn("geom", F.when(g.is_ring(geom) & (g.twice_area(geom) < 0), F.reverse(geom)).otherwise(geom))


def ring_lines(edges: DataFrame) -> DataFrame:
    """(road_code, ring): the closed line around each roundabout's edges, whatever their order and direction, counterclockwise."""
    return exterior_rings(edges, ["road_code"])


def clean_roundabouts(ring_edges: DataFrame, other: DataFrame) -> DataFrame:
    """(id, road_code, ring_road): edges of other roads that lie inside a ring grown by 0.1 m, so chords between its nodes too; see planar.lines_in_rings."""
    return lines_in_rings(other, ring_edges)


def clean_roundabout_graph(edges: DataFrame, roads: DataFrame, markers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """edges after cleaning of all roundabouts at once, and marker 0 at the leftmost start node of each that has none in markers.

    Edges of other roads inside a ring go, and links lead past them; at a ring's top node, where that is only its own (ring_top_node), the two
    edges become one with the lesser id."""
    rings = roads.where("road_type = 'roundabout'").select("road_code")
    ring, other = edges.join(rings, "road_code", "left_semi"), edges.join(rings, "road_code", "left_anti")
    left = settle(bridge_deleted(edges, clean_roundabouts(ring, other)))
    ring = left.join(rings, "road_code", "left_semi")
    top = ring_top_node(ring, left.join(rings, "road_code", "left_anti"))
    into, out_of = ring.join(top.withColumnRenamed("node", "end_node"), ["road_code", "end_node"]), ring.join(top.withColumnRenamed("node", "start_node"), ["road_code", "start_node"])
    pair = settle(into.select("road_code", F.struct(*into.columns).alias("a")).join(out_of.select("road_code", F.struct(*out_of.columns).alias("b")), "road_code").where("a.id != b.id"))
    kept = pair.select(F.explode(F.array("a.id", "b.id")).alias("was"), F.least("a.id", "b.id").alias("is"))
    joined = {"id": F.least("a.id", "b.id"), "previous_edge_id": F.col("a.previous_edge_id"), "start_node": F.col("a.start_node"), "geom": F.concat("a.geom", F.slice("b.geom", 2, F.size("b.geom") - 1))}
    made = pair.select(*[joined.get(c, F.col(f"b.{c}")).alias(c) for c in edges.columns])
    every = left.join(kept.select(F.col("was").alias("id")), "id", "left_anti").select(*edges.columns).unionByName(made)
    for link in ("previous_edge_id", "next_edge_id"):
        every = every.join(kept.select(F.col("was").alias(link), "is"), link, "left").withColumn(link, F.coalesce("is", link)).drop("is")
    start = g.start_point(F.col("geom"))
    zero = made.unionByName(ring.join(kept.select(F.col("was").alias("id")), "id", "left_anti").select(*edges.columns)).groupBy("road_code").agg(F.min_by(start, F.struct(start["x"], start["y"])).alias("geom"))
    if markers is not None:
        zero = zero.join(markers.where("code = 0").select("road_code"), "road_code", "left_anti")
    return every.select(*edges.columns), zero.select("road_code", F.lit(0).alias("code"), F.lit(0.0).alias("abscissa"), "geom")


def ring_starts(markers: DataFrame, edges: DataFrame, roads: DataFrame, near: float = SNAP) -> DataFrame:
    """(road_code, node): of each roundabout the node at its marker 0, from which its order is to start (see ring_neighbours)."""
    m = markers.where("code = 0").join(roads.where("road_type = 'roundabout'").select("road_code"), "road_code", "left_semi").select("road_code", F.col("geom.x").alias("mx"), F.col("geom.y").alias("my"))
    at = edges.select("road_code", "start_node", g.start_point(F.col("geom")).alias("p")).join(m, "road_code").withColumn("d", g.distance(F.col("p.x"), F.col("p.y"), F.col("mx"), F.col("my"))).where(F.col("d") <= near)
    return at.groupBy("road_code").agg(F.min_by("start_node", F.struct("d", "start_node")).alias("node"))


def ring_top_node(ring_edges: DataFrame, other: DataFrame) -> DataFrame:
    """(road_code, node): each ring's highest node, if no other road uses it and both its edges lie below it."""
    used = other.select(F.col("start_node").alias("node")).unionByName(other.select(F.col("end_node").alias("node")))
    ys = lambda i: F.element_at("geom", i)["y"]
    at = ring_edges.select("road_code", F.col("start_node").alias("node"), ys(1).alias("y"), ys(2).alias("near")).unionByName(ring_edges.select("road_code", F.col("end_node").alias("node"), ys(-1).alias("y"), ys(-2).alias("near")))
    n = at.groupBy("road_code", "node").agg(F.max("y").alias("y"), F.every(F.col("near") < F.col("y")).alias("below")).join(used, "node", "left_anti")
    return n.groupBy("road_code").agg(F.max_by(F.struct("node", "below"), F.struct("y", "node")).alias("b")).where("b.below").select("road_code", "b.node")
