"""The plane that edges divide: faces, lines in rings, and the overlay of crossing edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.functions import geometry as g
from linref.functions.lineage import dealt, settle
from linref.operators.clusters import with_new_nodes
from linref.operators.order import walked

#: Bands of so many metres of y in which ring segments meet the points whose rays may cross them.
BAND = 20.0


# Faces


def _halves(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Both ways along each edge: half (2 id + 1 along, 2 id against), the nodes it leaves and comes to, the angle at which it leaves, and the
    angle at which its other way leaves the node that it comes to. Nodes are coordinates on a millimetre grid."""
    mm = lambda p: F.struct(F.round(p["x"] * 1000).cast("long").alias("x"), F.round(p["y"] * 1000).cast("long").alias("y"))
    way = lambda line: F.atan2(line[1]["y"] - line[0]["y"], line[1]["x"] - line[0]["x"])
    clean = F.filter("geom", lambda p, i: (i == 0) | (p != F.get(F.col("geom"), i - 1)))
    e = edges.select("id", *keys, clean.alias("line")).where("size(line) > 1")
    both = F.explode(F.array(F.struct(F.lit(1).alias("d"), F.col("line").alias("l")), F.struct(F.lit(0).alias("d"), F.reverse("line").alias("l")))).alias("b")
    h = e.select("id", *keys, both).select("id", *keys, (F.col("id") * 2 + F.col("b.d")).alias("half"), F.col("b.l").alias("line"))
    return h.select("id", *keys, "half", mm(g.start_point(F.col("line"))).alias("leaves"), mm(g.end_point(F.col("line"))).alias("comes"), way(F.col("line")).alias("angle"), way(F.reverse("line")).alias("back"), "line")


def _boundaries(halves: DataFrame, keys: list[str]) -> DataFrame:
    """(half, face, at): the boundary, named by its least half, that each half is part of, and its place there.

    At the node that a half comes to, the boundary turns into the way out that is next clockwise from the half's own way back, so a face lies to the left."""
    w = Window.partitionBy(*keys, "leaves").orderBy(F.desc("angle"), "half")
    every = Window.partitionBy(*keys, "leaves")
    turn = halves.withColumn("after", F.coalesce(F.lead("half").over(w), F.min_by("half", F.struct(-F.col("angle"), "half")).over(every)))
    # turn: after each way out the next one clockwise. A half is followed by the one after its own way back.
    follows = turn.select(F.when(F.pmod("half", F.lit(2)) == 1, F.col("half") - 1).otherwise(F.col("half") + 1).alias("to"), F.col("after").alias("id"), F.lit("").alias("road_code"))
    done, _ = walked(follows.select("id", "road_code", "to"))
    return settle(done.select(F.col("id").alias("half"), F.col("head").alias("face"), F.col("steps").alias("at")))


def faces(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, face, area, n_points, ring) of all faces that edges (id, geom) bound, whatever their order and direction: closed counterclockwise lines.

    Edges meet at equal end points alone, see overlay. What bounds the same face on both sides, dangles and bridges, is left out. With keys
    (road_code, say) edges of different keys do not meet. The boundary of a group from outside has a negative area: it is its exterior ring, clockwise."""
    keys = keys or []
    halves = settle(_halves(edges, keys))
    first = _boundaries(halves, keys)
    sides = halves.select("id", "half").join(first, "half").groupBy("id").agg((F.min("face") != F.max("face")).alias("apart"))
    halves = settle(halves.join(sides.where("apart"), "id", "left_semi"))
    part = halves.join(_boundaries(halves, keys), "half")
    whole = part.groupBy(*keys, "face").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("s"))
    ring = F.flatten(F.transform("s", lambda p: F.slice(p["line"], 1, F.size(p["line"]) - 1)))
    ring = F.concat(ring, F.array(F.element_at("s", 1)["line"][0]))
    out = whole.select(*keys, "face", ring.alias("ring"))
    # Coordinates are taken from the ring's first point on, so that large ones cost no digits.
    x0, y0 = F.col("ring")[0]["x"], F.col("ring")[0]["y"]
    area = F.aggregate(g.pieces(F.col("ring")), F.lit(0.0), lambda s, p: s + (p["a"]["x"] - x0) * (p["b"]["y"] - y0) - (p["b"]["x"] - x0) * (p["a"]["y"] - y0)) / 2
    return out.select(*keys, "face", area.alias("area"), (F.size("ring") - 1).alias("n_points"), "ring")


def exterior_rings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring): the outer boundary of each key's edges, counterclockwise, of the largest part where there are several."""
    out = faces(edges, keys).where("area < 0").groupBy(*keys).agg(F.min_by("ring", F.struct("area", "face")).alias("ring"))
    return out.select(*keys, F.reverse("ring").alias("ring"))


# Lines in rings


def _segments(edges: DataFrame, *names: str) -> DataFrame:
    p = edges.select(*names, F.posexplode(g.pieces(F.col("geom"))).alias("seg", "p"))
    return p.select(*names, "seg", F.col("p.a.x").alias("x1"), F.col("p.a.y").alias("y1"), F.col("p.b.x").alias("x2"), F.col("p.b.y").alias("y2"))


def points_inside(points: DataFrame, rings: DataFrame) -> DataFrame:
    """points (pid, ring, x, y) with `inside` their ring, of segments (ring, x1, y1, x2, y2) in any order: whether a ray to the right crosses an odd number of them."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    s = rings.where("y1 != y2").withColumn("band", F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND))))
    at = points.withColumn("band", F.floor(F.col("y") / BAND))
    y = F.col("y")
    hit = at.join(s, ["ring", "band"]).where(((F.col("y1") > y) != (F.col("y2") > y)) & (F.col("x") < F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
    odd = hit.groupBy("pid", "ring").agg((F.count("*") % 2 == 1).alias("inside"))
    return points.join(odd, ["pid", "ring"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def covered(pairs: DataFrame, near: float | str, *keys: str) -> DataFrame:
    """(keys, lo, hi): the part of segment x1 to y2 (0 at its start, 1 at its end) that is within `near` (metres, or a column) of segment bx1 to by2; no row where there is none.

    What is near a segment is convex, so the part is one: from the first to the last point near either end or near the side."""
    c, near = F.col, F.col(near) if isinstance(near, str) else F.lit(near)
    p = pairs.withColumns({"dx": c("x2") - c("x1"), "dy": c("y2") - c("y1"), "bx": c("bx2") - c("bx1"), "by": c("by2") - c("by1")})
    p = p.withColumns({"l2": c("dx") * c("dx") + c("dy") * c("dy"), "len": F.sqrt(c("bx") * c("bx") + c("by") * c("by"))})
    # Near an end: where a circle is met. a: the point's place along the segment, k: how far outside the circle the segment's start is, squared.
    for n, (x, y) in {"1": ("bx1", "by1"), "2": ("bx2", "by2")}.items():
        p = p.withColumns({f"a{n}": (c(x) - c("x1")) * c("dx") + (c(y) - c("y1")) * c("dy"), f"k{n}": (c(x) - c("x1")) * (c(x) - c("x1")) + (c(y) - c("y1")) * (c(y) - c("y1")) - near * near})
        p = p.withColumn(f"r{n}", c(f"a{n}") * c(f"a{n}") - c("l2") * c(f"k{n}"))
        at = lambda sign, n=n: F.when((c("l2") > 0) & (c(f"r{n}") >= 0), (c(f"a{n}") + sign * F.sqrt(F.greatest(f"r{n}", F.lit(0.0)))) / c("l2")).when((c("l2") == 0) & (c(f"k{n}") <= 0), F.lit(0.5 + sign * 0.5))
        p = p.withColumns({f"lo{n}": at(-1), f"hi{n}": at(1)})
    # Near the side: where both the place along the other segment and the distance from its line are within bounds; u: at the start, v: by the way to the end.
    unit = lambda n: F.coalesce(c(n) / F.nullif("len", F.lit(0.0)), F.lit(0.0))
    p = p.withColumns({"ux": unit("bx"), "uy": unit("by")})
    p = p.withColumns({"u1": (c("x1") - c("bx1")) * c("ux") + (c("y1") - c("by1")) * c("uy"), "v1": c("dx") * c("ux") + c("dy") * c("uy"), "u2": (c("y1") - c("by1")) * c("ux") - (c("x1") - c("bx1")) * c("uy"), "v2": c("dy") * c("ux") - c("dx") * c("uy")})
    for n, least, most in (("1", F.lit(0.0), c("len")), ("2", -near, near)):
        p = p.withColumns({f"s{n}": (least - c(f"u{n}")) / F.nullif(c(f"v{n}"), F.lit(0.0)), f"t{n}": (most - c(f"u{n}")) / F.nullif(c(f"v{n}"), F.lit(0.0)), f"in{n}": (c(f"u{n}") >= least) & (c(f"u{n}") <= most)})
        p = p.withColumns({f"from{n}": F.when(c(f"s{n}").isNotNull(), F.least(f"s{n}", f"t{n}")).when(c(f"in{n}"), F.lit(0.0)), f"to{n}": F.when(c(f"s{n}").isNotNull(), F.greatest(f"s{n}", f"t{n}")).when(c(f"in{n}"), F.lit(1.0))})
    p = p.withColumn("side", (c("len") > 0) & c("from1").isNotNull() & c("from2").isNotNull() & (F.greatest("from1", "from2") <= F.least("to1", "to2")))
    p = p.withColumns({"lo3": F.when(c("side"), F.greatest("from1", "from2")), "hi3": F.when(c("side"), F.least("to1", "to2"))})
    # Settled, as a filter on lo would be pushed down through all of the above and take a copy of it for each time that it is used.
    out = settle(p.select(*keys, F.least("lo1", "lo2", "lo3").alias("lo"), F.greatest("hi1", "hi2", "hi3").alias("hi")))
    return out.where("lo is not null").select(*keys, F.greatest("lo", F.lit(0.0)).alias("lo"), F.least("hi", F.lit(1.0)).alias("hi")).where("lo <= hi")


def stretches_between(parts: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """(key, t1, t2): what the parts (key, lo, hi) of segments (key) leave of each, from 0 to 1: before the first part, after the last, and where a part begins
    beyond all that began earlier."""
    end = lambda v: F.struct(F.lit(v).alias("lo"), F.lit(v).alias("hi"))
    ends = segments.select(*key, F.explode(F.array(end(0.0), end(1.0))).alias("e")).select(*key, "e.lo", "e.hi")
    w = Window.partitionBy(*key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return parts.unionByName(ends).withColumn("past", F.max("hi").over(w)).where("lo > past + 1e-9").select(*key, F.col("past").alias("t1"), F.col("lo").alias("t2"))


def lines_in_rings(edges: DataFrame, ring_edges: DataFrame, near: float = 0.1, cell: float = 200.0) -> DataFrame:
    """(id, road_code, ring_road): edges of which every point lies inside a ring of another road or within `near` of it.

    A ring is the edges of a road (road_code), in any order; a road of which an end point is met by an odd number of ends is no ring.

    Each segment of an edge is covered by what of it is near a ring segment; of each stretch between, all of which is farther away, one point
    tells whether it is inside, by the crossings of a ray with the ring's segments. Rings are joined by segment, never gathered in a row."""
    ends = ring_edges.select("road_code", F.explode(F.array(g.start_point(F.col("geom")), g.end_point(F.col("geom")))).alias("p"))
    mm = lambda c: F.round(F.col(c) * 1000).cast("long")
    ends = ends.select("road_code", mm("p.x").alias("x"), mm("p.y").alias("y"))
    open_ = ends.groupBy("road_code", "x", "y").agg(F.count("*").alias("n")).where("n % 2 = 1").select("road_code").distinct()
    closed = ring_edges.join(open_, "road_code", "left_anti")
    segs = settle(_segments(closed, "road_code").select(F.col("road_code").alias("ring"), "x1", "y1", "x2", "y2"))
    span = lambda c: [F.least(F.min(f"{c}1"), F.min(f"{c}2")).alias(f"{c}lo"), F.greatest(F.max(f"{c}1"), F.max(f"{c}2")).alias(f"{c}hi")]
    boxes = segs.groupBy("ring").agg(*span("x"), *span("y"))
    boxes = boxes.withColumn("c", F.explode(g.cells(F.col("xlo"), F.col("ylo"), F.col("xhi"), F.col("yhi"), cell, near)))
    of = lambda c, f: f(F.transform("geom", lambda p: p[c]))
    p = g.start_point(F.col("geom"))
    e = edges.select("id", "road_code", "geom", F.struct(F.floor(p["x"] / cell).alias("cx"), F.floor(p["y"] / cell).alias("cy")).alias("c"), of("x", F.array_min).alias("x_lo"), of("x", F.array_max).alias("x_hi"), of("y", F.array_min).alias("y_lo"), of("y", F.array_max).alias("y_hi"))
    r = near
    pair = settle(e.join(boxes, "c").where("road_code != ring").where((F.col("x_lo") >= F.col("xlo") - r) & (F.col("x_hi") <= F.col("xhi") + r) & (F.col("y_lo") >= F.col("ylo") - r) & (F.col("y_hi") <= F.col("yhi") + r)).select("id", "road_code", "ring", "geom"))
    mine = settle(_segments(pair, "id", "ring"))
    grid = 20.0
    s, b = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("bx1", "by1", "bx2", "by2")]
    border = segs.toDF("ring", "bx1", "by1", "bx2", "by2").withColumn("c", F.explode(g.cells_along(*b, grid, near)))
    near_by = covered(mine.withColumn("c", F.explode(g.cells_along(*s, grid, near))).join(border, ["ring", "c"]), near, "id", "ring", "seg").distinct()
    key = ["id", "ring", "seg"]
    gaps = stretches_between(near_by, mine, key).select(*key, ((F.col("t1") + F.col("t2")) / 2).alias("t"))
    at = gaps.join(mine, key).select(F.struct("id", "seg", "t").alias("pid"), "ring", (s[0] + F.col("t") * (s[2] - s[0])).alias("x"), (s[1] + F.col("t") * (s[3] - s[1])).alias("y"))
    out = points_inside(at, segs).where("not inside").select(F.col("pid.id").alias("id"), "ring").distinct()
    return pair.join(out, ["id", "ring"], "left_anti").select("id", "road_code", F.col("ring").alias("ring_road"))


# Overlay


def crossings(edges: DataFrame, cell: float = 100.0, ring=None) -> DataFrame:
    """(a, b, x, y) of all points where two edges cross or touch, a before b; inside the ring if one is given."""
    seg = _segments(edges, "id").withColumn("c", F.explode(g.cells_along(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], cell, 1e-6))).drop("seg")
    a, b = seg.toDF("a", "ax1", "ay1", "ax2", "ay2", "c"), seg.toDF("b", "bx1", "by1", "bx2", "by2", "c")
    of = lambda s: {k: F.col(s + k) for k in ("x1", "y1", "x2", "y2")}
    meets, x, y = g.crossing(of("a"), of("b"))
    hit = a.join(dealt(b), "c").where("a < b").where(meets).select("a", "b", F.round(x, 6).alias("x"), F.round(y, 6).alias("y")).distinct()
    return hit if ring is None else hit.where(g.inside(F.col("x"), F.col("y"), ring))


def _apart(cuts: Column, total: Column, near: float) -> Column:
    """Of cuts (node, m, x, y), in the order of their nodes, those at least `near` from both ends and from all taken before."""
    far = lambda got, c: F.forall(got, lambda o: F.abs(o["m"] - c["m"]) >= near)
    kind = "array<struct<node:bigint,m:double,x:double,y:double>>"
    ok = F.filter(F.array_sort(cuts), lambda c: (c["m"] >= near) & (total - c["m"] >= near))
    return F.aggregate(ok, F.array().cast(kind), lambda got, c: F.when(far(got, c), F.concat(got, F.array(c))).otherwise(got))


def overlay(edges: DataFrame, nodes: DataFrame, roads: DataFrame | None = None, near: float = 0.5, ring=None, changed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """edges (id, road_code, start_node, end_node, previous_edge_id, next_edge_id, geom, ...) cut wherever two of them cross or a node touches them, all in one pass, and
    nodes (id, x, y) with those at the crossings. changed (id): only crossings of these edges count, as when they are new.

    Crossings become nodes in the order of the edges that cross, the later edge first; one within `near` of a node, or of a node made before, is
    that node. An edge is cut at all nodes within `near` of it, taken in the order of their ids; not where either piece, or the stretch to a cut taken
    before, would be shorter than `near`. Pieces end in the nodes themselves. The first piece keeps the id, the others have new ones above all, in
    the order of edge and piece; a piece that lies on a whole edge or an earlier piece (either way round, on a 0.1 m grid) is not made again: links lead to that one.
    Cumulatives, where edges have them, go on along the pieces; other columns are the edge's own. Edges of roundabouts (roads: road_code, road_type) have no links
    between their pieces.

    Adds edge_id, piece, and start_m and end_m along the old edge."""
    from linref.operators.importing import numbered

    hit = crossings(edges, ring=ring)
    if changed is not None:
        new = changed.select(F.col("id").alias("__n")).distinct()
        hit = hit.withColumn("__n", F.explode(F.array("a", "b"))).join(new, "__n", "left_semi").select("a", "b", "x", "y").distinct()
    found = numbered(hit.select(F.col("b").alias("late"), F.col("a").alias("early"), "x", "y"), ["late", "early", "x", "y"], "rank")
    every = with_new_nodes(found.select("rank", "x", "y"), nodes, near)
    touching = settle(_touching(edges, every, near))
    total = g.length(F.col("geom"))
    taken = touching.groupBy(F.col("edge_id").alias("id")).agg(F.collect_list(F.struct("node", "m", "x", "y")).alias("c")).join(edges.select("id", total.alias("total")), "id")
    cuts = settle(taken.select("id", F.explode(_apart(F.col("c"), F.col("total"), near)).alias("c")).select(F.col("id").alias("edge_id"), F.col("c.node").alias("node_id"), F.col("c.m").alias("m"), F.col("c.x").alias("nx"), F.col("c.y").alias("ny")))
    out = _pieces(edges, cuts, roads)
    used = out.select(F.col("start_node").alias("id")).unionByName(out.select(F.col("end_node").alias("id"))).distinct()
    return out, nodes.select("id", "x", "y").unionByName(every.join(nodes.select("id"), "id", "left_anti").join(used, "id", "left_semi"))


def _touching(edges: DataFrame, nodes: DataFrame, near: float) -> DataFrame:
    """(edge_id, node, m, x, y): the nodes within `near` of each edge that are not its own, with their place along it and their point."""
    from linref.operators.topology import touching_nodes

    at = touching_nodes(edges, nodes, near)
    return at.join(dealt(nodes.select(F.col("id").alias("node_id"), "x", "y")), "node_id").select("edge_id", F.col("node_id").alias("node"), "m", "x", "y")


def _pieces(edges: DataFrame, cuts: DataFrame, roads: DataFrame | None) -> DataFrame:
    from linref.operators.topology import at_end, at_start, cut_nodes, split_graph

    lone = None if roads is None else roads.where("road_type = 'roundabout'").select("road_code")
    own = split_graph(edges, cuts.select("edge_id", "node_id", "m"))
    # By the edge's id, by which pieces are dealt out already.
    at = cut_nodes(cuts.select("edge_id", "node_id", "m", F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias("p")), "edge_id", "p")
    own = own.join(at, "edge_id", "left").withColumns({"__s": at_start("cuts")["p"], "__e": at_end("cuts")["p"]}).drop("cuts")
    geom = F.when(F.col("__s").isNotNull(), g.set_start(F.col("geom"), F.col("__s"))).otherwise(F.col("geom"))
    own = own.withColumn("geom", geom).withColumn("geom", F.when(F.col("__e").isNotNull(), g.set_end(F.col("geom"), F.col("__e"))).otherwise(F.col("geom"))).drop("__s", "__e")
    if "start_cumulative" in edges.columns:
        own = own.withColumns({"start_cumulative": F.col("start_cumulative") + F.col("start_m"), "end_cumulative": F.col("start_cumulative") + F.col("end_m")})
    own = settle(own)
    # A piece that is there already is not made again.
    grid = g.on_grid(F.col("geom"))
    same = own.withColumn("__k", F.least(grid, F.reverse(grid)))
    first = same.groupBy("__k").agg(F.min(F.struct((F.col("piece") > 0).alias("new"), "id"))["id"].alias("__keep"))
    same = same.join(first, "__k").select(F.col("id"), "piece", "__keep")
    twin = settle(same.where("piece > 0 and id != __keep").select("id", "__keep"))
    out = own.join(twin, "id", "left_anti")
    for link in ("previous_edge_id", "next_edge_id"):
        out = out.join(twin.toDF(link, "__keep"), link, "left").withColumn(link, F.coalesce("__keep", link)).drop("__keep")
    if lone is not None:
        out = out.join(lone.withColumn("__r", F.lit(True)), "road_code", "left")
        most = own.groupBy("edge_id").agg((F.count("*") > 1).alias("__cut"))
        out = out.join(most, "edge_id").withColumns({link: F.when(F.col("__r") & F.col("__cut"), F.lit(None)).otherwise(F.col(link)) for link in ("previous_edge_id", "next_edge_id")}).drop("__r", "__cut")
    return settle(out.select(*edges.columns, "edge_id", "piece", "start_m", "end_m"))
