"""The measured segments of roads, on which all linear referencing is joins and arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.functions import geometry as g
from linref.functions.lineage import settle

#: Roads of at most so many segments, or markers, are looked through whole, row by row of the road; those with more by cells or reaches.
SHORT = 32
SEGMENT = ["road_code", "edge_id", "edge_order", "seg_idx", "kind", "x1", "y1", "x2", "y2", "len", "mg1", "mg2", "mn1", "mn2"]


#: So many edges of a road are measured in one task; see road_segments.
BLOCK = 4096


def road_segments(edges: DataFrame) -> DataFrame:
    """One row per segment of each road, in order of its edges, and one per gap between an edge's end and the next edge's start.

    edges: id, road_code, edge_order, geom. mg1, mg2: running length with gaps; mn1, mn2: without. Running lengths are taken within blocks of a road's
    edges; then the blocks' totals are summed up along the road, one row per block, and carried into each block. So a road is as many tasks as it has blocks."""
    parts = edges.select("road_code", F.col("id").alias("edge_id"), "edge_order", F.posexplode(g.pieces(F.col("geom"))).alias("seg_idx", "p")).select(
        "road_code", "edge_id", "edge_order", "seg_idx", F.col("p.a.x").alias("x1"), F.col("p.a.y").alias("y1"), F.col("p.b.x").alias("x2"), F.col("p.b.y").alias("y2"))
    block = F.floor(F.col("edge_order") / BLOCK)
    one = not edges.where(F.coalesce(block != 0, F.lit(True))).limit(1).count()  # then nothing is to be carried from block to block
    parts = parts.withColumn("block", block)
    order = ["edge_order", "edge_id", "seg_idx"]
    w = Window.partitionBy("road_code").orderBy(*order) if one else Window.partitionBy("road_code", "block").orderBy(*order)
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}
    parts = parts.withColumn("len", g.distance(**c)).withColumn("px", F.lag("x2").over(w)).withColumn("py", F.lag("y2").over(w))
    parts = parts.withColumn("gap", F.coalesce(g.distance(F.col("px"), F.col("py"), c["x1"], c["y1"]), F.lit(0.0)))
    parts = parts.withColumn("mg2", F.sum(F.col("len") + F.col("gap")).over(w)).withColumn("mn2", F.sum("len").over(w))
    return _with_gaps(parts if one else _carried(parts, order))


def _carried(parts: DataFrame, order: list[str]) -> DataFrame:
    """parts with the running lengths of the blocks before each carried into it."""
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}
    # The blocks: how long each is, where it begins and ends, and what comes before it.
    at = F.struct(*order)
    blocks = parts.groupBy("road_code", "block").agg(F.max("mg2").alias("bg"), F.max("mn2").alias("bn"), F.min_by(F.struct("x1", "y1"), at).alias("first"), F.max_by(F.struct("x2", "y2"), at).alias("last"))
    along = Window.partitionBy("road_code").orderBy("block")
    blocks = blocks.withColumn("prev", F.lag("last").over(along)).withColumn("gap0", F.coalesce(g.distance(F.col("prev.x2"), F.col("prev.y2"), F.col("first.x1"), F.col("first.y1")), F.lit(0.0)))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("road_code", "block", "prev", "gap0", (F.coalesce(F.sum(F.col("bg") + F.col("gap0")).over(before), F.lit(0.0)) + F.col("gap0")).alias("g0"), F.coalesce(F.sum("bn").over(before), F.lit(0.0)).alias("n0"))
    parts = parts.join(blocks, ["road_code", "block"])
    opens = F.col("px").isNull()
    return parts.withColumns({"px": F.when(opens, F.col("prev.x2")).otherwise(F.col("px")), "py": F.when(opens, F.col("prev.y2")).otherwise(F.col("py")), "gap": F.when(opens, F.col("gap0")).otherwise(F.col("gap")), "mg2": F.col("mg2") + F.col("g0"), "mn2": F.col("mn2") + F.col("n0")})


def _with_gaps(parts: DataFrame) -> DataFrame:
    """The measured segments, and a row for each gap before one."""
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}
    mg1, mn1 = F.col("mg2") - F.col("len"), F.col("mn2") - F.col("len")
    own = F.struct(F.lit("edge").alias("kind"), c["x1"], c["y1"], c["x2"], c["y2"], F.col("len"), mg1.alias("mg1"), F.col("mg2"), mn1.alias("mn1"), F.col("mn2"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("px").alias("x1"), F.col("py").alias("y1"), c["x1"].alias("x2"), c["y1"].alias("y2"), F.col("gap").alias("len"), (mg1 - F.col("gap")).alias("mg1"), mg1.alias("mg2"), mn1.alias("mn1"), mn1.alias("mn2"))
    rows = parts.select("road_code", "edge_id", "edge_order", "seg_idx", F.explode(F.when(F.col("gap") > 0, F.array(own, gap)).otherwise(F.array(own))).alias("s"))
    return rows.select("road_code", "edge_id", "edge_order", "seg_idx", "s.*")


def spatial_road(segments: DataFrame) -> DataFrame:
    """(road_code, parts): each road's line with measures, its parts between gaps in order, of points with the length so far."""
    rows = spatial_parts(segments).groupBy("road_code").agg(F.sort_array(F.collect_list(F.struct("part", "points"))).alias("p"))
    return rows.select("road_code", F.transform("p", lambda p: p["points"]).alias("parts"))


def numbered_parts(segments: DataFrame) -> DataFrame:
    """The edge segments with `part`: how many gaps of their road lie before them, counted within blocks of edges first, see road_segments."""
    block = F.floor(F.col("edge_order") / BLOCK)
    gap, last = F.when(F.col("kind") == "gap", 1).otherwise(0), ["edge_order", "edge_id", "seg_idx", F.desc("kind")]
    if not segments.where(F.coalesce(block != 0, F.lit(True))).limit(1).count():
        return segments.withColumn("part", F.sum(gap).over(Window.partitionBy("road_code").orderBy(*last))).where("kind = 'edge'")
    rows = segments.withColumn("block", block)
    w = Window.partitionBy("road_code", "block").orderBy(*last)  # a gap comes before the segment that it leads to
    blocks = rows.groupBy("road_code", "block").agg(F.sum(gap).alias("n"))
    before = Window.partitionBy("road_code").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("road_code", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.withColumn("part", F.sum(gap).over(w)).where("kind = 'edge'").join(blocks, ["road_code", "block"]).withColumn("part", F.col("part") + F.col("before")).drop("block", "before")


def spatial_parts(segments: DataFrame) -> DataFrame:
    """(road_code, part, points): each road's line with measures, cut at its gaps: a row per part."""
    rows = numbered_parts(segments).groupBy("road_code", "part").agg(F.sort_array(F.collect_list(F.struct("edge_order", "edge_id", "seg_idx", "x1", "y1", "mn1", "x2", "y2", "mn2"))).alias("s"))
    first = F.element_at("s", 1)
    points = F.concat(F.array(F.struct(first["x1"].alias("x"), first["y1"].alias("y"), first["mn1"].alias("m"))), F.transform("s", lambda p: F.struct(p["x2"].alias("x"), p["y2"].alias("y"), p["mn2"].alias("m"))))
    return rows.select("road_code", F.col("part").cast("int").alias("part"), points.alias("points"))


def candidates(points: DataFrame, segments: DataFrame, reach: float = 50.0, own_road: bool = False) -> DataFrame:
    """(pid, road_code, e, l) of each road within reach of each point: e, its nearest edge (d, road_code, edge_order, edge_id, seg_idx, left), and l, the nearest place on its
    joined line (..., mg, mn), gaps included; with own_road of the point's own road alone.

    A grid cell joins points and segments as an equi-join: cells are twice the reach wide, so a point looks into four at most, and a segment is
    only in those that it runs through."""
    cell = 2 * reach
    seg = segments.select(F.col("road_code").alias("s_road"), "edge_id", "edge_order", "seg_idx", "kind", "x1", "y1", "x2", "y2", "len", "mg1", "mn1", "mn2")
    seg = g.in_cells(seg, "x1", "y1", "x2", "y2", cell, 1e-6, step=2 * cell)
    own = [F.col("road_code").alias("s_road")] if own_road else []
    pts = g.in_cells(points.select("pid", *own, "x", "y"), "x", "y", "x", "y", cell, reach)
    pair = pts.join(seg, ["cx", "cy", *(["s_road"] if own_road else [])])
    p, s = (F.col("x"), F.col("y")), [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    pair = pair.withColumn("raw", g.fraction(*p, *s)).withColumn("t", g.clamp(F.col("raw")))
    pair = pair.withColumn("d", g.distance(*p, s[0] + F.col("t") * (s[2] - s[0]), s[1] + F.col("t") * (s[3] - s[1]))).where(F.col("d") <= reach)
    pair = pair.withColumn("left", (g.cross(*p, *s) > 0) & (F.col("raw") >= 0) & (F.col("raw") <= 1))
    order = ["d", "s_road", "edge_order", "edge_id", "seg_idx"]
    is_gap = F.when(F.col("kind") == "edge", 0).otherwise(1).alias("gap")
    place = F.struct(*order, is_gap, (F.col("mg1") + F.col("t") * F.col("len")).alias("mg"), (F.col("mn1") + F.col("t") * (F.col("mn2") - F.col("mn1"))).alias("mn"))
    found = pair.groupBy("pid", F.col("s_road").alias("road_code")).agg(F.min(F.when(F.col("kind") == "edge", F.struct(*order, "left"))).alias("e"), F.min(place).alias("l"))
    return found.where("e is not null")


def long_roads(rows: DataFrame, most: int = SHORT) -> DataFrame | None:
    """(road_code): the roads of more than so many rows, None if there are none. Small next to rows; where it is of any use, rows are settled."""
    long = rows.groupBy("road_code").agg(F.count("*").alias("n")).where(F.col("n") > most).select("road_code")
    if not long.limit(1).count():
        return None
    long = settle(long)
    return F.broadcast(long) if long.count() <= 1_000_000 else long


def apart(df: DataFrame, roads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df that are not on the roads, and those that are."""
    return df.join(roads, "road_code", "left_anti"), df.join(roads, "road_code", "left_semi")


def _on_short_roads(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """locate where each road has few segments: a point looks through all of its own road's, which stand in one row. Where points and
    segments are dealt out by road alike, nothing is shuffled."""
    columns = ["edge_order", "edge_id", "seg_idx", "kind", "x1", "y1", "x2", "y2", "len", "mg1", "mn1", "mn2"]
    road = segments.groupBy("road_code").agg(F.collect_list(F.struct(*columns)).alias("__s"))
    p = (F.col("x"), F.col("y"))
    ends = lambda s: [s[n] for n in ("x1", "y1", "x2", "y2")]
    raw = F.transform("__s", lambda s: F.struct(s.alias("s"), g.fraction(*p, *ends(s)).alias("raw")))
    t = F.transform(raw, lambda r: F.struct(r["s"].alias("s"), r["raw"].alias("raw"), g.clamp(r["raw"]).alias("t")))
    d = F.transform(t, lambda r: F.struct(r["s"].alias("s"), r["raw"].alias("raw"), r["t"].alias("t"), g.distance(*p, r["s"]["x1"] + r["t"] * (r["s"]["x2"] - r["s"]["x1"]), r["s"]["y1"] + r["t"] * (r["s"]["y2"] - r["s"]["y1"])).alias("d")))
    hit = F.filter(d, lambda r: r["d"] <= reach)
    order = lambda r: [r["d"].alias("d"), *[r["s"][n].alias(n) for n in ("edge_order", "edge_id", "seg_idx")]]
    left = lambda r: ((g.cross(*p, *ends(r["s"])) > 0) & (r["raw"] >= 0) & (r["raw"] <= 1)).alias("left")
    place = lambda r: F.struct(*order(r), F.when(r["s"]["kind"] == "edge", 0).otherwise(1).alias("gap"), (r["s"]["mg1"] + r["t"] * r["s"]["len"]).alias("mg"), (r["s"]["mn1"] + r["t"] * (r["s"]["mn2"] - r["s"]["mn1"])).alias("mn"))
    at = points.join(road, "road_code", "left").withColumn("__s", hit)
    at = at.withColumn("__e", F.array_min(F.transform(F.filter("__s", lambda r: r["s"]["kind"] == "edge"), lambda r: F.struct(*order(r), left(r)))))
    at = at.withColumn("__l", F.when(F.col("__e").isNotNull(), F.array_min(F.transform("__s", place))))
    found = F.struct(F.col("__e.edge_id").alias("edge_id"), F.col("__e.d").alias("offset"), F.when(F.col("__e").isNotNull(), F.when(F.col("__e.left"), "left").otherwise("right")).alias("side"), F.col("__l.mg").alias("mg"), F.col("__l.mn").alias("mn"))
    # Out of an array of one: a caller's condition on what is found would be pushed below, and all of it be worked out once more for the condition.
    return at.select(*points.columns, F.inline(F.array(found)))


def locate(points: DataFrame, segments: DataFrame, reach: float = 50.0, any_road: bool = False) -> DataFrame:
    """Each point's nearest edge within reach and its place on the joined line (gaps included).

    points: pid, x, y and, unless any_road, road_code. Adds edge_id, road_code, offset, side, mg, mn; null where no edge is in reach."""
    if not any_road:
        long = long_roads(segments)
        if long is None:
            return _on_short_roads(points, segments, reach)
        (near, points), (short, segments) = apart(points, long), apart(segments, long)
        return _on_short_roads(near, short, reach).unionByName(_by_cells(points, segments, reach, False))
    return _by_cells(points, segments, reach, True)


def _by_cells(points: DataFrame, segments: DataFrame, reach: float, any_road: bool) -> DataFrame:
    """locate by candidates."""
    found = candidates(points, segments, reach, own_road=not any_road)
    if any_road:  # the joined line is the nearest edge's road
        found = found.groupBy("pid").agg(F.min(F.struct("e", "l")).alias("b")).select("pid", "b.e", "b.l")
    found = found.select("pid", F.col("e.edge_id").alias("edge_id"), F.col("e.s_road").alias("found_road"), F.col("e.d").alias("offset"), F.when(F.col("e.left"), "left").otherwise("right").alias("side"), F.col("l.mg").alias("mg"), F.col("l.mn").alias("mn"))
    out = points.join(found, "pid", "left")
    return out.withColumn("road_code", F.col("found_road")).drop("found_road") if any_road else out.drop("found_road")
