"""Linear referencing: positions to (road, marker, abscissa, offset, side, cumulative) and back, for whole tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.functions import geometry as g
from linref.functions.lineage import settle
from linref.operators.offsets import offset_lines
from linref.operators.segments import apart, locate, long_roads, numbered_parts, spatial_road

#: Roads are joined by reaches of so many metres, so that a long road is many keys.
REACH = 500.0
SLIVER = 0.01
REFERENCE = ["road_code", "marker_code", "abscissa", "cumulative", "offset", "side"]


def _of_roads(df: DataFrame, roads: DataFrame) -> DataFrame:
    return df.join(roads.select("road_code").distinct(), "road_code", "left_semi")


def marker_measures(markers: DataFrame, segments: DataFrame) -> DataFrame:
    """Markers with their place on their road's joined line: (road_code, code, m_abscissa, mg, mn).

    They change seldom: settle them once, next to the segments, and hand them to the functions that take `measures`."""
    pts = markers.select(F.struct("road_code", "code", "abscissa").alias("pid"), "road_code", F.col("geom.x").alias("x"), F.col("geom.y").alias("y"))
    at = locate(pts, segments).where("mg is not null")
    return at.select("road_code", F.col("pid.code").alias("code"), F.col("pid.abscissa").alias("m_abscissa"), "mg", "mn")


def previous_marker(located: DataFrame, measures: DataFrame) -> DataFrame:
    """As-of join: each located point (pid, road_code, mg, mn) with the last marker at or before it; see with_marker."""
    points = located.where("mg is not null").select("pid", "road_code", "mg", "mn")
    return with_marker(points, measures).select("pid", "marker_code", "abscissa", "marker_mn", "road_code", "mn")


_MARKER = "struct<mg:double,code:int,m_abscissa:double,m_mn:double>"


def with_marker(located: DataFrame, measures: DataFrame) -> DataFrame:
    """located (road_code, mg, mn, ...) with marker_code, abscissa and marker_mn of the last marker at or before each, null where there is none; ties go to the
    larger code, then abscissa.

    A road's markers are gathered in a row where it has few (SHORT); points then look through them. Where points and markers are dealt out by road alike, nothing is shuffled.
    Of roads with more markers they are gathered by reach, a few each; the last marker of a reach is carried on into the reaches that have points, one row
    per reach. A point then meets its reach's markers in an equi-join, so neither a long road nor a crowd of points at one place is a single task."""
    marker = F.struct(F.col("mg").cast("double").alias("mg"), F.col("code").cast("int").alias("code"), F.col("m_abscissa").cast("double").alias("m_abscissa"), F.col("mn").cast("double").alias("m_mn")).cast(_MARKER)

    def held(rows: DataFrame, *keys) -> DataFrame:
        return rows.groupBy("road_code", *keys).agg(F.array_sort(F.collect_list(marker)).alias("markers"))

    def last(rows: DataFrame) -> DataFrame:
        before = F.filter("markers", lambda m: m["mg"] <= F.col("mg"))
        found = rows.withColumn("__last", F.element_at(F.when(F.size(before) > 0, before), -1))
        return found.select(*located.columns, F.col("__last.code").alias("marker_code"), (F.col("__last.m_abscissa") + F.col("mn") - F.col("__last.m_mn")).alias("abscissa"), F.col("__last.m_mn").alias("marker_mn"))

    long = long_roads(measures)
    if long is None:
        return last(located.join(held(measures), "road_code", "left"))
    (near, located_far), (few, measures) = apart(located, long), apart(measures, long)
    reach = F.floor(F.col("mg") / REACH).alias("reach")
    points = located_far.withColumn("reach", reach)
    asked = points.where("reach is not null").select("road_code", "reach").distinct()
    every = asked.join(held(measures, reach).withColumnRenamed("markers", "held"), ["road_code", "reach"], "full_outer")
    before = Window.partitionBy("road_code").orderBy("reach").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("carried", F.last(F.element_at("held", -1), ignorenulls=True).over(before))
    none = F.array().cast(f"array<{_MARKER}>")
    known = every.select("road_code", "reach", F.concat(F.when(F.col("carried").isNotNull(), F.array("carried")).otherwise(none), F.coalesce("held", none)).alias("markers"))
    return last(near.join(held(few), "road_code", "left")).unionByName(last(points.join(known, ["road_code", "reach"], "left")))


def lines_to_points(points: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    """(pid, of, parts): for each located point its road's line from its marker to it (of `marker`) and from the road's start to it (`start`)."""
    segments = _of_roads(segments, points)
    at = settle(locate(points, segments).where("mg is not null"))
    at = settle(previous_marker(at, settle(marker_measures(_of_roads(markers, at), segments))))
    spans = at.where("marker_mn is not null").select("pid", "road_code", F.col("marker_mn").alias("lo"), F.col("mn").alias("hi"), F.lit("marker").alias("of"))
    spans = spans.unionByName(at.select("pid", "road_code", F.lit(0.0).alias("lo"), F.col("mn").alias("hi"), F.lit("start").alias("of")))
    spans = spans.withColumn("key", F.struct("pid", "of")).where("lo < hi").select("key", "road_code", "lo", "hi")
    return _lines(_clipped(spans, segments, "key"), "key").select("key.pid", "key.of", "parts")


def reference_from_point(points: DataFrame, segments: DataFrame, markers: DataFrame, any_road: bool = False, reach: float = 50.0, measures: DataFrame | None = None) -> DataFrame:
    """points (pid, x, y[, road_code]) with their references, rounded to centimetres; null beyond reach.

    Markers are located on the roads of the points alone, unless their places are given as measures (marker_measures)."""
    if measures is None:
        segments = settle(segments) if any_road else _of_roads(segments, points)
    at = settle(locate(points, segments, reach, any_road))
    if measures is None:
        found = at.where("mg is not null")
        measures = settle(marker_measures(_of_roads(markers, found), _of_roads(segments, found)))
    return with_marker(at, measures).select("pid", "road_code", "marker_code", F.round("abscissa", 2).alias("abscissa"), F.round("mn", 2).alias("cumulative"), F.round("offset", 2).alias("offset"), "side")


def edge_references(edges: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers, abscissas and cumulatives of the start and end of each edge, from the segments alone."""
    ends = segments.where("kind = 'edge'").groupBy("road_code", "edge_id").agg(F.min("mg1").alias("mg1"), F.min("mn1").alias("mn1"), F.max("mg2").alias("mg2"), F.max("mn2").alias("mn2"))
    pts = ends.select("road_code", F.explode(F.array(F.struct(F.struct("edge_id", F.lit(0).alias("end")).alias("pid"), F.col("mg1").alias("mg"), F.col("mn1").alias("mn")),
                                                    F.struct(F.struct("edge_id", F.lit(1).alias("end")).alias("pid"), F.col("mg2").alias("mg"), F.col("mn2").alias("mn")))).alias("p")).select("road_code", "p.*")
    ref = previous_marker(pts, settle(marker_measures(markers, segments)))

    def side(e: int, name: str) -> list[Column]:
        at = lambda c: F.max(F.when(F.col("pid.end") == e, F.col(c)))
        return [at("marker_code").alias(f"{name}_marker"), F.round(at("abscissa"), 2).alias(f"{name}_abscissa"), F.round(at("mn"), 2).alias(f"{name}_cumulative")]

    return ref.groupBy(F.col("pid.edge_id").alias("id"), "road_code").agg(*side(0, "start"), *side(1, "end"))


def update_edge_references(edges: DataFrame, segments: DataFrame, markers: DataFrame, roads: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """edges with fresh references; only those of the given roads (road_code) or edges (id) are computed anew."""
    if ids is not None:
        roads = edges.join(ids.select("id").distinct(), "id", "left_semi").select("road_code")
    names = ["start_marker", "start_abscissa", "start_cumulative", "end_marker", "end_abscissa", "end_cumulative"]
    if roads is not None:
        roads = roads.select("road_code").distinct()
        segments, markers = segments.join(roads, "road_code", "left_semi"), markers.join(roads, "road_code", "left_semi")
    new = edge_references(edges, segments, markers).drop("road_code").withColumn("__new", F.lit(True))
    if ids is not None:
        new = new.join(ids.select("id").distinct(), "id", "left_semi")
    fresh = new.select("id", "__new", *[F.col(n).alias(f"__{n}") for n in names])
    out = edges.join(fresh, "id", "left")
    old = lambda n: F.col(n) if n in edges.columns else F.lit(None)
    return out.withColumns({n: F.when(F.col("__new"), F.col(f"__{n}")).otherwise(old(n)) for n in names}).select(*[c for c in edges.columns if c not in names], *names)


def _named(markers: DataFrame, refs: DataFrame) -> DataFrame:
    """The markers that references (road_code, marker_code) name."""
    return markers.join(refs.select("road_code", F.col("marker_code").alias("code")).distinct(), ["road_code", "code"], "left_semi")


def measures_of_references(refs: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    """refs (rid, road_code, marker_code, abscissa) with the length mn they stand for, clamped to the road; the marker row is the one
    of the code with the largest abscissa not above the given one; null where there is none."""
    m = marker_measures(_named(markers, refs), segments).select("road_code", F.col("code").alias("marker_code"), "m_abscissa", F.col("mn").alias("m_mn"))
    best = refs.join(m, ["road_code", "marker_code"]).where("m_abscissa <= abscissa").groupBy("rid").agg(F.max(F.struct("m_abscissa", "m_mn")).alias("b"))
    total = segments.groupBy("road_code").agg(F.max("mn2").alias("total"))
    out = refs.join(best, "rid", "left").join(total, "road_code", "left")
    return out.withColumn("mn", F.when(F.col("b").isNotNull(), F.least(F.col("total"), F.col("b.m_mn") + F.col("abscissa") - F.col("b.m_abscissa")))).drop("b", "total")


def point_from_reference(refs: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    """refs (rid, road_code, marker_code, abscissa, offset, side) with the point x, y they name; null where no marker is at or before."""
    segments = _of_roads(segments, refs)
    at = measures_of_references(refs, segments, markers)
    seg = segments.where("kind = 'edge'").select("road_code", "edge_order", "edge_id", "seg_idx", "x1", "y1", "x2", "y2", "len", "mn1", "mn2")
    seg = seg.withColumn("reach", F.explode(_reaches(F.col("mn1"), F.col("mn2"))))
    on = at.where("mn is not null").select("rid", "road_code", "mn", F.floor(F.col("mn") / REACH).alias("reach")).join(seg, ["road_code", "reach"]).where("mn1 <= mn and mn <= mn2")
    # A segment without a length has no side to go to, so one with a length next to it comes first.
    best = on.groupBy("rid").agg(F.min(F.struct((F.col("len") == 0).alias("none"), "edge_order", "edge_id", "seg_idx", "x1", "y1", "x2", "y2", "len", "mn1")).alias("s"))
    out = at.join(best, "rid", "left")
    per = lambda v: F.when(F.col("s.len") > 0, v / F.nullif(F.col("s.len"), F.lit(0.0))).otherwise(0.0)
    t = per(F.col("mn") - F.col("s.mn1"))
    dx, dy = F.col("s.x2") - F.col("s.x1"), F.col("s.y2") - F.col("s.y1")
    move = F.coalesce(F.col("offset"), F.lit(0.0)) * F.when(F.col("side") == "left", 1.0).otherwise(-1.0)
    return out.select("rid", F.round(F.col("s.x1") + t * dx - move * per(dy), 2).alias("x"), F.round(F.col("s.y1") + t * dy + move * per(dx), 2).alias("y"))


def _reaches(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / REACH), F.floor(hi / REACH))


def _clipped(spans: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """The edge segments of each span (key, road_code, lo, hi) cut to it, with the part they belong to: a gap starts a new part."""
    seg = numbered_parts(segments).where("len > 0").select("road_code", "edge_order", "edge_id", "seg_idx", "part", "x1", "y1", "x2", "y2", "len", "mn1", "mn2")
    # Spans and segments meet in the first reach that both are in.
    total = segments.groupBy("road_code").agg(F.max("mn2").alias("total"))
    spans = spans.join(total, "road_code").withColumn("hi", F.least("hi", "total")).drop("total").where("lo < hi")
    # On roads of few segments, they meet by road.
    long = long_roads(segments)
    (near, spans), (short, seg) = ((spans, None), (seg, None)) if long is None else (apart(spans, long), apart(seg, long))
    hit = near.join(short, "road_code").where("mn2 > lo and mn1 < hi")
    if long is not None:
        spans = spans.withColumn("reach", F.explode(_reaches(F.col("lo"), F.col("hi"))))
        seg = seg.withColumn("reach", F.explode(_reaches(F.col("mn1"), F.col("mn2"))))
        hit = hit.unionByName(spans.join(seg, ["road_code", "reach"]).where("mn2 > lo and mn1 < hi").where(F.col("reach") == F.floor(F.greatest("lo", "mn1") / REACH)).drop("reach"))
    a, b = F.greatest(F.col("lo"), F.col("mn1")), F.least(F.col("hi"), F.col("mn2"))
    # Slivers of a segment at either end of a span are what rounding of references leaves beyond a vertex or a gap.
    hit = hit.where((b - a >= SLIVER) | (b - a >= F.col("len")) | (F.col("hi") - F.col("lo") < 2 * SLIVER))
    t1, t2 = (a - F.col("mn1")) / F.col("len"), (b - F.col("mn1")) / F.col("len")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return hit.select(key, "road_code", "part", "edge_order", "edge_id", "seg_idx", (F.col("x1") + t1 * dx).alias("x1"), (F.col("y1") + t1 * dy).alias("y1"), (F.col("x1") + t2 * dx).alias("x2"), (F.col("y1") + t2 * dy).alias("y2"), (b - a).alias("len"))


def _lines(clipped: DataFrame, key: str) -> DataFrame:
    """(key, parts): an array of lines in road order, one per part."""
    s = F.sort_array(F.collect_list(F.struct("edge_order", "edge_id", "seg_idx", "x1", "y1", "x2", "y2")))
    part = clipped.groupBy(key, "road_code", "part").agg(s.alias("s"))
    pts = F.concat(F.transform("s", lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y"))), F.array(F.struct(F.element_at("s", -1)["x2"].alias("x"), F.element_at("s", -1)["y2"].alias("y"))))
    every = part.select(key, "road_code", "part", pts.alias("geom")).groupBy(key, "road_code").agg(F.sort_array(F.collect_list(F.struct("part", "geom"))).alias("p"))
    return every.select(key, F.transform("p", lambda p: p["geom"]).alias("parts"))


def downstream_line(refs: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    """(rid, parts): each reference's road from its marker on."""
    segments = _of_roads(segments, refs)
    m = refs.select("rid", "road_code", "marker_code", "abscissa")
    start = marker_measures(_named(markers, refs), segments).select("road_code", F.col("code").alias("marker_code"), "m_abscissa", F.col("mn").alias("lo"))
    best = m.join(start, ["road_code", "marker_code"]).where("m_abscissa <= abscissa").groupBy("rid", "road_code").agg(F.max(F.struct("m_abscissa", "lo"))["lo"].alias("lo"))
    return _lines(_clipped(best.withColumn("hi", F.lit(float("inf"))), segments, "rid"), "rid")


def spans_of_references(refs: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    """refs (rid, road_code, start_marker_code, start_abscissa, end_marker_code, end_abscissa) with lo, hi and error."""
    end = lambda e: F.struct(F.lit(e).alias("end"), F.col(f"{e}_marker_code").alias("marker_code"), F.col(f"{e}_abscissa").alias("abscissa"))
    both = refs.select("rid", "road_code", F.explode(F.array(end("start"), end("end"))).alias("e")).select(F.struct("rid", "e.end").alias("rid"), "road_code", "e.marker_code", "e.abscissa")
    at = measures_of_references(both, segments, markers).groupBy(F.col("rid.rid").alias("rid")).agg(*[F.max(F.when(F.col("rid.end") == e, F.col("mn"))).alias(n) for e, n in (("start", "lo"), ("end", "hi"))])
    known = segments.select("road_code").distinct().withColumn("known", F.lit(True))
    out = refs.join(at, "rid", "left").join(known, "road_code", "left")
    error = F.when(F.col("known").isNull(), "unknown road").when(F.col("lo").isNull(), "unknown start").when(F.col("hi").isNull(), "unknown end").when(F.col("lo") > F.col("hi"), "start after end")
    return out.withColumn("error", error).drop("known")


def line_from_references(refs: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    """(rid, error, length, parts) of each span; length is along the road. With an offset column each part is moved sideways, round at outer bends and
    without loops, see offset_lines."""
    segments = _of_roads(segments, refs)
    spans = settle(spans_of_references(refs, segments, markers))
    good = spans.where("error is null and lo < hi").select("rid", "road_code", "lo", "hi")
    clipped = settle(_clipped(good, segments, "rid"))
    lengths = clipped.groupBy("rid").agg(F.round(F.sum("len"), 2).alias("length"))
    out = spans.select("rid", "error").join(lengths, "rid", "left")
    if "offset" not in refs.columns:
        return out.join(_lines(clipped, "rid"), "rid", "left")
    by = refs.select("rid", (F.coalesce("offset", F.lit(0.0)) * F.when(F.col("side") == "left", 1.0).otherwise(-1.0)).alias("move"))
    clipped = clipped.join(by, "rid")
    moved = clipped.where("move != 0").select(F.col("rid").alias("key"), "part", F.struct("edge_order", "edge_id", "seg_idx").alias("k"), "x1", "y1", "x2", "y2", "move")
    lines = _lines(clipped.where("move = 0"), "rid").unionByName(offset_lines(moved).withColumnRenamed("key", "rid"))
    return out.join(lines, "rid", "left")


def reorder_parts(lines: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    """lines (pid, road_code, parts) with the parts in the order of the references of their ends; a part without one comes last."""
    part = lines.select("pid", "road_code", F.posexplode("parts").alias("n", "g"))
    pts = part.select(F.struct("pid", "n").alias("pid"), "road_code", g.end_point(F.col("g"))["x"].alias("x"), g.end_point(F.col("g"))["y"].alias("y"))
    ref = reference_from_point(pts, segments, markers).select(F.col("pid.pid").alias("pid"), F.col("pid.n").alias("n"), (F.col("marker_code") * 10000 + F.col("abscissa")).alias("o"))
    order = F.struct(F.coalesce("o", F.lit(float("inf"))).alias("o"), "n", "g")
    sorted_ = part.join(ref, ["pid", "n"], "left").groupBy("pid").agg(F.sort_array(F.collect_list(order)).alias("s"))
    return lines.select("pid", "road_code").join(sorted_, "pid", "left").select("pid", "road_code", F.transform("s", lambda p: p["g"]).alias("parts"), F.transform("s", lambda p: p["n"]).alias("order"))


def parse_reference(df: DataFrame, text: str = "query") -> DataFrame:
    """References typed as "road marker abscissa offset side": missing or invalid numbers are 0, the default side is right."""
    w = F.split(F.trim(F.col(text)), r"\s+")
    value = lambda i, kind: F.coalesce(F.get(w, F.lit(i)).try_cast(kind), F.lit(0).cast(kind))
    side = F.when(F.lower(F.get(w, F.lit(4))) == "left", "left").otherwise("right")
    return df.select("*", F.get(w, F.lit(0)).alias("road_code"), value(1, "int").alias("marker_code"), value(2, "double").alias("abscissa"), value(3, "double").alias("offset"), side.alias("side"))


def search_roads(queries: DataFrame, roads: DataFrame, top: int = 5) -> DataFrame:
    """(query, road_code, priority, place): exact, prefix and contained matches without regard to case, the best `top` of each query.

    An equi-join on up to three first characters of the query, which are somewhere in a road code that contains it."""
    q, r = F.lower("query"), F.lower("road_code")
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("road_code")), lambda i: F.substr(r, i, F.lit(n)))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), at(1), at(2), at(3)))
    of_roads = roads.select("road_code").distinct().where("length(road_code) > 0").withColumn("gram", F.explode(grams))
    hit = of_roads.join(queries.select("query").distinct().withColumn("gram", F.substring(q, 1, 3)), "gram").where(F.contains(r, q)).drop("gram")
    rank = F.when(q == r, 1).when(F.startswith(r, q), 2).otherwise(3)
    w = Window.partitionBy("query").orderBy("priority", F.length("road_code"), "road_code")
    return hit.withColumn("priority", rank).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def search_road_lines(queries: DataFrame, segments: DataFrame, top: int = 5) -> DataFrame:
    """search_roads over the roads that have segments, each found road with its line with measures (parts, see spatial_road)."""
    found = settle(search_roads(queries, segments, top))
    return found.join(spatial_road(_of_roads(segments, found)), "road_code")
