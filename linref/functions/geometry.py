"""Geometry as column expressions: a point is struct<x,y>, a line array<struct<x,y>>, lengths are plain doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"


def point(x, y) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.col(v)
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def line(*points: Column) -> Column:
    return F.array(*points)


def start_point(g: Column) -> Column:
    return F.element_at(g, 1)


def end_point(g: Column) -> Column:
    return F.element_at(g, -1)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def pieces(g: Column) -> Column:
    """The segments of a line: array of struct<a, b>."""
    return F.zip_with(F.slice(g, 1, F.size(g) - 1), F.slice(g, 2, F.size(g) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(g: Column) -> Column:
    return F.aggregate(pieces(g), F.lit(0.0), lambda s, p: s + distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))


def set_start(g: Column, p: Column) -> Column:
    return F.concat(F.array(p), F.slice(g, 2, F.size(g) - 1))


def set_end(g: Column, p: Column) -> Column:
    return F.concat(F.slice(g, 1, F.size(g) - 1), F.array(p))


def on_grid(g: Column, step: float = 0.1) -> Column:
    """The line on a grid, without points that repeat the one before; a line that shrinks to a point keeps two."""
    per = round(1 / step)
    q = F.transform(g, lambda p: F.struct((F.round(p["x"] * per) / per).alias("x"), (F.round(p["y"] * per) / per).alias("y")))
    kept = F.filter(q, lambda p, i: (i == 0) | (p != F.get(q, i - 1)))
    return F.when(F.size(kept) > 1, kept).otherwise(F.array(start_point(q), end_point(q)))


def twice_area(g: Column) -> Column:
    """Twice the signed area of a closed line: negative when it runs clockwise."""
    return F.aggregate(pieces(g), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])


def is_ring(g: Column) -> Column:
    return (F.size(g) > 3) & (start_point(g) == end_point(g))


def decimal(x: Column) -> Column:
    """A number as text with a fraction and without an exponent, which Spark writes from 10^7 on: up to 10^15 as other engines do."""
    digits = F.rtrim(x.cast("string").cast("decimal(38,17)").cast("string"), F.lit("0"))
    whole = F.concat(F.floor(x).cast("string"), F.lit(".0"))
    return F.when((F.abs(x) < 1e7) | (F.abs(x) >= 1e15), x.cast("string")).when(x == F.floor(x), whole).otherwise(digits)


def number(x: Column) -> Column:
    """A coordinate as text: without a fraction where it has none."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(decimal(x))


def wkt(g: Column) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(g, lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), ","), F.lit(")"))


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), number(x), F.lit(" "), number(y), F.lit(")"))


def geojson(g: Column) -> Column:
    text = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).otherwise(F.coalesce(decimal(x), F.lit("null")))
    at = F.array_join(F.transform(g, lambda p: F.concat(F.lit("["), text(p["x"]), F.lit(","), text(p["y"]), F.lit("]"))), ",")
    return F.when(g.isNull(), F.lit('{"type":"LineString"}')).otherwise(F.concat(F.lit('{"type":"LineString","coordinates":['), at, F.lit("]}")))


def line_from_wkt(text: Column) -> Column:
    """A line, or the first part of a multi-line, from its text."""
    body = F.regexp_extract(text, r"\(+([^()]*)\)", 1)
    return F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda t: F.struct(F.split(F.trim(t), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(t), r"\s+")[1].cast("double").alias("y")))


def line_from_geojson(text: Column) -> Column:
    """As line_from_wkt, from GeoJSON."""
    whole = F.from_json(text, "type string, coordinates array<array<double>>")
    multi = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    numbers = F.when(F.get_json_object(text, "$.type") == "MultiLineString", F.element_at(multi["coordinates"], 1)).otherwise(whole["coordinates"])
    return F.transform(numbers, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def fraction(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where a point projects on a segment's line: 0 at its start, 1 at its end, beyond them outside."""
    l2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    return F.when(l2 > 0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / l2).otherwise(F.lit(0.0))


def clamp(t: Column, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), t))


def cross(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Positive when the point lies to the left of the segment's direction."""
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)


def cells(x1: Column, y1: Column, x2: Column, y2: Column, size: float, margin: float) -> Column:
    """The grid cells that the bounding box of a segment, grown by a margin, meets: array of struct<cx, cy>."""
    def span(a: Column, b: Column) -> Column:
        return F.sequence(F.floor((F.least(a, b) - margin) / size), F.floor((F.greatest(a, b) + margin) / size))

    return F.flatten(F.transform(span(x1, x2), lambda cx: F.transform(span(y1, y2), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def cells_along(x1: Column, y1: Column, x2: Column, y2: Column, size: float, margin: float, step: float | None = None) -> Column:
    """As cells, but of a segment longer than `step` (half a cell's width if not given) only those near the segment itself: it is cut into parts of at most that length first."""
    step = step or size / 2
    parts = F.ceil(distance(x1, y1, x2, y2) / step)
    at = lambda a, b, i: a + (b - a) * (i / parts)
    along = F.transform(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)).cast("int")), lambda i: cells(at(x1, x2, i), at(y1, y2, i), at(x1, x2, i + 1), at(y1, y2, i + 1), size, margin))
    return F.when(parts <= 1, cells(x1, y1, x2, y2, size, margin)).otherwise(F.array_distinct(F.flatten(along)))


def in_cells(df: DataFrame, x1: str, y1: str, x2: str, y2: str, size: float, margin: float, step: float = 200.0) -> DataFrame:
    """df with a row for each cell (cx, cy) that a segment, grown by a margin, may meet: of one longer than `step` those near its parts of at most
    that length, some of them twice. The same as cells_along, as plain sequences, which compile."""
    a, b, c, d = (F.col(n) for n in (x1, y1, x2, y2))
    span = lambda p, q: F.explode(F.sequence(F.floor((F.least(p, q) - margin) / size), F.floor((F.greatest(p, q) + margin) / size)))
    if (x1, y1) == (x2, y2):
        return df.withColumn("cx", span(a, a)).withColumn("cy", span(b, b))
    parts = df.withColumn("__n", F.greatest(F.ceil(distance(a, b, c, d) / step), F.lit(1))).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    at = lambda p, q, i: p + (q - p) * ((F.col("__i") + i) / F.col("__n"))
    parts = parts.withColumn("cx", span(at(a, c, 0), at(a, c, 1))).withColumn("cy", span(at(b, d, 0), at(b, d, 1)))
    return parts.drop("__n", "__i")


def crossing(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Whether two segments cross in one point, and its coordinates. Each is x1, y1, x2, y2."""
    dx1, dy1, dx2, dy2 = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    d = dx1 * dy2 - dy1 * dx2
    t = ((b["x1"] - a["x1"]) * dy2 - (b["y1"] - a["y1"]) * dx2) / F.nullif(d, F.lit(0.0))
    u = ((b["x1"] - a["x1"]) * dy1 - (b["y1"] - a["y1"]) * dx1) / F.nullif(d, F.lit(0.0))
    meets = (d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return meets, a["x1"] + t * dx1, a["y1"] + t * dy1


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of points, closed), by the crossings of a ray to the right."""
    def hit(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(pieces(ring), hit)) % 2 == 1
