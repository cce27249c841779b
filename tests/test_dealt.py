"""What is done road by road on tables dealt out by road needs no shuffle; short and long roads have the same results."""

from pyspark.sql import functions as F

from linref.functions import geometry as g
from linref.operators import references, segments
from linref.sources.derived import Network

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_roads_are_dealt_out_once(spark):
    """F34 and the others that measure roads: segments, markers and their places come from one table dealt out by road."""
    n = Network(spark, SF)
    assert exchanges(n.segments) == 0
    assert exchanges(n.markers) == 0
    assert exchanges(references.marker_measures(n.markers, n.segments)) == 0
    assert n.markers.count() == references.marker_measures(n.markers, n.segments).count()


def test_short_and_long_roads_agree(spark, monkeypatch):
    """Points beside roads of 3 and 40 edges with gaps, beyond reach of them, and on no road; markers on both roads, two at one place."""
    rows = [(r * 1000 + k, f"R{r}", k + 1, 30.0 * k, 1000.0 * r) for r, n in ((1, 3), (2, 40)) for k in range(n)]
    edges = spark.createDataFrame(rows, "id long, road_code string, edge_order int, x double, y double")
    edges = edges.select("id", "road_code", "edge_order", g.line(g.point("x", "y"), g.point(F.col("x") + 25, F.col("y") + 1)).alias("geom"))
    places = [(i, f"R{r}", x, 1000.0 * r + dy) for i, (r, x, dy) in enumerate((r, x, dy) for r in (1, 2, 3) for x in (-10.0, 0.0, 27.0, 40.0, 900.0) for dy in (-3.0, 2.0, 80.0))]
    points = spark.createDataFrame(places, "pid long, road_code string, x double, y double")
    marks = [(f"R{r}", k, 0.0, 30.0 * at, 1000.0 * r) for r, n in ((1, 3), (2, 40)) for k, at in [(0, 0), (1, 1), (2, 1)] + [(j, j) for j in range(3, n)]]
    markers = spark.createDataFrame(marks, "road_code string, code int, abscissa double, x double, y double").select("road_code", "code", "abscissa", g.point("x", "y").alias("geom"))

    parts, points, markers = segments.road_segments(edges).cache(), points.cache(), markers.cache()

    def result():
        return sorted(map(tuple, references.reference_from_point(points, parts, markers).collect()), key=repr)

    mixed = result()
    assert sum(r[6] is not None for r in mixed) > 6
    monkeypatch.setattr(segments.long_roads, "__defaults__", (1000,))  # all roads are short
    assert result() == mixed
