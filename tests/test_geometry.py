"""Geometry expressions and small cases that the derived network does not have."""

from pyspark.sql import functions as F

from linref.functions import geometry as g
from linref.operators import order, references


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit_line(*points):
    return F.array(*[g.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def test_text_forms(spark):
    assert one(spark, g.wkt(g.line_from_wkt(F.lit("MULTILINESTRING((0 0, 1.5 2),(5 5,6 6))")))) == "LINESTRING(0 0,1.5 2)"
    assert one(spark, g.geojson(g.line_from_geojson(F.lit('{"type":"LineString","coordinates":[[0,0],[3,4]]}')))) == '{"type":"LineString","coordinates":[[0.0,0.0],[3.0,4.0]]}'


def test_large_coordinates_have_no_exponent(spark):
    far = lit_line((12_000_000, 10_000_000.25), (-72_003_999, 0.5), (9_999_999.5, 123_456_789_012))
    assert one(spark, g.geojson(far)) == '{"type":"LineString","coordinates":[[12000000.0,10000000.25],[-72003999.0,0.5],[9999999.5,123456789012.0]]}'
    assert one(spark, g.wkt(far)) == "LINESTRING(12000000 10000000.25,-72003999 0.5,9999999.5 123456789012)"
    assert one(spark, F.to_json(F.struct(g.line_from_geojson(g.geojson(far)).alias("p")))) == one(spark, F.to_json(F.struct(far.alias("p"))))


def test_numbers_that_are_none_stay_json(spark):
    odd = F.array(g.point(F.lit(float("nan")), F.lit(float("inf"))), g.point(F.lit(None), F.lit(-0.5)), g.point(F.lit(1e-5), F.lit(1e15)))
    assert one(spark, g.geojson(odd)) == '{"type":"LineString","coordinates":[["NaN","Infinity"],[null,-0.5],[1.0E-5,1.0E15]]}'


def test_measures(spark):
    assert one(spark, g.length(lit_line((0, 0), (3, 4), (3, 10)))) == 11.0
    assert one(spark, g.twice_area(lit_line((0, 0), (1, 0), (1, 1), (0, 0)))) == 1.0
    assert one(spark, g.inside(F.lit(0.5), F.lit(0.5), lit_line((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    assert one(spark, F.size(g.on_grid(lit_line((0.01, 0), (0.02, 0), (1, 1))))) == 2


def test_order_follows_links_not_ids(spark):
    rows = [(9, "r", 4, 0.0), (4, "r", 7, 10.0), (7, "r", None, 20.0), (2, "ring", 5, 0.0), (5, "ring", 2, 50.0)]
    edges = spark.createDataFrame(rows, "id long, road_code string, next_edge_id long, x double").select("id", "road_code", "next_edge_id", g.line(g.point("x", F.lit(0)), g.point(F.col("x") + 10, F.lit(0))).alias("geom"))
    got = {(r["road_code"], r["id"]): r["edge_order"] for r in order.ordered_edges(edges).collect()}
    assert got == {("r", 9): 1, ("r", 4): 2, ("r", 7): 3, ("ring", 2): 1, ("ring", 5): 2}


def test_typed_references(spark):
    rows = references.parse_reference(spark.createDataFrame([("D30 3 150.5 10 left",), ("D30",), (" D1 x y",)], "query string")).drop("query").collect()
    assert [tuple(r) for r in rows] == [("D30", 3, 150.5, 10.0, "left"), ("D30", 0, 0.0, 0.0, "right"), ("D1", 0, 0.0, 0.0, "right")]
