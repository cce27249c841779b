"""How often rows are dealt out: numbering deals them out by ranges alone, snapping finds both ends of an edge by its id alone."""

import random

from linref.functions import geometry as g
from linref.operators import clusters, importing, topology


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_need_no_window_over_the_rows(spark):
    rows = spark.createDataFrame([(x % 7, x) for x in range(500)], "a long, b long").repartition(6)
    got = importing.numbered(rows, ["a", "b"])
    assert "row_number" not in plan(got)
    assert [(r["a"], r["b"]) for r in got.orderBy("id").collect()] == sorted((x % 7, x) for x in range(500))
    assert [r["id"] for r in got.orderBy("id").collect()] == list(range(1, 501))


def test_equal_keys_are_numbered_apart(spark):
    got = importing.numbered(spark.createDataFrame([(1,)] * 40 + [(0,)] * 3, "a long").repartition(4), ["a"]).collect()
    assert sorted(r["id"] for r in got) == list(range(1, 44)) and {r["id"] for r in got if r["a"] == 0} == {1, 2, 3}


def test_ends_are_snapped_without_a_join_by_rank(spark):
    edges = spark.createDataFrame([(1, "A", [(0.0, 0.0), (10.0, 0.0)]), (2, "A", [(10.3, 0.0), (20.0, 0.0)])], f"id long, road_code string, geom {g.LINE}")
    out, nodes = topology.snap_ends(edges, spark.createDataFrame([], "id long, x double, y double"))
    joins = [line for line in plan(out).splitlines() if "Join" in line]
    assert joins and not any("rank#" in line for line in joins)
    assert sorted((r["id"], r["start_node"], r["end_node"]) for r in out.collect()) == [(1, 1, 2), (2, 2, 3)] and nodes.count() == 3


def one_by_one(points, near):
    nodes = []
    for _, x, y in sorted(points):
        if not any((x - a) ** 2 + (y - b) ** 2 <= near * near for _, a, b in nodes):
            nodes.append((_, x, y))
    return {n[0] for n in nodes}


def test_leaders_are_those_of_points_one_after_the_other(spark):
    """A crowd over the borders of wide cells, piles of equal points, and points left and right of zero."""
    rnd = random.Random(5)
    points = [(k, round(rnd.uniform(-6, 6), 2), round(rnd.uniform(-5, 5), 2)) for k in range(400)]
    points += [(1000 + k, 4.0, 4.0) for k in range(30)] + [(2000 + k, 3.9 + k * 0.05, -4.1) for k in range(40)]
    rnd.shuffle(points)
    got = clusters.leaders(spark.createDataFrame(points, "rank long, x double, y double"), 0.5)
    assert {r["rank"] for r in got.collect()} == one_by_one(points, 0.5)


def test_few_points_are_looked_for_in_a_second_cell(spark):
    points = spark.range(1000).selectExpr("id AS rank", "id * 1.37D AS x", "id * 0.91D AS y")
    assert points.select(clusters._around("x", "y", clusters.WIDE * 0.5, 0.5)).count() < 2000


def test_a_condition_on_what_is_found_does_not_search_again(spark):
    from linref.operators import segments

    edges = spark.createDataFrame([(1, "A", 1, [(0.0, 0.0), (10.0, 0.0)])], f"id long, road_code string, edge_order int, geom {g.LINE}")
    points = spark.createDataFrame([(1, "A", 4.0, 1.0), (2, "A", 4.0, 900.0)], "pid long, road_code string, x double, y double")
    found = segments.locate(points, segments.road_segments(edges)).where("mg is not null")
    assert not any("Filter" in line and "array_min" in line for line in plan(found).splitlines())
    assert [(r["pid"], r["edge_id"], r["offset"], r["side"], r["mg"]) for r in found.collect()] == [(1, 1, 1.0, "left", 4.0)]
