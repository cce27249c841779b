"""Edits of a small road with known lengths, a very long road, and cases that the derived network does not have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linref.functions import geometry as g
from linref.operators import assets, importing, offsets, order, references, segments, sessions, topology

EDGE = f"id long, road_code string, start_node long, end_node long, previous_edge_id long, next_edge_id long, geom {g.LINE}"
BENDS = [(475154.0, 6895454.0), (475114.0, 6895374.0), (475085.0, 6895256.0), (475031.0, 6895181.0), (474873.0, 6895084.0), (474792.0, 6894903.0), (474709.0, 6894739.0)]
LINKS = ["start_node", "end_node", "previous_edge_id", "next_edge_id"]
REFS = ["start_marker", "start_abscissa", "start_cumulative", "end_marker", "end_abscissa", "end_cumulative"]


def frame(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def references_of(df):
    return {r["id"]: tuple(r[c] for c in REFS) for r in df.collect()}


def near(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert all(a == b if a is None or b is None else abs(a - b) <= 0.011 for a, b in zip(got[k], want[k], strict=True)), (k, got[k], want[k])


def test_an_edge_is_made_split_extended_and_moved(spark):
    roads = spark.createDataFrame([("T001",)], "road_code string")
    edges = frame(spark, [(7830, "T001", 5758, 5759, None, None, BENDS)])
    none = spark.createDataFrame([], f"road_code string, code int, abscissa double, geom {g.POINT}")
    markers = importing.marker_zero(edges.withColumn("edge_order", F.lit(1)), none)
    near(references_of(topology.with_references(edges, markers, roads)), {7830: (0, 0.0, 0.0, 0, 870.88, 870.88)})

    touching = topology.touching_nodes(edges, spark.createDataFrame([(5760, 474818.5, 6894961.7)], "id long, x double, y double"))  # a node on the 0.1 grid
    edges = topology.split_graph(edges, touching).select(*edges.columns).cache()
    assert {r["id"]: tuple(r[c] for c in LINKS) for r in edges.collect()} == {7830: (5758, 5760, None, 7831), 7831: (5760, 5759, 7830, None)}
    near(references_of(topology.with_references(edges, markers, roads)), {7830: (0, 0.0, 0.0, 0, 622.67, 622.67), 7831: (0, 622.67, 622.67, 0, 870.88, 870.88)})
    merged = topology.merge_graph(edges).collect()
    assert [(r["id"], r["merged"], r["start_node"], r["end_node"], len(r["geom"])) for r in merged] == [(7830, 2, 5758, 5759, 8)]

    edges = topology.infer_neighbours(edges.unionByName(frame(spark, [(7832, "T001", 5759, 5761, None, None, [BENDS[-1], (474677.14, 6894702.57)])]))).cache()
    assert {r["id"]: (r["previous_edge_id"], r["next_edge_id"]) for r in edges.collect()} == {7830: (None, 7831), 7831: (7830, 7832), 7832: (7831, None)}
    near(references_of(topology.with_references(edges, markers, roads)), {7830: (0, 0.0, 0.0, 0, 622.67, 622.67), 7831: (0, 622.67, 622.67, 0, 870.88, 870.88), 7832: (0, 870.88, 870.88, 0, 919.28, 919.28)})

    second = edges.where("id = 7831").select(F.lit("TC002").alias("road_code"), F.lit(0).alias("code"), F.lit(0.0).alias("abscissa"), g.start_point(F.col("geom")).alias("geom"))
    moved = topology.move_edges(edges, spark.createDataFrame([(7831, "TC002")], "id long, new_road string"), markers.unionByName(second))
    got = moved.cache()
    assert {r["id"]: (r["road_code"], r["previous_edge_id"], r["next_edge_id"]) for r in got.collect()} == {7830: ("T001", None, 7832), 7831: ("TC002", None, None), 7832: ("T001", 7830, None)}
    near(references_of(got), {7830: (0, 0.0, 0.0, 0, 622.67, 622.67), 7831: (0, 0.0, 0.0, 0, 248.21, 248.21), 7832: (0, 622.67, 622.67, 0, 671.07, 671.07)})


def test_a_road_of_many_edges_and_a_long_segment(spark):
    """100,000 edges of 5 m, then one segment of 100 km: order, references and points stay arithmetic on measures."""
    n = 100_000
    edges = spark.range(n).select(F.col("id"), F.lit("L").alias("road_code"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next_edge_id"), g.line(g.point(F.col("id") * 5, F.lit(0)), g.point(F.col("id") * 5 + 5, F.lit(0))).alias("geom"))
    edges = edges.withColumn("next_edge_id", F.when(F.col("id") == n - 1, F.lit(n)).otherwise(F.col("next_edge_id")))
    last = spark.range(1).select(F.lit(n).cast("long").alias("id"), F.lit("L").alias("road_code"), F.lit(None).cast("long").alias("next_edge_id"), g.line(g.point(F.lit(n * 5), F.lit(0)), g.point(F.lit(n * 5 + 60_000), F.lit(80_000))).alias("geom"))
    edges = edges.unionByName(last)
    ordered = order.ordered_edges(edges)
    assert ordered.where("edge_order != id + 1").isEmpty() and ordered.count() == n + 1
    own = edges.join(ordered, ["road_code", "id"])
    parts = segments.road_segments(own)
    markers = spark.range(0, n, 1000).select(F.lit("L").alias("road_code"), (F.col("id") / 1000).cast("int").alias("code"), F.lit(0.0).alias("abscissa"), g.point(F.col("id") * 5, F.lit(0)).alias("geom"))
    points = spark.createDataFrame([(1, "L", 12_345.0, 3.0), (2, "L", 499_999.0, -7.0), (3, "L", n * 5 + 30_000.0, 40_000.0), (4, "L", 0.0, 500.0)], "pid long, road_code string, x double, y double")
    got = {r["pid"]: (r["marker_code"], r["abscissa"], r["cumulative"], r["offset"], r["side"]) for r in references.reference_from_point(points, parts, markers).collect()}
    assert got == {1: (2, 2345.0, 12_345.0, 3.0, "left"), 2: (99, 4999.0, 499_999.0, 7.0, "right"), 3: (99, 55_000.0, 550_000.0, 0.0, "right"), 4: (None, None, None, None, None)}
    refs = spark.createDataFrame([(1, "L", 2, 2345.0, 3.0, "left"), (2, "L", 99, 55_000.0, 0.0, "left")], "rid long, road_code string, marker_code int, abscissa double, offset double, side string")
    assert {r["rid"]: (r["x"], r["y"]) for r in references.point_from_reference(refs, parts, markers).collect()} == {1: (12_345.0, 3.0), 2: (530_000.0, 40_000.0)}
    spans = spark.createDataFrame([(1, "L", 0, 0.0, 99, 10_000.0), (2, "L", 1, 10.0, 1, 17.0)], "rid long, road_code string, start_marker_code int, start_abscissa double, end_marker_code int, end_abscissa double")
    assert {r["rid"]: (r["length"], len(r["parts"]), len(r["parts"][0])) for r in references.line_from_references(spans, parts, markers).collect()} == {1: (505_000.0, 1, n + 2), 2: (7.0, 1, 3)}


def test_cells_along_a_diagonal_are_few(spark):
    cells = spark.range(1).select(F.explode(g.cells_along(*[F.lit(float(v)) for v in (0, 0, 60_000, 80_000)], 50.0, 50.0)).alias("c")).select("c.*")
    found = {(r["cx"], r["cy"]) for r in cells.collect()}
    assert len(found) < 40_000 and all((int(t * 1200), int(t * 1600)) in found for t in [i / 997 for i in range(997)])


def test_rings_are_walked_from_any_edge(spark):
    rows = [(i, "R", (i + 1) % 5, [(float(i), 0.0), (float((i + 1) % 5), 0.0)]) for i in range(5)] + [(10, "S", 11, [(50.0, 0.0), (60.0, 0.0)]), (11, "S", None, [(60.0, 0.0), (70.0, 0.0)])]
    edges = spark.createDataFrame(rows, f"id long, road_code string, next_edge_id long, geom {g.LINE}")
    starts = spark.createDataFrame([(3,), (11,)], "id long")
    walk = lambda up: {(r["start_id"], r["id"]): r["edge_order"] for r in order.edges_from(edges, starts, up).collect()}
    assert walk(False) == {(3, 3): 1, (3, 4): 2, (3, 0): 3, (3, 1): 4, (3, 2): 5, (11, 11): 1}
    assert walk(True) == {(3, 3): 1, (3, 2): 2, (3, 1): 3, (3, 0): 4, (3, 4): 5, (11, 11): 1, (11, 10): 2}


def test_unknown_values_stop_an_import(spark):
    line = [(0.0, 0.0), (1.0, 0.0)]
    edges = spark.createDataFrame([(1, "A", "motorway", "path", "1", True, "car", False, line)], f"edge_order int, road_code string, road_class string, road_type string, road_class_code string, is_active boolean, road_topic string, is_access_road boolean, geom {g.LINE}")
    markers = spark.createDataFrame([], f"road_code string, code int, abscissa double, is_virtual boolean, geom {g.POINT}")
    with pytest.raises(ValueError, match="road_type, road_class"):
        importing.import_network(edges, markers, spark.createDataFrame([("D",)], "code string"))
    with pytest.raises(ValueError, match="missing columns: geom"):
        importing.import_network(edges.drop("geom"), markers, spark.createDataFrame([("D",)], "code string"))


def test_numbers_follow_the_keys(spark):
    rows = [(float(x % 7), float(x)) for x in range(200)]
    got = importing.numbered(spark.createDataFrame(rows, "x double, y double").repartition(5), ["x", "y"]).collect()
    assert [(r["x"], r["y"]) for r in sorted(got, key=lambda r: r["id"])] == sorted(rows) and sorted(r["id"] for r in got) == list(range(1, 201))


def test_line_assets_follow_their_references(spark):
    edges = spark.createDataFrame([(1, "A", 1, [(0.0, 0.0), (100.0, 0.0)]), (2, "A", 2, [(110.0, 0.0), (200.0, 0.0)])], f"id long, road_code string, edge_order int, geom {g.LINE}")
    markers = spark.createDataFrame([("A", 0, 0.0, (0.0, 0.0))], f"road_code string, code int, abscissa double, geom {g.POINT}")
    parts = segments.road_segments(edges)
    rows = [(1, " A ", 0, 20.0, 0, 150.0, 2.0, None, None), (2, "B", 0, 0.0, 0, 5.0, 0.0, "left", None)]
    barriers = spark.createDataFrame(rows, f"id long, road_code string, start_marker_code int, start_abscissa double, end_marker_code int, end_abscissa double, offset double, side string, parts array<{g.LINE}>")
    drawn = assets.lines_from_references(barriers, parts, markers).cache()
    got = {r["id"]: (r["changed"], r["parts"] and [[tuple(p) for p in line] for line in r["parts"]]) for r in drawn.collect()}
    assert got == {1: (True, [[(20.0, -2.0), (100.0, -2.0)], [(110.0, -2.0), (160.0, -2.0)]]), 2: (False, None)}
    again = assets.references_from_lines(drawn.drop("changed"), parts, markers).collect()
    assert {r["id"]: (r["start_abscissa"], r["end_abscissa"], r["offset"], r["side"], r["changed"]) for r in again} == {1: (20.0, 150.0, 2.0, "right", True), 2: (0.0, 5.0, 0.0, "left", False)}


def test_moved_lines_meet_at_bends(spark):
    """Left: an inner bend, then an outer one with an arc around (10, 10); right: the other way round."""
    edges = spark.createDataFrame([(1, "A", 1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]), (2, "A", 2, [(10.0, 10.0), (20.0, 10.0)])], f"id long, road_code string, edge_order int, geom {g.LINE}")
    markers = spark.createDataFrame([("A", 0, 0.0, (0.0, 0.0))], f"road_code string, code int, abscissa double, geom {g.POINT}")
    refs = spark.createDataFrame([(1, "A", 0, 0.0, 0, 30.0, 1.0, "left"), (2, "A", 0, 5.0, 0, 25.0, 2.0, "right"), (3, "A", 0, 5.0, 0, 25.0, 0.0, "right")], "rid long, road_code string, start_marker_code int, start_abscissa double, end_marker_code int, end_abscissa double, offset double, side string")
    got = {r["rid"]: [[(round(p["x"], 3), round(p["y"], 3)) for p in line] for line in r["parts"]] for r in references.line_from_references(refs, segments.road_segments(edges), markers).collect()}
    def around(x, y, r, a, b):
        """Both tangent points and the eight vertices between, angles in quarters."""
        at = lambda q, d: (round(x + d * math.cos(q * math.pi / 2), 3), round(y + d * math.sin(q * math.pi / 2), 3))
        return [at(a, r), *[at(a + (b - a) * (k + 0.5) / 8, r / math.cos(math.pi / 32)) for k in range(8)], at(b, r)]

    assert got == {1: [[(0.0, 1.0), (9.0, 1.0), *around(10, 10, 1, 2, 1), (20.0, 11.0)]], 2: [[(5.0, -2.0), *around(10, 0, 2, 3, 4), (12.0, 8.0), (15.0, 8.0)]], 3: [[(5.0, 0.0), (10.0, 0.0), (10.0, 10.0), (15.0, 10.0)]]}


@pytest.mark.parametrize("by", [3.0, -3.0, 12.0])
def test_moved_lines_keep_their_distance(spark, by):
    """Zigzags and hooks with offsets above their radii: every vertex and middle of the moved line is as far from the line as asked."""
    turn = np.random.default_rng(8)
    shapes = [np.cumsum(turn.random((9, 2)) * [14, 20] - [0, 10], 0).tolist() for _ in range(12)] + [[[0, 0], [40, 0], [40, 6], [0, 6]], [[0, 0], [20, 0], [22, 1], [20, 2], [0, 2]]]
    rows = [(i, 0, k, *map(float, a), *map(float, b), by) for i, line in enumerate(shapes) for k, (a, b) in enumerate(zip(line, line[1:]))]
    got = {r["key"]: [[(p["x"], p["y"]) for p in line] for line in r["parts"]] for r in offsets.offset_lines(spark.createDataFrame(rows, "key long, part long, k long, x1 double, y1 double, x2 double, y2 double, move double")).collect()}

    def far(p, line):
        def one(a, b):
            d = (b[0] - a[0], b[1] - a[1])
            t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
            return math.hypot(a[0] + t * d[0] - p[0], a[1] + t * d[1] - p[1])

        return min(one(a, b) for a, b in zip(line, line[1:]))

    assert len(got) >= 12
    for i, parts in got.items():
        for line in parts:
            assert all(-1e-4 <= far(p, shapes[i]) - abs(by) <= 1e-4 + 0.006 * abs(by) for p in line)
            assert all(far(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), shapes[i]) >= abs(by) - 1e-3 for p, q in zip(line, line[1:]))


def test_reverted_updates_go(spark):
    rows = [(1, "U", 5, None, (5, None)), (2, "U", 6, "x", (5, "x")), (3, "D", 5, "x", (5, "x")), (4, "I", 1, None, None), (5, "U", 1, None, None)]
    changes = spark.createDataFrame(rows, "id long, op string, a int, b string, old struct<a:int,b:string>")
    assert sorted(r["id"] for r in sessions.drop_reverted_changes(changes, ["a", "b"]).collect()) == [2, 3, 4, 5]


def test_cells_of_a_changed_area(spark):
    """Cells 10,000 km apart are two, but for a query that numbers them as its SQL does."""
    from pyspark.sql import functions as F

    from linref.operators import assets

    pts = spark.createDataFrame([(5.0, 10_000_005.0), (15.0, 5.0), (16.0, 6.0)], "x double, y double")
    by = F.floor(F.col("x") / 10) * 1000000 + F.floor(F.col("y") / 10)
    count = lambda **k: assets.changed_area("p", pts, **k).where("n > 0").first()["cells"]
    assert (count(), count(cell=by)) == (2, 1)
