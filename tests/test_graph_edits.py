"""Merges, snapping, rings, faces and overlay against brute force, and cases that the derived network does not have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linref.functions import geometry as g
from linref.operators import chains, order, planar, references, segments, topology

EDGE = f"id long, road_code string, start_node long, end_node long, previous_edge_id long, next_edge_id long, geom {g.LINE}, note string"
MARKER = f"road_code string, code int, abscissa double, geom {g.POINT}"
NODE = "id long, x double, y double"


def edge(i, road, s, e, line, p=None, n=None, note=None):
    return (i, road, s, e, p, n, [(float(x), float(y)) for x, y in line], note)


def lines(df, *names):
    return {r["id"]: tuple(r[c] for c in names) + ([tuple(p) for p in r["geom"]],) for r in df.collect()}


# Merging


def test_edges_that_leave_the_same_node_become_one_proper_line(spark):
    rows = [edge(1, "A", 1, 2, [(0, 0), (10, 0)], note="a"), edge(2, "A", 1, 3, [(0, 0), (0, 10)], note="b")]
    assert lines(topology.merge_graph(spark.createDataFrame(rows, EDGE)), "start_node", "end_node", "merged", "note") == {1: (3, 2, 2, "a", [(0, 10), (0, 0), (10, 0)])}
    rows = [(-r[0], *r[1:]) for r in rows]  # ids below 0 as well
    assert lines(topology.merge_graph(spark.createDataFrame(rows, EDGE)), "start_node", "end_node", "merged", "note") == {-2: (2, 3, 2, "b", [(10, 0), (0, 0), (0, 10)])}


def test_runs_turn_to_their_least_edge_and_rings_close_there(spark):
    rows = [edge(7, "A", 1, 2, [(0, 0), (1, 0)], None, 5), edge(5, "A", 3, 2, [(2, 0), (1, 0)], 9, 7), edge(9, "A", 3, 4, [(2, 0), (3, 0)], 5, 20), edge(20, "A", 4, 5, [(3, 0), (4, 0)], 9, None), edge(21, "B", 4, 6, [(3, 0), (3, 5)])]
    rows += [edge(30 + k, "R", 30 + k, 30 + (k + 1) % 3, [(50 + k, 0), (50 + (k + 1) % 3, 0)], 30 + (k + 2) % 3, 30 + (k + 1) % 3) for k in range(3)]
    rows += [edge(40, "S", 40, 40, [(80, 0), (81, 0), (81, 1), (80, 0)]), edge(41, "S", 40, 42, [(80, 0), (79, 0)])]  # a loop's node has three ends
    got = lines(topology.merge_graph(spark.createDataFrame(rows, EDGE)), "start_node", "end_node", "previous_edge_id", "next_edge_id", "merged")
    assert got == {5: (4, 1, 20, None, 3, [(3, 0), (2, 0), (1, 0), (0, 0)]), 20: (4, 5, 5, None, 1, [(3, 0), (4, 0)]), 21: (4, 6, None, None, 1, [(3, 0), (3, 5)]), 30: (30, 30, 30, 30, 3, [(50, 0), (51, 0), (52, 0), (50, 0)]),
                   40: (40, 40, None, None, 1, [(80, 0), (81, 0), (81, 1), (80, 0)]), 41: (40, 42, None, None, 1, [(80, 0), (79, 0)])}


def test_marker_zero_on_a_lost_node_moves_and_references_follow(spark):
    rows = [edge(1, "A", 1, 2, [(0, 0), (10, 0)], None, 2), edge(2, "A", 2, 3, [(10, 0), (30, 0)], 1, None), edge(3, "B", 7, 8, [(0, 99), (5, 99)])]
    markers = spark.createDataFrame([("A", 0, 0.0, (10.2, 0.1)), ("A", 1, 0.0, (20.0, 0.0)), ("B", 0, 0.0, (10.0, 0.0))], MARKER)
    out, moved = topology.merge_and_reference(spark.createDataFrame(rows, EDGE), markers)
    assert sorted((r["road_code"], r["code"], tuple(r["geom"])) for r in moved.collect()) == [("A", 0, (0.0, 0.0)), ("A", 1, (20.0, 0.0)), ("B", 0, (10.0, 0.0))]
    assert {r["id"]: (r["start_marker"], r["start_cumulative"], r["end_marker"], r["end_abscissa"], r["end_cumulative"]) for r in out.collect()} == {1: (0, 0.0, 1, 10.0, 30.0), 3: (None, None, None, None, None)}


@pytest.mark.parametrize("seed", range(2))
def test_random_chains_merge_as_one_by_one(spark, seed):
    """Chains of random lengths and directions, some closed, against merging one node after the other."""
    turn, rows, node, at = np.random.default_rng(seed), [], 0, []
    for chain in range(12):
        n, closed = int(turn.integers(1, 40)), chain % 4 == 0
        for k in range(n):
            a, b = (node + k, node + (0 if closed and k == n - 1 else k + 1))
            pts = [(a, chain), (b, chain)]
            if a == b:
                pts = [(a, chain), (a, chain + 0.5), (a, chain)]
            at.append((a, b, pts) if turn.random() < 0.5 else (b, a, pts[::-1]))
        node += n + 1
    ids = turn.permutation(len(at)) + 1
    rows = [edge(int(i), "A", a, b, p) for i, (a, b, p) in zip(ids, at, strict=True)]
    pool = {r[0]: (r[2], r[3], r[6]) for r in rows}
    again = True
    while again:
        again = False
        ends = {}
        for i, (s, e, _) in pool.items():
            ends.setdefault(s, []).append((i, 0))
            ends.setdefault(e, []).append((i, 1))
        for two in ends.values():
            if len(two) == 2 and two[0][0] != two[1][0]:
                (i, p), (j, q) = sorted(two)
                s, e, line = pool[i]
                s2, e2, other = pool.pop(j)
                if p == 1:
                    pool[i] = (s, e2 if q == 0 else s2, line + (other if q == 0 else other[::-1])[1:])
                else:
                    pool[i] = (s2 if q == 1 else e2, e, (other if q == 1 else other[::-1])[:-1] + line)
                again = True
                break
    got = {i: v for i, v in lines(topology.merge_graph(spark.createDataFrame(rows, EDGE)), "start_node", "end_node").items()}
    assert got.keys() == pool.keys()
    for i, (s, e, line) in pool.items():
        if s != e:
            assert got[i] == (s, e, line)
        else:  # a closed line may begin at another of its nodes
            assert got[i][0] == got[i][1] and sorted(map(sorted, zip(got[i][2], got[i][2][1:]))) == sorted(map(sorted, zip(line, line[1:])))


# Snapping


def snapped_one_by_one(rows, nodes, near=0.5):
    known, top, out = dict(nodes), max(nodes, default=0), {}
    for i, line in sorted(rows.items()):
        mine = []
        for p in (line[0], line[-1]):
            reach = [k for k, q in known.items() if math.hypot(p[0] - q[0], p[1] - q[1]) <= near]
            if not reach:
                top += 1
                known[top] = p
                reach = [top]
            mine.append(min(reach))
        out[i] = (*mine, [known[mine[0]], *line[1:-1], known[mine[1]]])
    return out, known


@pytest.mark.parametrize("spread", [2.0, 30.0])
def test_ends_snap_as_one_by_one(spark, spread):
    turn = np.random.default_rng(int(spread))
    rows = {int(i): [tuple(np.round(turn.random(2) * spread, 2).tolist()) for _ in range(3)] for i in turn.permutation(150)}
    nodes = {int(k): tuple((turn.random(2) * spread).tolist()) for k in range(3, 9)}
    edges = spark.createDataFrame([(i, "A", line) for i, line in rows.items()], f"id long, road_code string, geom {g.LINE}").repartition(3)
    e, n = topology.snap_ends(edges, spark.createDataFrame([(k, *p) for k, p in nodes.items()], NODE))
    want, known = snapped_one_by_one(rows, nodes)
    assert lines(e, "start_node", "end_node") == want
    assert {r["id"]: (r["x"], r["y"]) for r in n.collect()} == known


def test_the_second_edge_takes_the_node_of_the_first(spark):
    edges = spark.createDataFrame([(1, "A", [(0.0, 0.0), (10.0, 0.0)]), (2, "A", [(10.2, 0.0), (20.0, 0.0)])], f"id long, road_code string, geom {g.LINE}")
    e, n = topology.snap_ends(edges, spark.createDataFrame([], NODE))
    assert lines(e, "start_node", "end_node") == {1: (1, 2, [(0.0, 0.0), (10.0, 0.0)]), 2: (2, 3, [(10.0, 0.0), (20.0, 0.0)])} and n.count() == 3


# Rings and faces


def ring(spark, points, road="G"):
    n = len(points)
    return spark.createDataFrame([edge(k, road, None, None, [points[k], points[(k + 1) % n]] if k % 2 else [points[(k + 1) % n], points[k]]) for k in range(n)], EDGE)


def test_chords_between_ring_nodes_are_inside(spark):
    square = ring(spark, [(0, 0), (10, 0), (10, 10), (0, 10)])
    other = [edge(101, "C", None, None, [(2, 5), (8, 5)]), edge(102, "C", None, None, [(0, 5), (10, 5)]), edge(103, "C", None, None, [(5, 0), (5, 10)]), edge(104, "C", None, None, [(5, 5), (5, 10.3)]), edge(105, "C", None, None, [(0, 10.05), (10, 10.05)]), edge(106, "C", None, None, [(20, 5), (30, 5)]), edge(107, "G", None, None, [(2, 5), (8, 5)])]
    got = topology.clean_roundabouts(square, spark.createDataFrame(other, EDGE)).collect()
    assert sorted((r["id"], r["ring_road"]) for r in got) == [(101, "G"), (102, "G"), (103, "G"), (105, "G")]


def test_lines_that_leave_a_concave_ring_between_two_vertices(spark):
    horse = ring(spark, [(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30)])
    other = [edge(101, "C", None, None, [(5, 25), (25, 25)]), edge(102, "C", None, None, [(5, 25), (5, 5), (25, 5), (25, 25)]), edge(103, "C", None, None, [(10.05, 25), (10.05, 12)]), edge(104, "C", None, None, [(5, 9.95), (25, 10.05)]), edge(105, "C", None, None, [(15, 20), (15, 25)]), edge(106, "C", None, None, [(5, 5), (5, 5), (6, 6)]), edge(107, "C", None, None, [(15, 15), (15, 15)])]
    got = topology.clean_roundabouts(horse, spark.createDataFrame(other, EDGE)).collect()
    assert sorted(r["id"] for r in got) == [102, 103, 104, 106]
    gap = horse.where("id != 3")
    assert topology.clean_roundabouts(gap, spark.createDataFrame(other, EDGE)).isEmpty()


def test_lines_in_rings_against_a_raster(spark):
    turn = np.random.default_rng(4)
    angles = np.sort(turn.random(40)) * 2 * math.pi
    shape = [(float(r * math.cos(a)), float(r * math.sin(a))) for a, r in zip(angles, 20 + 10 * turn.random(40), strict=True)]
    other = [[tuple(p) for p in (turn.random((3, 2)) * 50 - 25).tolist()] for _ in range(120)]
    other += [[tuple(p) for p in (turn.random((3, 2)) * 6 + turn.random(2) * 20 - 10).tolist()] for _ in range(120)]

    def depth(p):
        """How far inside (positive) or outside (negative) the ring."""
        odd, best = False, math.inf
        for a, b in zip(shape, shape[1:] + shape[:1], strict=True):
            odd ^= (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]
            d = (b[0] - a[0], b[1] - a[1])
            t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
            best = min(best, math.hypot(a[0] + t * d[0] - p[0], a[1] + t * d[1] - p[1]))
        return best if odd else -best

    least = [min(depth((a[0] + (b[0] - a[0]) * k / 200, a[1] + (b[1] - a[1]) * k / 200)) for a, b in zip(line, line[1:]) for k in range(201)) for line in other]
    got = {r["id"] for r in topology.clean_roundabouts(ring(spark, shape), spark.createDataFrame([edge(100 + i, "C", None, None, line) for i, line in enumerate(other)], EDGE)).collect()}
    assert all((100 + i in got) == (d > -0.1) for i, d in enumerate(least) if abs(d + 0.1) > 0.02) and 20 < len(got) < 220


def test_marker_zero_only_where_there_is_none(spark):
    square = ring(spark, [(0, 0), (10, 0), (10, 10), (0, 10)]).withColumns({"start_node": F.col("id") + 50, "end_node": F.col("id") + 51})
    roads = spark.createDataFrame([("G", "roundabout")], "road_code string, road_type string")
    none = spark.createDataFrame([("G", 1, 0.0, (0.0, 0.0))], MARKER)
    assert topology.clean_roundabout_graph(square, roads, none)[1].count() == 1
    assert topology.clean_roundabout_graph(square, roads, none.withColumn("code", F.lit(0)))[1].count() == 0


def test_faces_of_a_grid_with_dangles(spark):
    """A grid of 3 x 2 fields, a dangling edge in one, a bridge to a triangle outside."""
    rows, i = [], 0
    for x in range(4):
        for y in range(3):
            for a, b in (((x, y), (x + 1, y)), ((x, y), (x, y + 1))):
                if b[0] < 4 and b[1] < 3:
                    i += 1
                    rows.append(edge(i, "A", None, None, [a, b] if i % 3 else [b, a]))
    rows += [edge(90, "A", None, None, [(0, 0), (0.5, 0.5)]), edge(91, "A", None, None, [(3, 1), (5, 1)]), edge(92, "A", None, None, [(5, 1), (7, 1), (7, 1), (6, 2)]), edge(93, "A", None, None, [(5, 1), (6, 2)]), edge(94, "A", None, None, [(9, 9), (9, 9)])]
    got = planar.faces(spark.createDataFrame(rows, EDGE)).collect()
    assert sorted((round(r["area"], 9), r["n_points"]) for r in got) == [(-6.0, 10), (-1.0, 3)] + [(1.0, 3)] + [(1.0, 4)] * 6
    assert all(r["ring"][0] == r["ring"][-1] for r in got)
    both = spark.createDataFrame(rows + [edge(200 + k, "B", None, None, [(100 + x, y), (100 + u, v)]) for k, (x, y, u, v) in enumerate([(0, 0, 3, 0), (0, 4, 0, 0), (3, 0, 0, 4)])], EDGE)
    rings = {r["road_code"]: len(r["ring"]) for r in planar.exterior_rings(both, ["road_code"]).collect()}
    assert rings == {"A": 11, "B": 4}


# Overlay


def test_crossings_split_all_edges_in_one_pass(spark):
    """A zigzag crosses a long edge at 10, 20, 30, and a second edge crosses it 0.3 m from the first crossing."""
    rows = [edge(1, "A", 1, 2, [(0, 0), (100, 0)], None, 2), edge(2, "A", 2, 3, [(100, 0), (200, 0)], 1, None), edge(3, "B", 4, 5, [(5, -5), (15, 5), (25, -5), (35, 5)]), edge(4, "C", 6, 7, [(10.3, -9), (10.3, 9)])]
    edges = spark.createDataFrame(rows, EDGE).withColumns({"start_cumulative": F.lit(7.0), "end_cumulative": F.lit(0.0)})
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0), (4, 5.0, -5.0), (5, 35.0, 5.0), (6, 10.3, -9.0), (7, 10.3, 9.0)], NODE)
    out, every = planar.overlay(edges, nodes)
    known = {r["id"]: (r["x"], r["y"]) for r in every.collect()}
    assert {k: v for k, v in known.items() if k > 7} == {8: (10.0, 0.0), 9: (20.0, 0.0), 10: (30.0, 0.0)}
    got = {(r["edge_id"], r["piece"]): r for r in out.collect()}
    ends = {k: (r["start_node"], r["end_node"]) for k, r in got.items()}
    assert ends == {(1, 0): (1, 8), (1, 1): (8, 9), (1, 2): (9, 10), (1, 3): (10, 2), (2, 0): (2, 3), (3, 0): (4, 8), (3, 1): (8, 9), (3, 2): (9, 10), (3, 3): (10, 5), (4, 0): (6, 8), (4, 1): (8, 7)}
    for r in got.values():
        assert tuple(r["geom"][0]) == known[r["start_node"]] and tuple(r["geom"][-1]) == known[r["end_node"]]
    one = [got[(1, k)] for k in range(4)]
    assert [r["previous_edge_id"] for r in one] == [None, 1, one[1]["id"], one[2]["id"]] and [r["next_edge_id"] for r in one] == [one[1]["id"], one[2]["id"], one[3]["id"], 2]
    assert got[(2, 0)]["previous_edge_id"] == one[3]["id"] and [(r["start_cumulative"], r["end_cumulative"]) for r in one] == [(7.0, 17.0), (17.0, 27.0), (27.0, 37.0), (37.0, 107.0)]
    only, _ = planar.overlay(edges, nodes, changed=spark.createDataFrame([(4,)], "id long"))
    assert {(r["edge_id"], r["piece"]) for r in only.collect()} == {(1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (4, 0), (4, 1)}


def test_a_half_that_exists_is_not_made_again(spark):
    """Two edges that share their second half, cut at the same node, keep one half; a third edge is that half, the other way."""
    rows = [edge(1, "A", 1, 3, [(0, 0), (50, 0), (100, 0)], None, 9), edge(2, "B", 2, 3, [(0, 10), (50, 0), (100, 0)]), edge(9, "A", 3, 8, [(100, 0), (120, 0)], 1, None)]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 10.0), (3, 100.0, 0.0), (4, 50.0, 0.0), (8, 120.0, 0.0)], NODE)
    roads = spark.createDataFrame([("A", "road"), ("B", "roundabout")], "road_code string, road_type string")
    out, _ = planar.overlay(spark.createDataFrame(rows, EDGE), nodes, roads)
    assert lines(out, "start_node", "end_node", "previous_edge_id", "next_edge_id") == {1: (1, 4, None, 10, [(0, 0), (50, 0)]), 10: (4, 3, 1, 9, [(50, 0), (100, 0)]), 2: (2, 4, None, None, [(0, 10), (50, 0)]), 9: (3, 8, 10, None, [(100, 0), (120, 0)])}
    more = spark.createDataFrame(rows + [edge(3, "C", 3, 4, [(100, 0), (50, 0)])], EDGE)
    assert {r["id"] for r in planar.overlay(more, nodes, roads)[0].collect()} == {1, 2, 3, 9}


# Repeated vertices


def test_repeated_vertices(spark):
    twice = [(0.0, 0.0), (5.0, 0.0), (5.0, 0.0), (10.0, 0.0)]
    edges = spark.createDataFrame([(1, "A", 1, twice), (2, "A", 2, [(10.0, 0.0), (10.0, 0.0)]), (3, "A", 3, [(10.0, 0.0), (10.0, 10.0)])], f"id long, road_code string, edge_order int, geom {g.LINE}")
    parts = segments.road_segments(edges)
    markers = spark.createDataFrame([("A", 0, 0.0, (0.0, 0.0))], MARKER)
    spans = spark.createDataFrame([(1, "A", 0, 2.0, 0, 15.0, 1.0, "left"), (2, "A", 0, 5.0, 0, 5.0, 0.0, "left")], "rid long, road_code string, start_marker_code int, start_abscissa double, end_marker_code int, end_abscissa double, offset double, side string")
    got = {r["rid"]: (r["error"], r["length"], r["parts"] and [[(round(p["x"], 3), round(p["y"], 3)) for p in line] for line in r["parts"]]) for r in references.line_from_references(spans, parts, markers).collect()}
    assert got == {1: (None, 13.0, [[(2.0, 1.0), (5.0, 1.0), (9.0, 1.0), (9.0, 5.0)]]), 2: (None, None, None)}
    refs = spark.createDataFrame([(1, "A", 0, 5.0, 2.0, "left"), (2, "A", 0, 10.0, 2.0, "right")], "rid long, road_code string, marker_code int, abscissa double, offset double, side string")
    assert {r["rid"]: (r["x"], r["y"]) for r in references.point_from_reference(refs, parts, markers).collect()} == {1: (5.0, 2.0), 2: (10.0, -2.0)}
    assert [[[tuple(p) for p in line] for line in r["parts"]] for r in references.downstream_line(refs.where("rid = 1"), parts, markers).collect()] == [[[(0.0, 0.0), (5.0, 0.0), (10.0, 0.0), (10.0, 10.0)]]]
    cut = topology.split_edges(edges, spark.createDataFrame([(1, 7, 5.0)], "edge_id long, node_id long, m double"))
    assert sorted((r["edge_id"], r["piece"], [tuple(p) for p in r["geom"]]) for r in cut.collect()) == [(1, 0, [(0.0, 0.0), (5.0, 0.0)]), (1, 1, [(5.0, 0.0), (10.0, 0.0)]), (2, 0, [(10.0, 0.0), (10.0, 0.0)]), (3, 0, [(10.0, 0.0), (10.0, 10.0)])]


def test_a_chain_that_is_a_ring_and_one_that_is_not(spark):
    back = spark.createDataFrame([(1, "A", None), (2, "A", 1), (3, "A", 2), (10, "A", 12), (11, "A", 10), (12, "A", 11), (20, "B", None)], "id long, road_code string, to long")
    done, rings = order.walked(back)
    assert {r["id"]: (r["head"], r["steps"]) for r in done.collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 10: (10, 0), 11: (10, 1), 12: (10, 2), 20: (20, 0)}
    assert [(r["head"], r["size"]) for r in rings.collect()] == [(10, 3)] and chains.SNAP == 0.5


def test_the_streamed_log_does_not_depend_on_the_order_of_its_batches(spark, tmp_path):
    """Batches with crossed sequence numbers, some ops twice, give what the whole log in order gives."""
    from linref.operators import sessions
    from linref.streaming.streams import stream_compact_log

    turn = np.random.default_rng(2)
    ops = [(int(s), "edges", int(turn.integers(25)), str(turn.choice(["I", "U", "U", "D"]))) for s in range(200)]
    mixed = [ops[i] for i in turn.permutation(200)] + ops[:20]
    schema = "seq long, table_name string, id long, op string"
    for k in range(4):
        spark.createDataFrame(mixed[k * 55 : k * 55 + 55], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream = stream_compact_log(log).writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(name, before)
    done = spark.read.parquet(str(tmp_path / "out")).groupBy("id").agg(F.max_by("op", "n").alias("op")).where("op is not null")
    want = sessions.compact_log(spark.createDataFrame(ops, schema))
    assert sorted((r["id"], r["op"]) for r in done.collect()) == sorted((r["id"], r["op"]) for r in want.collect())
    assert spark.read.parquet(str(tmp_path / "out")).select("n").distinct().count() == 4


# Outlines of changed objects


def test_outlines_against_a_raster(spark):
    """A crowd, a ring of discs around a hole, single discs and repeated points: areas by table and by ring."""
    from linref.operators import areas

    turn = np.random.default_rng(6)
    crowd = (turn.random((400, 2)) * [30, 12]).tolist()
    around = [(100 + 25 * math.cos(k * math.pi / 8), 25 * math.sin(k * math.pi / 8)) for k in range(16)]
    rows = [("a", float(x), float(y)) for x, y in [*crowd, *around, *crowd[:50]]] + [("b", 7e6, 7e6), ("b", 7e6 + 5, 7e6), ("b", None, 1.0), ("c", 0.0, 0.0)]
    arcs = areas.outline(spark.createDataFrame(rows, "table_name string, x double, y double").repartition(3))
    got = [(r["table_name"], r["arcs"], r["length"], r["area"]) for r in areas.outline_rings(arcs).collect()]
    step = 0.05
    gx, gy = np.meshgrid(np.arange(-11, 136, step) + step / 2, np.arange(-36, 36, step) + step / 2)
    inside = np.zeros(gx.shape, bool)
    for x, y in [*crowd, *around]:
        inside |= (gx - x) ** 2 + (gy - y) ** 2 <= 100
    a = [r for r in got if r[0] == "a"]
    assert len(a) == 3 and sum(r[3] < 0 for r in a) == 1 and abs(sum(r[3] for r in a) - inside.sum() * step * step) < 2.0
    lens = 200 * math.acos(0.25) - 2.5 * math.sqrt(400 - 25)
    assert [round(r[3], 4) for r in got if r[0] == "b"] == [round(200 * math.pi - lens, 4)]
    assert [(r[1], round(r[2], 6), round(r[3], 6)) for r in got if r[0] == "c"] == [(1, round(20 * math.pi, 6), round(100 * math.pi, 6))]
    assert areas.outline_rings(areas.outline(spark.createDataFrame([], "table_name string, x double, y double"))).isEmpty()
