"""Queries go through every step of the method that they are named after."""

from pyspark.sql import functions as F

from linref.functions import geometry as g
from linref.operators import clusters, importing, planar, references, topology
from linref.plans import registry
from linref.sources.derived import Network

SF = "/root/testdata/sf0.001"


def test_a_layer_finds_its_roads(spark):
    """Points that name a road that there is not take the nearest one."""
    class Astray(Network):
        @property
        def points(self):
            return super().points.withColumn("road_code", F.lit("nowhere"))

    n = Astray(spark, SF)
    got, want = registry.layer_references(n).drop("changed").collect(), registry.assets_references(Network(spark, SF)).collect()
    assert sorted(got) == sorted(want) and any(r["side"] for r in got)


def test_lines_from_references_are_moved(spark):
    """A line begins at the point that its start names with its offset, but for what an inner bend takes."""
    n = Network(spark, SF)
    lines = {r["rid"]: r for r in registry.line_from_references(n).where("length is not null").collect()}
    at = {r["rid"]: r for r in references.point_from_reference(registry.requests(n).withColumnRenamed("off", "offset"), n.segments, n.markers).collect()}
    far = [max(abs(r["x"] - at[i]["x"]), abs(r["y"] - at[i]["y"])) for i, r in lines.items()]
    # Where a span starts at a vertex, the point is on the edge before it and the line on the one after, beyond a gap of 10 m at most.
    assert len(far) > 100 and max(far) < 15 and sum(d <= 0.51 for d in far) > 0.9 * len(far)


def test_tables_that_grow_are_not_sent_whole(spark):
    """Ends and nodes, however few, are joined by a shuffle: how large they are is not known from the files that they are made of."""
    # Rows of a text, of which Spark knows that they are few.
    p = lambda x, y: f"named_struct('x', {x}D, 'y', {y}D)"
    edges = spark.sql(f"SELECT * FROM VALUES (1L, 'A', array({p(0, 0)}, {p(10, 0)}), 1L, 2L), (2L, 'B', array({p(5, -5)}, {p(5, 5)}), 3L, 4L) AS t(id, road_code, geom, start_node, end_node)")
    nodes = spark.sql("SELECT * FROM VALUES (1L, 0.1D, 0D) AS t(id, x, y)")
    snapped = topology.snap_ends(edges, nodes)[0]
    for df in (topology.intersections(edges, nodes), topology.touching_nodes(edges, nodes), clusters.nodes_in_reach(nodes, nodes, 0.5, ["id"]), snapped, planar.crossings(edges), importing.with_nodes(edges, nodes)):
        joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Broadcast" in line and "Join" in line]
        assert all("__b#" in line for line in joins)  # numbered() sends its counts of ranges
    assert [tuple(r) for r in topology.intersections(edges, nodes).collect()] == [(1, 2, 5.0, 0.0)]
    assert {r["id"]: (r["start_node"], r["end_node"]) for r in snapped.collect()} == {1: (1, 2), 2: (3, 4)}


def test_pieces_are_dealt_out_by_their_edge_alone(spark):
    """Nodes are found by the place of a cut among its edge's, two nodes at one place too, so no row goes along with a length as its key."""
    edge = lambda i, p, n, x: (i, "A", p, n, i * 10, i * 10 + 10, [(x, 0.0), (x + 10.0, 0.0)])
    edges = spark.createDataFrame([edge(1, None, 2, 0.0), edge(2, 1, None, 10.0)], f"id long, road_code string, previous_edge_id long, next_edge_id long, start_node long, end_node long, geom {g.LINE}")
    cut = spark.createDataFrame([(1, 7, 6.0), (1, 9, 2.0), (1, 8, 2.0), (2, 5, 0.0)], "edge_id long, node_id long, m double")
    out = topology.split_graph(edges, cut)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and ("start_m" in line or "end_m" in line) for line in plan.splitlines())
    got = {(r["edge_id"], r["piece"]): (r["id"], r["previous_edge_id"], r["next_edge_id"], r["start_node"], r["end_node"], r["start_m"], r["end_m"]) for r in out.collect()}
    assert got == {(1, 0): (1, None, 3, 10, 8, 0.0, 2.0), (1, 1): (3, 1, 4, 8, 7, 2.0, 6.0), (1, 2): (4, 3, 2, 7, 20, 6.0, 10.0), (2, 1): (5, None, None, 5, 30, 0.0, 10.0)}


def test_lines_do_not_go_along_links(spark):
    """Chains of moved edges are led past and links of the new road found, while lines are dealt out by the edge's id alone."""
    edge = lambda i, road, p, n, s: (i, road, p, n, s, s + 1, [(float(s), 0.0), (s + 1.0, 0.0)])
    edges = spark.createDataFrame([edge(1, "A", None, 2, 0), edge(2, "A", 1, 3, 1), edge(3, "A", 2, 4, 2), edge(4, "A", 3, None, 3), edge(5, "B", None, None, 3)], f"id long, road_code string, previous_edge_id long, next_edge_id long, start_node long, end_node long, geom {g.LINE}")
    out = topology.move_edge_road(edges, spark.createDataFrame([(2, "B"), (3, "B")], "id long, new_road string"))
    for df in (out, topology.infer_neighbours(edges)):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not any("Exchange hashpartitioning(" in a and "Exchange hashpartitioning(id#" not in a and "geom" in b for a, b in zip(lines, lines[1:]))
    assert {r["id"]: (r["road_code"], r["previous_edge_id"], r["next_edge_id"], len(r["geom"])) for r in out.collect()} == {1: ("A", None, 4, 2), 2: ("B", None, 3, 2), 3: ("B", 2, 5, 2), 4: ("A", 1, None, 2), 5: ("B", 3, None, 2)}
