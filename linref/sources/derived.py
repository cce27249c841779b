"""A road network derived from the given tables: each order is a road, each of its line items an edge."""

from __future__ import annotations

import re
from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.functions import geometry as g
from linref.functions.lineage import settle_by

#: Accepted by Spark and by ANSI engines alike. Directions are 3-4-5 triangles, so lengths are whole; return flag A leaves a 10 m gap.
EDGES_SQL = """
WITH l AS (
 SELECT l_orderkey, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
g AS (SELECT *, CASE WHEN l_returnflag='A' AND n>1 THEN 2 ELSE 0 END AS gap, CASE WHEN n%2=1 THEN 3 ELSE 4 END AS ux, CASE WHEN n%2=1 THEN 4 ELSE 3 END AS uy FROM l),
c AS (SELECT *, sum(ux*q+ux*gap) OVER w AS xe, sum(uy*q+uy*gap) OVER w AS ye, sum(q) OVER w AS qe, sum(q+gap) OVER w AS ge FROM g
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT l_orderkey*100+n AS id, l_orderkey AS okey, concat('D', CAST(l_orderkey AS VARCHAR(20))) AS road_code, CAST(n AS INT) AS edge_order, ux, uy, q, gap,
 CAST((l_orderkey % 500)*4000 + xe-ux*q AS DOUBLE) AS x1, CAST(floor(l_orderkey/500)*4000 + ye-uy*q AS DOUBLE) AS y1,
 CAST((l_orderkey % 500)*4000 + xe AS DOUBLE) AS x2, CAST(floor(l_orderkey/500)*4000 + ye AS DOUBLE) AS y2,
 CAST(5*(ge-q) AS DOUBLE) AS mg1, CAST(5*ge AS DOUBLE) AS mg2, CAST(5*(qe-q) AS DOUBLE) AS mn1, CAST(5*qe AS DOUBLE) AS mn2, (l_linestatus='F' OR n=1) AS has_marker FROM c"""
MARKS_SQL = "SELECT road_code, CAST(row_number() OVER (PARTITION BY road_code ORDER BY edge_order) - 1 AS INT) AS code, CAST(0 AS DOUBLE) AS abscissa, x1 AS x, y1 AS y, mg1 AS mg, mn1 AS mn FROM e WHERE has_marker"
POINTS_SQL = """SELECT v.event_id AS pid, e.road_code, CAST(x1 + ux*(v.event_id % q) - uy*(v.event_id % 15 - 7 + CASE WHEN v.event_id % 50 = 0 THEN 20 ELSE 0 END) AS DOUBLE) AS x,
 CAST(y1 + uy*(v.event_id % q) + ux*(v.event_id % 15 - 7 + CASE WHEN v.event_id % 50 = 0 THEN 20 ELSE 0 END) AS DOUBLE) AS y
 FROM events v JOIN e ON e.id = v.event_id*100 + 1 + v.event_id % 3"""
LOG_SQL = "SELECT 'edges' AS table_name, user_id AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events"

class Network:
    """The derived tables of one folder.

    Edges are computed once into a table dealt out by road; markers, segments and whatever else is made road by road need no shuffle then."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def flat(self) -> DataFrame:
        """The rows of EDGES_SQL, by road in place of order key, of which each has its own. The table holds what running lengths are made of."""
        line = self.table("lineitem").select(F.expr("concat('D', CAST(l_orderkey AS VARCHAR(20)))").alias("road_code"), F.col("l_orderkey").alias("okey"), (F.col("l_returnflag") == "A").alias("a"), (F.col("l_linestatus") == "F").alias("f"),
                                             F.expr("CAST(l_quantity AS BIGINT)").alias("q"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        order = Window.partitionBy("road_code").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        rows = line.select("road_code", "okey", "a", "f", "q", F.row_number().over(order).alias("n"))
        rows = rows.selectExpr("road_code", "okey", "CAST(n AS INT) AS n", "q", "CASE WHEN a AND n>1 THEN 2 ELSE 0 END AS gap", "f OR n=1 AS has_marker")
        c = settle_by(rows, "road_code").withColumns({"ux": F.expr("CASE WHEN n%2=1 THEN 3 ELSE 4 END"), "uy": F.expr("CASE WHEN n%2=1 THEN 4 ELSE 3 END")})
        w = Window.partitionBy("road_code").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        runs = {"xe": "ux*q+ux*gap", "ye": "uy*q+uy*gap", "qe": "q", "ge": "q+gap"}
        c = c.select("*", *[F.sum(F.expr(e)).over(w).alias(k) for k, e in runs.items()])
        return c.selectExpr("okey*100+n AS id", "okey", "road_code", "n AS edge_order", "ux", "uy", "q", "gap",
                            "CAST((okey % 500)*4000 + xe-ux*q AS DOUBLE) AS x1", "CAST(floor(okey/500)*4000 + ye-uy*q AS DOUBLE) AS y1", "CAST((okey % 500)*4000 + xe AS DOUBLE) AS x2", "CAST(floor(okey/500)*4000 + ye AS DOUBLE) AS y2",
                            "CAST(5*(ge-q) AS DOUBLE) AS mg1", "CAST(5*ge AS DOUBLE) AS mg2", "CAST(5*(qe-q) AS DOUBLE) AS mn1", "CAST(5*qe AS DOUBLE) AS mn2", "has_marker")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, *tables: str, **views: DataFrame) -> DataFrame:
        """text over tables of the folder and other views by their names; the caller's views stay as they are."""
        named = {t: self.table(t) for t in tables} | views
        tag = uuid4().hex
        for name, df in named.items():
            df.createOrReplaceTempView(f"{name}_{tag}")
            # The table keeps its name in the text, but for `events v`, which has one already.
            text = re.sub(rf"\b(FROM|JOIN) {name}\b( v\b)?", lambda m, n=name: f"{m[1]} {n}_{tag}{m[2] or f' AS {n}'}", text)
        out = self.spark.sql(text)
        for name in named:
            self.spark.catalog.dropTempView(f"{name}_{tag}")
        return out

    @property
    def edges(self) -> DataFrame:
        p = g.line(g.point("x1", "y1"), g.point("x2", "y2"))
        return self.flat.select("id", "road_code", "edge_order", p.alias("geom"))

    @property
    def linked(self) -> DataFrame:
        """edges with links and nodes; a node's id is made of its coordinates."""
        from linref.operators.order import neighbours

        node = lambda p: (p["x"].cast("long") * 1_000_000_000 + p["y"].cast("long"))
        geom = F.col("geom")
        return neighbours(self.edges).withColumn("start_node", node(g.start_point(geom))).withColumn("end_node", node(g.end_point(geom)))

    @property
    def nodes(self) -> DataFrame:
        geom = F.col("geom")
        at = self.edges.select(F.explode(F.array(g.start_point(geom), g.end_point(geom))).alias("p")).select(F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
        return at.select((F.col("x").cast("long") * 1_000_000_000 + F.col("y").cast("long")).alias("id"), "x", "y")

    @property
    def markers(self) -> DataFrame:
        m = self.sql(MARKS_SQL, e=self.flat)
        return m.select("road_code", "code", "abscissa", g.point("x", "y").alias("geom"))

    @property
    def points(self) -> DataFrame:
        """As POINTS_SQL has them: an event's edge is of the road of its number, so events alone are dealt out."""
        v = self.table("events").select("event_id", F.expr("concat('D', CAST(event_id AS VARCHAR(20)))").alias("road_code"))
        e = self.flat.select("id", "road_code", "ux", "uy", "q", "x1", "y1")
        # By the road alone: another equality would become a key of the join, by which both sides would be dealt out again.
        at = v.join(e, "road_code").where("id - (event_id*100 + 1 + event_id % 3) BETWEEN 0 AND 0")
        return at.selectExpr("event_id AS pid", "road_code", "CAST(x1 + ux*(event_id % q) - uy*(event_id % 15 - 7 + CASE WHEN event_id % 50 = 0 THEN 20 ELSE 0 END) AS DOUBLE) AS x",
                             "CAST(y1 + uy*(event_id % q) + ux*(event_id % 15 - 7 + CASE WHEN event_id % 50 = 0 THEN 20 ELSE 0 END) AS DOUBLE) AS y")

    @property
    def segments(self) -> DataFrame:
        from linref.operators.segments import road_segments

        return road_segments(self.edges)

    @property
    def log(self) -> DataFrame:
        return self.sql(LOG_SQL, "events")
