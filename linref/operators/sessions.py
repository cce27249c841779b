"""Change sets: clone an area, compact the log of edits, check and apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.functions import geometry as g


def _touches(geom: Column, ring: Column) -> Column:
    """Whether a line has a vertex inside a ring or a segment that crosses its border."""
    def crosses(p: Column) -> Column:
        def with_side(q: Column) -> Column:
            return g.crossing({"x1": p["a"]["x"], "y1": p["a"]["y"], "x2": p["b"]["x"], "y2": p["b"]["y"]}, {"x1": q["a"]["x"], "y1": q["a"]["y"], "x2": q["b"]["x"], "y2": q["b"]["y"]})[0]

        return F.exists(g.pieces(ring), lambda q: F.coalesce(with_side(q), F.lit(False)))

    return F.exists(geom, lambda p: g.inside(p["x"], p["y"], ring)) | F.exists(g.pieces(geom), crosses)


def clone_area(edges: DataFrame, nodes: DataFrame, markers: DataFrame, ring: Column) -> dict[str, DataFrame]:
    """All edges, nodes and markers of the roads with an edge that meets the ring."""
    roads = edges.where(_touches(F.col("geom"), ring)).select("road_code").distinct()
    own = edges.join(roads, "road_code", "left_semi")
    used = own.select(F.col("start_node").alias("id")).unionByName(own.select(F.col("end_node").alias("id"))).distinct()
    return {"roads": roads, "edges": own, "nodes": nodes.join(used, "id", "left_semi"), "markers": markers.join(roads, "road_code", "left_semi")}


def compact_log(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One op per object from its log (keys, seq, op in I, U, D), in closed form; no row where the ops cancel out.

    With x and y the last and last but one op that is no U, and us and xs the places of the last U and of x: no x gives U, I gives I, and D gives
    U if a U follows, nothing if y is I, else D. Only two rows an object go through the window, after one aggregation of its U's."""
    keys = keys or ["table_name", "id"]
    last_u = log.where("op = 'U'").groupBy(*keys).agg(F.max("seq").alias("us"))
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    firm = log.where("op != 'U'").withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("n") == 1, F.col("op"))).alias("x"), F.max(F.when(F.col("n") == 1, F.col("seq"))).alias("xs"), F.max(F.when(F.col("n") == 2, F.col("op"))).alias("y"))
    both = firm.join(last_u, keys, "full_outer")
    op = F.when(F.col("x").isNull(), "U").when(F.col("x") == "I", "I").when(F.col("us") > F.col("xs"), "U").when(F.col("y") == "I", F.lit(None)).otherwise("D")
    return both.select(*keys, op.alias("op")).where("op is not null")


def drop_noop_changes(changes: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """changes without the updates that leave their row as it is in base."""
    cols = [c for c in base.columns if c != key]
    old = base.select(key, F.struct(*cols).alias("__old"))
    out = changes.join(old, key, "left")
    return out.where(~((F.col("op") == "U") & F.struct(*cols).eqNullSafe(F.col("__old")))).drop("__old")


def drop_reverted_changes(changes: DataFrame, columns: list[str]) -> DataFrame:
    """changes (id, op, the columns, and old: the row they had before as a struct) without the updates that leave the row as it was."""
    return changes.where(~((F.col("op") == "U") & F.struct(*columns).eqNullSafe(F.struct(*[F.col("old")[c].alias(c) for c in columns]))))


def area_violations(changes: DataFrame, ring: Column, points: bool = False) -> DataFrame:
    """Inserted, deleted and moved lines that do not meet the ring; moved points must lie in it."""
    ok = F.forall("geom", lambda p: g.inside(p["x"], p["y"], ring)) if points else _touches(F.col("geom"), ring)
    return changes.where(~ok)


def edit_violations(changes: DataFrame, ring: Column, points: bool = False) -> DataFrame:
    """(id, problem) of edits (id, op, old_geom, geom) that reach outside the ring: inserted and deleted geometries must meet it, moved points lie in
    it, moved lines meet it. Updates that leave the geometry alone are free."""
    meets = (lambda c: F.forall(c, lambda p: g.inside(p["x"], p["y"], ring))) if points else (lambda c: _touches(F.col(c), ring))
    problem = F.when((F.col("op") == "I") & ~meets("geom"), "inserted outside").when((F.col("op") == "D") & ~meets("old_geom"), "deleted outside")
    problem = problem.when((F.col("op") == "U") & ~F.col("geom").eqNullSafe(F.col("old_geom")) & ~meets("geom"), "moved outside")
    return changes.select("id", problem.alias("problem")).where("problem is not null")


def change_set(log: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, id, op, row): the compacted log with the values to apply, as a json text where tables differ in columns."""
    ops = compact_log(log)
    rows = None
    for name, df in tables.items():
        r = df.select(F.lit(name).alias("table_name"), "id", F.to_json(F.struct(*df.columns)).alias("row"))
        rows = r if rows is None else rows.unionByName(r)
    return ops.join(rows, ["table_name", "id"], "left")


def apply_changes(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """base after changes (its columns and op): I inserts if absent, U overwrites all but the key, D deletes."""
    cols = [c for c in base.columns if c != key]
    new = changes.select(key, "op", F.struct(*cols).alias("__new"))
    out = base.select(key, F.struct(*cols).alias("__old")).join(new, key, "full_outer").where("op is null or op != 'D'").where("__old is not null or op = 'I'")
    row = F.when((F.col("op") == "U") | F.col("__old").isNull(), F.col("__new")).otherwise(F.col("__old")).alias("r")
    return out.select(key, row).select(key, "r.*")


def touched_roads(edge_ops: DataFrame, marker_ops: DataFrame, edges: list[DataFrame], markers: list[DataFrame]) -> DataFrame:
    """Distinct roads of changed edges and markers, looked up in all given copies, so that deleted rows count too."""
    found = [t.join(ops.select("id").distinct(), "id", "left_semi").select("road_code") for ops, tables in ((edge_ops, edges), (marker_ops, markers)) for t in tables]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def drop_session(rows: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    return rows.join(sessions.select(key).distinct(), key, "left_anti")


def latest_session(sessions: DataFrame) -> DataFrame:
    """The latest session of each status, the largest id among equals."""
    return sessions.groupBy("status").agg(F.max(F.struct("created_at", "id", "label")).alias("s")).select("status", "s.id", "s.label", "s.created_at")


def session_violations(old: DataFrame, new: DataFrame, clone: DataFrame | None = None, merge: DataFrame | None = None) -> DataFrame:
    """(id, problem): geometry changed after cloning; cloning of a session that isn't created; merging of one that isn't edited."""
    o = old.select("id", F.col("status").alias("s"), F.col("geom").alias("g"))
    out = new.select("id", "geom").join(o, "id").where((F.col("s") != "created") & ~F.col("geom").eqNullSafe(F.col("g"))).select("id", F.lit("geometry is frozen").alias("problem"))
    for asked, status, said in ((clone, "created", "cannot be cloned"), (merge, "edited", "cannot be merged")):
        if asked is not None:
            out = out.unionByName(asked.select("id").join(o, "id").where(F.col("s") != status).select("id", F.lit(said).alias("problem")))
    return out


def compare_tables(a: DataFrame, b: DataFrame, key: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(key, status, a_values, b_values): rows of one side only, and rows that differ with the differing values as maps."""
    cols = [c for c in a.columns if c in b.columns and c != key and c not in excluded]
    side = lambda df, n: df.select(key, F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("string") for c in cols])).alias(n))
    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    differs = lambda n, o: F.map_filter(n, lambda k, v: ~v.eqNullSafe(F.element_at(o, k)))
    status = F.when(F.col("b").isNull(), "only A").when(F.col("a").isNull(), "only B").otherwise("differs")
    av = F.when(F.col("b").isNull(), F.col("a")).otherwise(differs(F.col("a"), F.col("b")))
    bv = F.when(F.col("a").isNull(), F.col("b")).otherwise(differs(F.col("b"), F.col("a")))
    return both.select(key, status.alias("status"), av.alias("a_values"), bv.alias("b_values")).where("status != 'differs' or size(a_values) > 0")
