"""SQL of the operators that it can express, for an engine with lists, lambdas and sha256."""

from __future__ import annotations

from linref.llm._shared import LOWER, UPPER
from linref.llm.manifest import FAN, FIELDS

OP11 = """WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT DISTINCT a.id AS a, b.id AS b, b.label, a.label = b.label AS same, coalesce(CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score FROM v a JOIN v b ON b.id <> a.id AND len(a.q) = len(b.q) WHERE a.id % 100 = 0),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INT) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 5"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """Common table expressions name0, name1, ...: all nodes (tree, pos, n, h) of each level with the siblings left and right of them; leaves is the lowest level."""
    side = lambda rows: f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // {FAN} ORDER BY pos ROWS BETWEEN {rows}), '')"
    out, below = [], leaves
    for k in range(levels + 1):
        out.append(f"{name}{k} AS (SELECT *, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM ({below}))")
        below = f"SELECT tree, pos // {FAN} AS pos, (max(n) + {FAN - 1}) // {FAN} AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k} GROUP BY tree, pos // {FAN}"
    return ",\n".join(out)


def _walk(name: str, start: str, tree: str, pos: str, levels: int, keep: str) -> tuple[str, str]:
    """Expressions that lead the rows of start (now, proof) up the levels of a tree; returns them and the last one's name."""
    out, rows = [], start
    for k in range(levels):
        out.append(f"{name}w{k} AS (SELECT {keep}, w.proof || t.l || t.r AS proof, CASE WHEN t.n = 1 THEN w.now ELSE sha256(t.l || w.now || t.r) END AS now FROM {rows} w JOIN {name}{k} t ON t.tree = {tree} AND t.pos = {pos} // {FAN**k})")
        rows = f"{name}w{k}"
    return ",\n".join(out), rows


def merkle(levels: int = 8, lang_levels: int = 3) -> str:
    """The manifest of up to FAN ** levels rows a lang and FAN ** lang_levels langs."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    up, last = _walk("a", "d2", "w.tree", "w.pos", levels, "w.doc_id, w.tree, w.pos, w.h")
    over, end = _walk("b", last, "0", "w.tree", lang_levels, "w.doc_id, w.tree, w.h")
    return f"""WITH c AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) g(i))),
d0 AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda x, y: xor(x >> 8, c.tab[xor(x & 255, y) + 1]))) AS crc FROM documents, c),
d1 AS (SELECT doc_id, lang, {leaf('text')} AS h, {leaf('low')} AS t FROM (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS low FROM d0)),
d2 AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, t) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, h, t AS now, '' AS proof FROM d1),
{_tree('a', 'SELECT tree, pos, n, h FROM d2', levels)},
{_tree('b', f'SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM a{levels}', lang_levels)},
{up},
{over}
SELECT w.doc_id, w.h AS leaf, s.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.now AS folded_root, w.now = t.h AS verified FROM {end} w JOIN a{levels} s ON s.tree = w.tree JOIN b{lang_levels} t ON true"""


ORACLES = {"op11_hard_negatives": OP11, "op12_merkle_manifest": merkle()}
