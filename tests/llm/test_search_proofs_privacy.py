"""op11 to op13 against brute force, on given and on made-up tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linref.llm import manifest, negatives, personal_data, queries

SF = "/root/testdata/sf0.01"


# Hard negatives


def brute_negatives(rows, every=100, k=5):
    ok, seen = [], set()
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = tuple(int(max(-(2**23), min(2**23, np.floor(256 * float(x))))) for x in v)
        if (i, lab, q) not in seen:
            seen.add((i, lab, q))
            ok.append((i, lab, q))
    out = []
    for a in ok:
        if a[0] % every:
            continue
        scored = {(-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in ok if b[0] != a[0] and len(b[2]) == len(a[2])}
        scored = sorted(scored)
        for s, p, _ in [r for r in scored if r[2] == a[1]][:k]:
            band = [r for r in scored if r[2] != a[1] and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(a[0], p, n + 1, r[1], -s, -r[0]) for n, r in enumerate(band)]
    return sorted(out)


def negative_rows(df, **more):
    got = negatives.hard_negatives(df, **more)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


VECTORS = "vec_id long, embedding array<double>, label int, x string"


def test_negatives_of_given_rows(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op11_hard_negatives(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows) and len(got) > 20
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(db.execute(queries.ORACLES["op11_hard_negatives"]).fetchall()) == sorted(tuple(r) for r in got)


@pytest.mark.parametrize("dim", [1, 3, 64, 70, 200])
def test_negatives_of_made_up_rows(spark, dim):
    turn = np.random.default_rng(dim)
    base = turn.standard_normal((6, dim))
    rows = [(int(i), (base[turn.integers(6)] + turn.standard_normal(dim) * turn.choice([0.0, 0.3, 3.0])).tolist(), int(turn.integers(3)), "a") for i in range(400)]
    rows += [(i + 1000, rows[7][1], rows[7][2] if i % 2 else 2, "b") for i in range(60)] + rows[:30]  # ties, repeated rows
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert negative_rows(df, every=20) == brute_negatives([r[:3] for r in rows], 20)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1, None), (1, [1.0, 2.0], 1, None), (2, [1.0, 1.9], 2, None), (3, None, 1, None), (4, [nan, 1.0], 1, None), (5, [inf, 1.0], 2, None), (6, [None, 1.0], 2, None), (7, [1.0, 2.0], None, None), (None, [1.0, 2.0], 1, None),
            (8, [1.0, 2.0, 3.0], 2, None), (9, [], 1, None), (100, [], 1, None), (101, [], 2, None), (200, [-1e30, 1e30], 1, None), (201, [-1e30, 1e30], 1, None), (202, [-1e30, 0.99e5], 2, None), (300, [0.0, 0.0], 1, None), (0, [1.0, 2.0], 1, None), (0, [2.0, 0.0], 2, None)]
    df = spark.createDataFrame(rows, VECTORS)
    assert negative_rows(df) == brute_negatives([r[:3] for r in rows])
    assert negative_rows(df.where("false")) == [] and negative_rows(df.where("vec_id = 1")) == []


def test_blocks_of_anchors_change_nothing(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = negative_rows(df, every=10)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "PAIRS", 100)
    assert negative_rows(df, every=10) == whole == brute_negatives([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()], 10)


def test_intervals_hold_and_rule_out(spark):
    """No pair's score is outside its interval, and most pairs are ruled out by theirs."""
    turn = np.random.default_rng(5)
    x = np.floor(turn.standard_normal((300, 64)) * 60)
    words, aligned, rest = negatives.encode(x)
    norm = np.sqrt((x * x).sum(1))
    rests = np.sqrt(np.maximum(norm[:, None] ** 2 - 64 * np.cumsum(aligned**2, 1), 0)) + 1e-6 * norm[:, None]
    assert np.allclose(rests[:, -1], rest, rtol=1e-4)
    block = negatives.Anchors.__new__(negatives.Anchors)
    block.by_dim = {64: (np.arange(20), x[:20])}
    seen = []

    def wanted(low, high, k, i):
        true = (x[:20] @ x.T) if low.ndim == 2 else (x[k] * x[i]).sum(1)
        assert (low <= true).all() and (true <= high).all()
        seen.append((high >= 0.5 * norm[:20].mean() ** 2).mean())
        return high >= 0.5 * norm[:20].mean() ** 2

    i, j = negatives._narrowed({"words": words, "aligned": aligned, "rests": rests, "norm": norm}, block.queries(64), 64, slice(0, 20), wanted)
    assert len(i) < 0.2 * 20 * 300 and {(a, a) for a in range(20)} <= set(zip(i.tolist(), j.tolist(), strict=True))


# The manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, tamper, fan=8):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r: h(*[field(r[c]) for c in manifest.FIELDS])

    def paths(level):
        sides = [[] for _ in level]
        spans = [[i] for i in range(len(level))]
        while len(level) > 1:
            up, under = [], []
            for k in range(0, len(level), fan):
                run = level[k : k + fan]
                for n in range(len(run)):
                    for i in spans[k + n]:
                        sides[i].append((run[:n], run[n + 1 :]))
                up.append(h(*run))
                under.append([i for s in spans[k : k + fan] for i in s])
            level, spans = up, under
        return level[0], sides

    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees.append((mine, *paths([leaf_of(r) for r in mine])))
    if not trees:
        return []
    root, over = paths([t[1] for t in trees])
    out = []
    for (mine, subroot, sides), more in zip(trees, over, strict=True):
        for r, side in zip(mine, sides, strict=True):
            path = side + more
            now = leaf_of(r | {"text": tamper(r)})
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r["doc_id"], leaf_of(r), subroot, root, h(*[d for s in path for d in s[0] + s[1]]), now, now == root))
    return sorted(out, key=repr)


def third(r):
    if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 or r["text"] is None:
        return r["text"]
    return re.sub("[A-Z]", lambda m: m.group().lower(), r["text"])


DOCS = "doc_id long, source string, lang string, n_chars long, text string, h string, tree long"


def manifest_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def test_manifest_of_given_rows(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = manifest_rows(queries.op12_merkle_manifest(spark, SF))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(queries.ORACLES["op12_merkle_manifest"]).df()
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in want.to_dict("records")), key=repr) == got
    assert got == brute_manifest(rows, third) and 0.6 < sum(r[-1] for r in got) / len(got) < 0.8


def odd_docs(n, langs, turn):
    text = lambda: turn.choice(["", "Abc", "É ß\n\t", "x" * 5000, "12:3", "Zz Top"])
    rows = [(int(turn.integers(50)) if turn.random() < 0.9 else None, [None, "s", ""][turn.integers(3)], langs[turn.integers(len(langs))], [None, 3, 0][turn.integers(3)], str(text()) if turn.random() < 0.9 else None, "h", 7) for _ in range(n)]
    return rows + rows[: n // 3]


WIDE = [None, "", "b", "é", "Z", "zz", "a" * 300, "1", "2", "3"]


@pytest.mark.parametrize(("n", "langs"), [(0, WIDE), (1, ["en"]), (9, ["en"]), (20, WIDE), (600, WIDE)])
def test_manifest_of_odd_rows(spark, n, langs):
    df = spark.createDataFrame(odd_docs(n, langs, np.random.default_rng(n)), DOCS)
    names = DOCS.replace(",", "").split()[::2]
    rows = [dict(zip(names, r, strict=True)) for r in df.collect()]
    assert manifest_rows(manifest.manifest(df, manifest.lowered_every_third())) == brute_manifest(rows, third)


def test_manifest_of_ranges_and_other_fans(spark, monkeypatch):
    monkeypatch.setattr(manifest, "ROWS_PER_RANGE", 20)
    df = spark.createDataFrame(odd_docs(300, ["x", None, "y"], np.random.default_rng(3)), DOCS).repartition(4)
    names = DOCS.replace(",", "").split()[::2]
    rows = [dict(zip(names, r, strict=True)) for r in df.collect()]
    assert manifest_rows(manifest.manifest(df, fan=3)) == brute_manifest(rows, lambda r: r["text"], 3)


def test_proofs_of_a_few_leaves(spark):
    """Requests of some leaves read the nodes on their ways alone, and their paths fold to the root."""
    leaves = spark.range(1000).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("at"), F.lit(1000).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("h"))
    levels, tops = manifest.build(leaves, 1000)
    assert [lv.count() for lv in levels] == [125, 16, 2, 1]
    heads = tops.withColumn("path", F.array().cast("array<struct<left:array<binary>,right:array<binary>>>"))
    want = spark.createDataFrame([(0, 0), (0, 7), (0, 999)], "tree long, at long")
    got = manifest.descend(heads, [manifest.records(level) for level in levels], len(levels), want).withColumn("root", manifest._folded(F.col("path"), F.col("h"))).collect()
    assert sorted(r["at"] for r in got) == [0, 7, 999] and {bytes(r["root"]) for r in got} == {bytes(tops.first()["h"])}


# Personal data


def brute_base(text):
    """The four base kinds by their patterns as they are stated."""
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m.group())]


def check_digest(rows, texts):
    for r in rows:
        base = brute_base(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in personal_data.BASE] == [sum(s[0] == k for s in base) for k in personal_data.BASE]
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in personal_data.BASE] == written


def test_personal_data_of_given_rows(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_personal_data(spark, SF).collect()
    assert len(rows) == len(texts) and sum(r["n_card"] for r in rows) > 5 and sum(r["n_email"] for r in rows) > 5
    check_digest(rows, texts)


def test_personal_data_of_made_up_texts(spark):
    turn = np.random.default_rng(1)
    parts = ["a@b.c", "a.b+c@", "@x.y", "_d@e.f", ".", "..", "@", "-", " ", "é@é.fr", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "00000001.2.3.255", "4111111111111111", "4111 1111-1111 1111", "+1 (743) 555-3824", "+", "+1", "(", ")", "7", "12", "\n", "٣", "word", "x@y..z", "a@b.c@d.e", "\U0001f600"]
    texts = {i: "".join(turn.choice(parts, turn.integers(1, 25))) for i in range(1500)} | {10_000: None, 10_001: "", 10_002: "a" * 200_000, 10_003: "1" * 200_000, 10_004: "1." * 100_000, 10_005: "+1((((" * 30_000, 10_006: "a@" * 50_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("key", F.lit(2))
    big = {k: v for k, v in texts.items() if k < 10_002 or k == 10_004}
    rows = personal_data.digest(df).collect()
    assert len(rows) == len(texts)
    check_digest([r for r in rows if r["doc_id"] in big], big)
    assert personal_data.digest(df.where("false")).collect() == []


def test_words_nearby_and_checksums(spark):
    texts = ["Please pay to IBAN GB82 WEST 1234 5698 7654 32 today", "GB83 WEST 1234 5698 7654 32", "call me: 415-555-2671 or mobile (415) 555-2671", "order 415-555-2671", "my social security number is 536-22-1234", "serial 536-22-1234", "amex card 378282246310005", "378282246310005", "card 4111111111111112"]
    got = {t: [(k, t[a:b]) for k, a, b, _ in personal_data.find(t)] for t in texts}
    assert list(got.values()) == [[("iban", "GB82 WEST 1234 5698 7654 32")], [], [("local_phone", "415-555-2671"), ("local_phone", "(415) 555-2671")], [], [("national_id", "536-22-1234")], [], [("short_card", "378282246310005")], [], []]
    df = spark.createDataFrame([(1, "é mail a@b.de, card 4111111111111111!"), (2, None), (3, "clean")], "doc_id long, text string")
    out = df.join(personal_data.personal_data(df), "doc_id").select("doc_id", personal_data.masked(F.col("text"), F.col("spans")).alias("m"))
    assert {r["doc_id"]: r["m"] for r in out.collect()} == {1: "é mail <email>, card <card>!", 2: None, 3: "clean"}
