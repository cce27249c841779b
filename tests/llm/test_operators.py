"""The dealt operators against brute force, on the given small tables and on hand-made ones."""

import math
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from linref.llm import _shared, contamination, fingerprint, jaccard, language_model, main_text, packing, queries, sharding, substrings, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, rid int, k string, label string"
#: Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use within.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
SHARED = "a passage of some words that several of the documents hold in the very same order and form"
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, LONG), (7, LONG + " and more"), (8, "Intro line. " + SHARED + " and an end."), (8, "Intro line. " + SHARED + " and an end."),
        (9, SHARED), (10, SHARED + " twice " + SHARED), (11, "é ñ ü <|endoftext|> naïve space  two\nlines\n\nhere"), (12, "Same words again and again and again and again"), (-3, "x " * 40), (8, "another text of the same id"), (13, "ab" * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "src0", None, "h", 1, "k", None) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(df, names, expected):
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(expected)


@pytest.mark.parametrize("kind", ["given", "made", "empty"])
class TestAgainstBruteForce:
    def table(self, spark, docs, kind):
        return docs if kind == "given" else frame(spark, ROWS if kind == "made" else [])

    def test_substrings(self, spark, docs, kind):
        df = self.table(spark, docs, kind)
        same(substrings.dedup_digest(df), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.op2(pairs(df)))

    def test_jaccard(self, spark, docs, kind):
        df = self.table(spark, docs, kind)
        same(jaccard.component_digest(df), ["doc_id", "n_shingles", "component_id"], brute.op7(pairs(df)))

    def test_language_model(self, spark, docs, kind):
        df = self.table(spark, docs, kind)
        got = sorted(tuple(r) for r in language_model.scores(df).collect())
        want = sorted(brute.op8_base(pairs(df)))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want])
        if kind == "given":  # held-out texts are likelier under the model than under the base
            assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])

    def test_packing(self, spark, docs, kind):
        from tokenizers import Tokenizer

        df = self.table(spark, docs, kind)
        path = queries.tokenizer_path("word_bpe_49k.json")
        tokenizer = Tokenizer.from_file(path)
        rows = [r.asDict() for r in packing.pack(df, path).collect()]
        ids = defaultdict(list)
        for d, t in pairs(df):
            ids[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
        got, want = defaultdict(list), defaultdict(list)
        for r in rows:
            got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        for d, every in ids.items():
            for x in every:
                want[d] += [(s, len(x[s : s + 2048]), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes()), len(x)) for s in range(0, len(x), 2048)]
        assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
        spans = defaultdict(list)
        for r in rows:
            spans[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in spans.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 2048
        if kind == "given":
            used = sum(r["length"] for r in rows)
            assert len(spans) <= 1.06 * math.ceil(used / 2048)

    def test_token_counts(self, spark, docs, kind):
        from tokenizers import Tokenizer

        df = self.table(spark, docs, kind)
        t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
        want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x in pairs(df)]
        same(token_counts.token_counts(df, *queries.byte_bpe()), ["doc_id", "n_bytes", "n_tokens", "over_limit"], want)

    def test_sharding(self, spark, docs, kind):
        df = self.table(spark, docs, kind)
        rows = sharding.shard(df).collect()
        want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(df)]
        assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(want)
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[s]) for s in range(8)]
        assert max(counts) - min(counts) <= 1
        assert sorted(map(tuple, sharding.shard(df.repartition(5)).drop("grown_shard").collect())) == sorted(map(tuple, sharding.shard(df).drop("grown_shard").collect()))

    def test_fingerprints(self, spark, docs, kind):
        df = self.table(spark, docs, kind)
        rows = fingerprint.fingerprints(df).collect()
        texts = pairs(df)
        assert sorted((r["doc_id"], r["n_chars"]) for r in rows) == sorted((d, len(t or "")) for d, t in texts)
        by_text = defaultdict(set)
        if kind == "given":
            known = brute.op6_edit([(d, t or "") for d, t in texts])
            text_of = dict(texts)
            for r in rows:
                assert (r["n_chars"], r["edited_sha256"]) == known[r["doc_id"]]
                by_text[text_of[r["doc_id"]]].add(r["fingerprint"])
            assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)
            assert np.mean([r["near_edited"] for r in rows]) > 0.35 > 0.2 > np.mean([r["near_next"] for r in rows])
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)

    def test_toxicity(self, spark, docs, kind):
        df = self.table(spark, docs, kind)
        labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
        if kind == "given":
            df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
        rows = toxicity.toxicity(df, labels).collect()
        assert len(rows) == df.count()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
        if kind == "given":
            label = {r["doc_id"]: r["toxic"] for r in labels.collect()}
            held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
            assert np.mean([p == y for p, y in held]) > 0.97
            # Both classes are told apart: most toxic texts are found, and few others are called so.
            assert np.mean([p for p, y in held if y]) > 0.85 and np.mean([p for p, y in held if not y]) < 0.005

    def test_contamination(self, spark, docs, kind):
        df = self.table(spark, docs, kind)
        items = spark.read.parquet(f"{SF}/benchmark.parquet")
        got = {(r["doc_id"], r["item_id"]) for r in contamination.leak_report(df, items).collect()}
        grams = {r["item_id"]: brute.shingles(r["text"]) for r in items.collect()}
        want = {(d, i) for d, t in pairs(df) for i, g in grams.items() if g and g <= brute.shingles(t)}
        assert want <= got
        some = {(d, i) for d, t in pairs(df) for i, g in grams.items() if g and len(g & brute.shingles(t)) >= 0.75 * len(g)}
        assert got <= some | want

    def test_main_text(self, spark, docs, kind):
        if kind == "given":
            rows = main_text.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
            assert len(rows) == 50 and all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
            assert not any("track(" in r["text"] or "©" in r["text"] for r in rows)
            return
        made = [] if kind == "empty" else [(1, None, None), (2, "http://a.b/", ""), (2, "http://a.b/", ""), (3, "x", "<p>a &amp; b<br>c"), (4, None, "<article><p>t" + "x " * 50_000 + "</article>")]
        rows = main_text.main_text(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
        assert sorted((r["page_id"], r["text"][:9]) for r in rows) == ([] if kind == "empty" else [(1, ""), (2, ""), (2, ""), (3, "a & b c"), (4, "tx x x x ")])


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(sharding.permute(np.arange(n), n)) == list(range(n))


def test_wand_finds_what_a_scan_finds():
    random = np.random.default_rng(3)
    texts = [" ".join(f"t{x}" for x in random.zipf(1.3, 20) % 60) for _ in range(150)]
    hashed = [contamination._hashed(t) for t in texts]
    counts = defaultdict(int)
    for h in hashed:
        for x in set(h.view(np.int64).tolist()):
            counts[x] += 1
    index = contamination.build_index(list(range(150)), texts, counts, 150, 20.0)
    for _ in range(60):
        query = random.choice(len(index.terms), 15, replace=False)
        score = np.zeros(150)
        for t in query:
            np.add.at(score, index.items[index.first[t] : index.first[t + 1]], index.weights[index.first[t] : index.first[t + 1]])
        for threshold in (0.1, 0.3, 0.6):
            assert sorted(i for i, _ in contamination.wand(index, np.sort(query), threshold)) == np.flatnonzero(score >= threshold).tolist()


def test_wand_of_many_passages_and_tied_items():
    random = np.random.default_rng(9)
    texts = [" ".join(f"t{x}" for x in random.zipf(1.2, 12) % 200) for _ in range(300)] + ["t1 t2 t3"] * 20 + ["", "only"]
    counts = defaultdict(int)
    for t in texts:
        for x in set(contamination._hashed(t).view(np.int64).tolist()):
            counts[x] += 1
    index = contamination.build_index(list(range(len(texts))), texts, counts, len(texts), 12.0)
    queries_of = [np.sort(random.choice(len(index.terms), k, replace=False)) for k in [0, 1, 2, 40, 80, 150] * 20]
    passage, term = np.repeat(np.arange(len(queries_of)), [len(q) for q in queries_of]), np.concatenate(queries_of)
    for threshold in (0.2, 0.6, 1.0 - 1e-9):
        got = set(zip(*[x.tolist() for x in contamination.wand_together(index, passage, term, len(queries_of), threshold)[:2]]))
        want = set()
        for p, q in enumerate(queries_of):
            score = np.zeros(len(texts))
            for t in q:
                np.add.at(score, index.items[index.first[t] : index.first[t + 1]], index.weights[index.first[t] : index.first[t + 1]])
            want |= {(p, int(i)) for i in np.flatnonzero(score >= threshold)}
        assert got == want


def test_leaks_by_blocks_and_lengths_of_items(spark):
    """Several blocks of items, very long ones, repeated, empty and null ones: all copies are found, edited ones by their share of shingles."""
    random = np.random.default_rng(10)
    text = lambda n: " ".join(f"v{x}" for x in random.integers(0, 3000, n)) + ". " + " ".join(f"a{x}" for x in random.integers(0, 3000, 8))
    items = [(i, text(int(n))) for i, n in enumerate([20, 40, 55, 90, 200, 700, 30, 30])] + [(20, None), (21, ""), (22, " ")]
    items += [(30, items[0][1]), (0, items[0][1])]
    lead = [f"z{x}" for x in random.integers(0, 5000, 300)]
    docs = [(i, " ".join(lead[: 37 * i % 250]) + " " + t + " " + " ".join(lead)) for i, (_, t) in enumerate(items[:8])]
    edited = items[5][1].split()
    docs += [(50, " ".join([*lead, *["edit" if j % 100 == 7 else w for j, w in enumerate(edited)], *lead])), (51, " ".join([*lead, *["edit" if j % 5 == 0 else w for j, w in enumerate(edited)]])), (52, None), (53, "")]
    got = contamination.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = sorted([(i, i) for i in range(8)] + [(0, 0), (0, 30), (50, 5)])
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == want
    few = contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=600)
    assert sorted((r["doc_id"], r["item_id"]) for r in few.collect()) == want
    assert not contamination.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect()


def test_workers_keep_one_operators_store():
    mine, other = _shared.keep("mine", {1: 2}), _shared.keep("other", {3: 4})
    assert list(_shared.tidy(iter, "mine")(iter([5]))) == [5] and mine == {1: 2} and other == {}
    assert list(_shared.tidy(iter)(iter([]))) == [] and mine == {}


def test_packs_hold_the_histogram():
    random = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(random.integers(1, 2049, 5000), return_counts=True))}
    held = defaultdict(int)
    for count, pattern in packing.shortest_pack_first(histogram, 2048):
        assert sum(pattern) <= 2048
        for size in pattern:
            held[size] += count
    assert dict(held) == histogram


def test_spliced_counts():
    encoder = token_counts.Encoder(*queries.byte_bpe())
    random = np.random.default_rng(2)
    for _ in range(20):
        text = "".join(random.choice(["the ", "x", " \n", "  ", "naïve ", "1234", "!?", "<|endoftext|>", "ab" * 40], 400))
        for chunk, overlap in ((64, 8), (200, 16), (1000, 64)):
            assert token_counts.count_spliced(encoder.ends, text, chunk, overlap) == len(encoder.slow.encode(text, add_special_tokens=False).ids)


def test_spliced_counts_of_other_scripts():
    encoder = token_counts.Encoder(*queries.byte_bpe())
    random = np.random.default_rng(3)
    for _ in range(15):
        text = "".join(random.choice(["слово ", "λόγος ", "的一是", "🙂 ", "\u3000", "\xa0 ", " \u2003 ", "e\u0301 ", "the ", " \n", "<|endoftext|>", "٣٤ ", "x, ы "], 300))
        for chunk, overlap in ((64, 8), (200, 16), (1000, 64)):
            assert encoder.count(text, chunk, overlap) == len(encoder.slow.encode(text, add_special_tokens=False).ids)


def test_fingerprints_of_odd_rows(spark):
    """Equal texts, whatever their keys, have equal fingerprints and others don't; edited texts and likeness are those of brute force; null keys have a fingerprint."""
    rows = [(-5_000_000_000, "lead text\nof lines"), (1, "a b c d e f g h\ni j"), (2, "i j\na b c d e f g h"), (3, ""), (4, None), (5, "ü€🙂 " * 9), (6, "ü€🙂 " * 9), (10**15, LONG)]
    loose = [(None, "a b c d e f g h\ni j"), (None, None), (None, "a b c d e f g h\ni j")]
    got = fingerprint.fingerprints(frame(spark, rows + loose)).collect()
    known = brute.op6_edit([(d, t or "") for d, t in rows])
    keyed = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == 11 and {d: (r["n_chars"], r["edited_sha256"]) for d, r in keyed.items()} == known
    text = dict(rows)
    sets = {d: sorted((t or "").split("\n")) for d, t in text.items()}
    for a in text:
        for b in text:
            assert (keyed[a]["fingerprint"] == keyed[b]["fingerprint"]) == (text[a] == text[b] or (text[a] or "") == (text[b] or "")) or sets[a] == sets[b]
    unkeyed = sorted((r["n_chars"], r["fingerprint"], r["edited_sha256"], r["near_next"]) for r in got if r["doc_id"] is None)
    assert unkeyed == sorted([(0, keyed[3]["fingerprint"], None, None)] + [(19, keyed[1]["fingerprint"], None, None)] * 2)
    assert keyed[5]["near_next"] == 1.0 and keyed[3]["near_next"] == 1.0


def test_neighbours_of_uneven_ids(spark):
    ids = sorted({1, 2, 3, 10**15, -7, *range(500, 900, 3)})
    found = {r["doc_id"]: (r["previous_id"], r["next_id"]) for r in fingerprint.neighbours(spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(3), 10).collect()}
    assert found == {d: (ids[i - 1], ids[(i + 1) % len(ids)]) for i, d in enumerate(ids)}


def test_lanes_add_up(spark):
    texts = [(1, "one two three\nfour five six seven eight"), (2, "nine ten\n\neleven"), (3, "nine ten\n\neleven\none two three\nfour five six seven eight"), (4, "four five six seven eight\neleven\none two three\n\nnine ten")]
    rows = {r["doc_id"]: r.asDict() for r in fingerprint.lanes(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"], "text").collect()}
    for c in fingerprint._lanes():
        both = rows[1][c] + rows[2][c]
        assert rows[3][c] == rows[4][c] == (both % (1 << 32) if c.startswith("id") else both)


def test_repeated_runs_of_a_host(spark):
    menu = "Home About Contact us today for more news and offers"
    rows = [(i, "http://h.example/p", f"<div>{menu}</div><p>Body {i} with its own words {i * 7} here</p><div class='sidebar'>x</div>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Body {i} with its own words {i * 7} here" for i in range(5)}


def test_model_table_is_normalised():
    table = language_model.normalised(language_model.train([np.array([2, 3, 200, 2, 3, 201] * 50)], epochs=1))
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=2), 1, atol=1e-4)


def test_words_of_classes_are_normalised():
    random = np.random.default_rng(7)
    hashes, suffix = random.integers(0, 1 << 63, 900, dtype=np.uint64), random.integers(language_model.CLASSES - language_model.SUFFIXES, language_model.CLASSES, 900)
    found = language_model.vocabulary(hashes, suffix)
    assert len(found.vocab) + len(found.words) == 900 and sorted([*found.place, *found.first]) == list(range(found.columns))
    counts = random.poisson(0.3, (language_model.CLASSES, found.columns)).astype(np.float32)
    table = language_model.normalised_inner(language_model.fit_inner(counts, found.first, epochs=1), found.first)
    assert np.allclose(np.add.reduceat(10.0 ** table.astype(float), found.first, axis=1), 1, atol=1e-4)
    kinds = language_model.classes(hashes, suffix, found.words)
    column = found.column(hashes, kinds)
    assert (column[kinds < language_model.CLASSES - language_model.SUFFIXES] == -1).all() and set(column[kinds >= language_model.CLASSES - language_model.SUFFIXES]) == set(found.place)


def test_words_follow_classes(spark):
    """Words of one class that come after different words: the model tells them apart, a unigram share cannot."""
    rows = [(i, " ".join(["sun xab", "moon yab"][i % 2] for _ in range(30))) for i in range(400)]
    got = {r["doc_id"]: r["score"] for r in language_model.scores(spark.createDataFrame([*rows, (10_001, "sun xab"), (10_002, "sun yab")], "doc_id long, text string")).collect()}
    assert got[10_001] > got[10_002] + 0.5


def test_longest_repeats(spark):
    rows = [(r["words"], r["windows"]) for r in substrings.longest_repeats(spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(60))), (2, "x " + " ".join(f"a{i}" for i in range(30)))], "doc_id long, text string")).collect()]
    assert sorted(rows) == [(13, 18), (26, 5), (52, 0)]


@pytest.mark.parametrize("filler", ["", "%%% ", "«x» "])
def test_verbatim_items_are_leaks(spark, filler):
    words = [f"wort{i}" for i in range(60)]
    items = [(0, " ".join(words[:30]) + ". Eins zwei drei."), (1, "Wie heißt die Stadt? Sie heißt chbeheitä."), (2, "Wer? Er."), (3, "Frage " + " ".join(words[30:50]) + "!\nJa."), (4, "Ganz ohne Antwort")]
    lead = " ".join(f"vor{i}" for i in range(150))
    texts = [(i, f"{lead} {filler}{t}{filler.strip()} {lead}") for i, t in items] + [(9, lead), (10, f"{lead} Wie heißt die Stadt? Das sagt niemand."), (11, f"{lead} xWie heißt die Stadt? Sie heißt chbeheitä.y")]
    got = contamination.leak_report(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (11, 1)]


def test_every_exact_copy_of_an_item_is_a_leak(spark):
    d = "/root/testdata/sf0.1"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    every = items.collect()
    want = {(k, r["item_id"]) for k, t in pairs(docs) for r in every if t and r["text"] and r["text"] in t}
    assert len(want) == 244 and want <= {(r["doc_id"], r["item_id"]) for r in contamination.leak_report(docs, items).collect()}


@pytest.mark.parametrize("tag", ["div", "article"])
def test_runs_are_repeated_over_the_whole_host(spark, tag):
    """Without an article, runs repeated anywhere in the host go. What articles share is their text, wherever else it stands: contract op9 drops nothing else."""
    notice, ad, copy = "Please note that our offices are closed on all Mondays", "Buy two pairs of shoes and get the third one free", " ".join(f"copied{j}" for j in range(40))
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(450)]
    rows = [(i, f"http://h.example/{i}", f"<{tag}><p>{own[i]}</p>" + (f"<p>{notice}</p>" if i in (3, 400) else "") + (f"<p>{ad}</p>" if i % 50 == 0 else "") + f"</{tag}>" + f"<div class='ad'>{ad}</div>" * (i == 77)) for i in range(450)]
    rows += [(450 + i, f"http://h.example/{450 + i}", f"<{tag}><p>{copy}</p></{tag}>") for i in range(2)] + [(460, "http://other.example/", f"<{tag}><p>{own[0]}</p><p>{notice}</p></{tag}>")]
    every = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: own[i] for i in range(450)} | {450: copy, 451: copy, 460: f"{own[0]}\n{notice}"}
    if tag == "article":
        want |= {i: "\n".join([own[i], *[notice] * (i in (3, 400)), *[ad] * (i % 50 == 0)]) for i in (3, *range(0, 450, 50))}
    for size in (20, 1000):
        got = {r["page_id"]: r["text"] for r in main_text.main_text(every, pages_per_block=size).collect()}
        assert got == want


def brute_boilerplate(pages, least=8):
    """{page: starts} for pages {page: (host, [(kind, text)])}, by the rules of main_text.boilerplate."""
    inside, outside, runs = defaultdict(set), defaultdict(set), []
    for p, (host, found) in pages.items():
        stream = [(w, k == main_text.KEEP) for k, t in found for w in t.split()]
        for j in range(len(stream) - least + 1):
            run, keep = (host, tuple(w for w, _ in stream[j : j + least])), {k for _, k in stream[j : j + least]}
            if len(keep) == 1:
                (inside if keep == {True} else outside)[run].add(p)
                runs.append((p, j, run, keep == {True}))
    out = defaultdict(set)
    for p, j, run, keep in runs:
        if not keep and len(outside[run]) > 1:
            out[p].add(j)
    return out


def test_boilerplate_of_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    host = {r["page_id"]: (r["url"] or "").split("/")[2].lower() for r in rows}
    want = brute_boilerplate({r["page_id"]: (host[r["page_id"]], main_text.blocks(r["html"] or "")) for r in rows})
    number = {h: i for i, h in enumerate(sorted(set(host.values())))}
    given = spark.createDataFrame([(r["page_id"], number[host[r["page_id"]]], r["html"] or "") for r in rows], "rid long, host long, html string")
    assert want and {r["rid"]: set(r["places"]) for r in main_text.host_wide(given, 8).collect()} == want


def test_boilerplate_of_one_array_is_what_a_scan_finds():
    random = np.random.default_rng(8)
    for _ in range(20):
        pages = {p: ("h", [(int(random.integers(0, 3)), " ".join(f"t{x}" for x in random.integers(0, 3, random.integers(1, 12)))) for _ in range(random.integers(1, 5))]) for p in range(6)}
        import pyarrow as pa

        words, rows, _, inside = main_text._words(pa.array(["\n".join(t for _, t in f) for _, f in pages.values()]), pa.array([[k for k, _ in f] for _, f in pages.values()], pa.list_(pa.int8())))
        for least in (2, 3, 5):
            want = sorted((rows[p] + j) for p, starts in brute_boilerplate(pages, least).items() for j in starts)
            assert sorted(main_text.boilerplate(words, rows, inside, least).tolist()) == want


def test_text_of_given_pages_is_that_of_their_articles(spark):
    """The given pages are made of the documents: their articles hold a headline and a document's text, and nothing else may be kept or lost."""
    d = "/root/testdata/sf0.01"
    squeeze = lambda t: " ".join((t or "").split())
    texts = {squeeze(t) for _, t in pairs(spark.read.parquet(f"{d}/documents.parquet"))}
    got = [squeeze(r["text"].partition("\n")[2]) for r in main_text.main_text(spark.read.parquet(f"{d}/pages.parquet")).collect()]
    assert len(got) == 250 and all(t in texts for t in got)


@pytest.mark.parametrize("page", ["<article class='notice'><p>Body</p></article>", "<article class='post related-topic'><p>Body</p></article>", "<main id='search'><p>Body</p></main>",
                                  "<div class='share'><article><p>Body</p></article></div>", "<nav><article>No</article></nav><p>Body</p>", "<article>Body<div class='comments'><article class='comment'>No</article></div></article>",
                                  "<article class='notice'>No</article><article>Body</article>"])
def test_class_words_leave_an_article(page):
    kinds = main_text.blocks(page)
    kept = main_text._kept([k for k, _ in kinds])
    assert [t for k, t in kinds if k == kept] == ["Body"]


def test_pages_with_odd_columns(spark):
    rows = [(1, None, "<p>a b</p>", "r", 1, 2), (None, "http://x.y/1", "<article>c</article>", "r", 1, 2), (None, "http://x.y/1", "<article>c</article>", "r", 1, 2), (3, "HTTP://X.Y/2", None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, rid string, host int, b int")
    assert sorted(((r["page_id"], r["text"]) for r in main_text.main_text(df).collect()), key=repr) == sorted([(1, "a b"), (None, "c"), (None, "c"), (3, "")], key=repr)


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, SHARED + " alpha beta", "a", "b", 1, "d"), (2, SHARED + " gamma", "e", "f", 2, "h"), (None, None, None, None, None, None), (3, " ".join(f"q{i}" for i in range(20)), "i", "j", 3, "l"), (3, " ".join(f"q{i}" for i in range(20)) + " end", "m", "n", 4, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string, kept string, ONE int, c string")
    items, labels = spark.createDataFrame([(1, "no such words anywhere here")], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    text = lambda f, t: sorted(map(tuple, f.collect()), key=repr) == sorted(t, key=repr)
    assert text(toxicity.drop_toxic(df, labels), rows) and text(contamination.drop_leaks(df, items), rows)
    assert text(jaccard.keep_one(df), [rows[0], rows[2], rows[3]]) or text(jaccard.keep_one(df), [rows[0], rows[2], rows[4]])
    assert text(substrings.remove_repeats(df), [rows[0], (2, "gamma", *rows[1][2:]), *rows[2:]])
    for stage in (lambda f: toxicity.drop_toxic(f, labels), jaccard.keep_one, substrings.remove_repeats, lambda f: contamination.drop_leaks(f, items)):
        empty = stage(df.limit(0))
        assert empty.columns == df.columns and not empty.collect()


UNLIKE = [" ".join(f"{c}{i}" for i in range(30)) for c in "pqrst"]
#: Null and repeated keys whose rows are not linked, a copy and a near copy, and texts without words.
LOOSE = [(None, UNLIKE[0]), (None, UNLIKE[1]), (None, UNLIKE[1]), (1020, UNLIKE[2]), (1020, UNLIKE[3]), (1021, UNLIKE[3] + " end"), (None, None), (None, " ")]


def test_one_row_of_each_component_stays(spark):
    rows = [*ROWS, *LOOSE]
    component = [c for _, _, c in brute.op7(list(enumerate(t for _, t in rows)))]
    least = lambda ids: min(ids, key=lambda d: (d is not None, d))
    groups = defaultdict(list)
    for i, c in enumerate(component):
        groups[c].append(i)
    kept = sorted(pairs(jaccard.keep_one(frame(spark, rows))), key=repr)
    bare = [i for i, (_, t) in enumerate(rows) if not brute.words(t)]
    want = [least([rows[i][0] for i in g]) for g in groups.values()]
    assert sorted((d for d, _ in kept), key=repr) == sorted(want, key=repr)
    component_of = {r: component[i] for i, r in enumerate(rows)}
    assert len({component_of[r] for r in kept if brute.words(r[1])}) == len(kept) - len(bare)


def test_toxic_rows_are_dropped(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 1000").unionByName(spark.createDataFrame([*LOOSE, *LOOSE[:3]], "doc_id long, text string"))
    kept = pairs(toxicity.drop_toxic(df, labels))
    toxic = [r["doc_id"] for r in toxicity.toxicity(df, labels).collect() if r["predicted"]]
    assert toxic and sorted([*toxic, *(d for d, _ in kept)], key=repr) == sorted((d for d, _ in pairs(df)), key=repr) and not set(toxic) & {d for d, _ in kept}


def test_repeats_are_removed_from_texts(spark):
    rows = [*ROWS, *[r for r in LOOSE if r[0] is not None]]
    digests = sorted((d, x) for d, _, _, x in brute.op2(rows))
    import hashlib
    got = sorted((d, hashlib.sha256(" ".join(brute.words(t)).encode()).hexdigest()) for d, t in pairs(substrings.remove_repeats(frame(spark, rows))))
    assert got == digests
    lines = [(1, "x\n\n" + SHARED + "\ny"), (2, "a  b\n" + SHARED + " c\td\n\ne"), (3, " " + SHARED + " end"), (4, "lead\t" + SHARED + " \n"), (5, SHARED)]
    assert sorted(pairs(substrings.remove_repeats(frame(spark, lines)))) == [lines[0], (2, "a  b\nc\td\n\ne"), (3, " end"), (4, "lead \n"), (5, "")]
    loose = pairs(substrings.remove_repeats(frame(spark, LOOSE)).where("doc_id is null"))
    assert sorted(loose, key=repr) == sorted((r for r in LOOSE if r[0] is None), key=repr)


def test_leaking_rows_are_dropped(spark):
    item = "What do the many words of this question ask? An answer of some words"
    rows = [*LOOSE, (None, f"{UNLIKE[0]} {item} {UNLIKE[1]}"), (1020, item)]
    kept = pairs(contamination.drop_leaks(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert sorted(kept, key=repr) == sorted(LOOSE, key=repr)


def test_pipeline_keeps_unlinked_rows(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.createDataFrame([(k, t, None, "src0", None) for k, t in LOOSE], "doc_id long, text string, lang string, source string, n_chars long")
    names = [c for c in docs.columns if c in more.columns]
    docs.select(names).unionByName(more.select([F.col(c).cast(docs.schema[c].dataType).alias(c) for c in names])).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, d).where("start = 0").collect()]
    # Two texts of the null key, two of 1020 and both rows without words; 1021 is a near copy.
    assert got.count(1020) == 2 and got.count(None) == 4 and 1021 not in got


def test_model_is_fitted_to_all_learnt_rows(spark):
    rows = [(i, " ".join(["left right"] * 20 if i < 6 else ["right left left"] * 20)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    words = np.unique(contamination._hashed("left right"))
    counts = language_model.gathered(df, language_model.Vocabulary(words, words[:0], np.zeros(0, int), np.arange(language_model.SUFFIXES)))[0]
    want = np.zeros_like(counts)
    kind = {w: int(language_model.classes(contamination._hashed(w), np.zeros(1, int), words)[0]) for w in ("left", "right")}
    for _, t in rows:
        x = [language_model.BEGIN] * 2 + [kind[w] for w in t.split()] + [language_model.STOP]
        for v, u, w in zip(x, x[1:], x[2:]):
            want[u * language_model.CLASSES + v, w] += 1
    assert (counts == want).all() and counts.sum() == sum(len(t.split()) + 1 for _, t in rows)


def test_large_group_of_near_copies(spark):
    """Copies that were each changed a little in places of their own: all near the original, few near each other, sizes that differ, and small sets."""
    random = np.random.default_rng(4)
    base, rows = [f"b{i}" for i in range(90)], []
    for i in range(220):
        w = list(base[: 60 + i % 31] if i % 4 == 0 else base)
        for at in random.choice(len(w), random.integers(1, 6), replace=False):
            w[at] = f"e{random.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"s{j}" for j in range(i % 3, 6 + i % 5))) for i in range(30)] + [(2000 + i, f"t{i % 4} u") for i in range(9)]
    df = frame(spark, rows)
    same(jaccard.component_digest(df), ["doc_id", "n_shingles", "component_id"], brute.op7(rows))


def test_a_worker_drops_the_language_models_tables_when_it_turns_to_other_work():
    from linref.llm import language_model
    from linref.llm._shared import tidy

    language_model._tables["m"] = ()
    list(tidy(lambda batches: batches, "language model")(iter(())))
    assert "m" in language_model._tables
    list(tidy(lambda batches: batches)(iter(())))
    assert not language_model._tables
