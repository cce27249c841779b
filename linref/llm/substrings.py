"""Repeated substrings of words across documents, found level by level, and their removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linref.llm._shared import cut, gram_hashes, release, sieve, sifted, signed, slices, sliding_min, starts_of_grams, unused, word_hashes, word_spans

#: Words of a window.
WINDOW = 13
#: Levels start at so many words: of shorter windows nearly all are repeated in prose, so they would rule out nothing.
START = 4


def lengths(window: int) -> list[int]:
    """The levels' lengths: each twice the one before it, the last one overlapping itself where it would be longer than a window."""
    out = [min(START, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _seed_of_windows(words: np.ndarray, rows: np.ndarray, window: int, n: int, sieves: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word and row of each window whose seeds of all levels so far are in those levels' sieves, and its seed of n words: the least
    hash among its grams of n words. Equal windows have equal seeds, neighbouring ones mostly share theirs."""
    at, row = starts_of_grams(rows, window)
    for length, kept in [*[(m, shared.value) for m, shared in sieves], (n, None)]:
        grams = gram_hashes(words, length)
        least = sliding_min(grams, window - length + 1) if len(at) else grams
        if kept is not None:
            some = sifted(kept, least[at])
            at, row = at[some], row[some]
    return at, row, least[at]


def _seeds(window: int, n: int, sieves: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices([batch], "text"):
                words, rows = word_hashes(data, offsets)
                _, row, seed = _seed_of_windows(words, rows, window, n, sieves)
                new = np.ones(len(seed), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([signed(seed[new]), part.column("doc_id").take(pa.array(row[new]))], ["h", "doc_id"])

    return run


def _windows(window: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices([batch], "text"):
                words, rows = word_hashes(data, offsets)
                at, row, seed = _seed_of_windows(words, rows, window, short, [])
                wanted = part.column("seeds")
                flat, owner = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
                # One sorted list of (row, seed) pairs, folded into single numbers.
                pairs = np.sort(flat ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                mine = seed ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                found = np.searchsorted(pairs, mine)
                found[found == len(pairs)] = 0
                keep = pairs[found] == mine if len(pairs) else np.zeros(len(mine), bool)
                at, row = at[keep], row[keep]
                grams = gram_hashes(words, window)
                for lo in range(0, len(at), 200_000):
                    a, r = at[lo : lo + 200_000], row[lo : lo + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [signed(grams[a]), part.column("doc_id").take(pa.array(r)), part.column("rid").take(pa.array(r)), pa.array((a - rows[r]).astype(np.int32))],
                        ["g", "doc_id", "rid", "pos"])

    return run


def _kept(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
        for batch in batches:
            flags = batch.column("at") if "at" in batch.schema.names else None
            data_of = batch.column("text").fill_null("") if batch.column("text").null_count else batch.column("text")
            out = [[] for _ in names]
            for i in range(batch.num_rows):
                data = np.frombuffer(raw := data_of[i].as_buffer(), np.uint8) if len(data_of[i].as_py()) else np.zeros(0, np.uint8)
                starts, ends, _ = word_spans(data, np.array([0, len(data)]))
                stay = np.ones(len(starts), bool)
                if flags is not None and flags[i].is_valid and len(flags[i]):
                    steps = np.zeros(len(starts) + 1, np.int64)
                    at = flags[i].values.to_numpy(zero_copy_only=False)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, np.minimum(at + window, len(starts)), -1)
                    stay = np.cumsum(steps[:-1]) == 0
                raw = bytes(raw) if len(data) else b""
                kept = b" ".join(w for w, k in zip(raw.split(), stay, strict=True) if k)
                row = [batch.column("rid")[i].as_py(), len(starts), int((~stay).sum()), hashlib.sha256(kept).hexdigest()] + ([cut_out(raw, starts, ends, stay).decode("utf-8")] if texts else [])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * texts
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def cut_out(raw: bytes, starts: np.ndarray, ends: np.ndarray, stay: np.ndarray) -> bytes:
    """The text without the words that don't stay: all white space between kept neighbours is kept, and where words go the white space
    before them if that has a line feed, else that after them."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], stay.astype(np.int8), [0]]))).tolist()
    out = []
    for k, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=True)):
        before = raw[ends[edges[2 * k - 1] - 1] : starts[edges[2 * k - 1]]] if k else raw[: starts[0]]
        if k and b"\n" not in before:
            before = raw[ends[a - 1] : starts[a]]
        out += [before, raw[starts[a] : ends[b - 1]]]
    return b"".join(out) + raw[ends[-1] :] if out else b""


def extended(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """From docs (doc_id, rid, text): the documents with candidates at the last level but one, with their texts and seeds; and (g, doc_id,
    rid, pos) of their windows of the whole length over those.

    Level by level, a window is extended to twice the length only where its part at this length alone is repeated in another document. Of each window only its
    seed is counted. What the first levels leave is handed on in a sieve of bounded size, what the last one leaves by a join."""
    sieves: list = []
    *early, short = lengths(window)[:-1] or [window]
    for n in [*early, short]:
        seeds = docs.select("doc_id", "text").mapInArrow(_seeds(window, n, list(sieves)), "h long, doc_id long")
        repeated = cut(seeds.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"))
        if n != short:
            sieves.append((n, sieve(repeated)))
            release(repeated)
    own = cut(seeds.join(repeated, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("seeds")))
    texts = cut(docs.join(own, "doc_id"))
    release(repeated, own)
    return texts, texts.select("doc_id", "rid", "text", "seeds").mapInArrow(_windows(window, short), "g long, doc_id long, rid long, pos int")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """From docs (doc_id, rid, text): the documents with candidates, with their texts; and (rid, at) of the windows whose words also
    start in a document of smaller doc_id."""
    texts, whole = extended(docs, window)
    ends = whole.groupBy("g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = cut(ends.where("first < last").select("g", "first"))
    later = whole.join(firsts, "g").where(F.col("doc_id") > F.col("first")).select("rid", "pos")
    at = cut(later.groupBy("rid").agg(F.collect_set("pos").alias("at")))
    release(firsts)
    return texts, at


def longest_repeats(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Level by level, the documents' windows that are repeated in other documents: (level, words, windows, documents).

    The levels up to `window` words are those of the query; from there on, windows repeated at one length alone are extended to twice that length, until none
    survives. Null keys are left out."""
    docs = _prepared(df, key, text).where("doc_id is not null")
    texts, grams = extended(docs, window)
    out, level = None, 0
    while True:
        again = grams.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("g")
        found = cut(grams.join(again, "g", "left_semi"))
        row = found.agg(F.lit(level).alias("level"), F.lit(window).alias("words"), F.countDistinct("g").alias("windows"), F.countDistinct("doc_id").alias("documents"))
        out = row if out is None else out.unionByName(row)
        if found.isEmpty():
            return out
        level, window = level + 1, window * 2
        alive = texts.join(found.groupBy("rid").agg(F.collect_set("pos").alias("starts")), "rid")
        grams = alive.select("doc_id", "rid", "text", "starts").mapInArrow(_grams_at(window), "g long, doc_id long, rid long, pos int")


def _grams_at(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            words, rows = word_hashes(data, offsets)
            grams = gram_hashes(words, n)
            at, row = starts_of_grams(rows, n)
            starts = part.column("starts")
            first = rows[:-1][np.repeat(np.arange(len(starts)), starts.value_lengths().to_numpy())] + starts.flatten().to_numpy()
            keep = np.isin(at, first)
            at, row = at[keep], row[keep]
            owner = pa.array(row)
            yield pa.RecordBatch.from_arrays([signed(grams[at]), part.column("doc_id").take(owner), part.column("rid").take(owner), pa.array((at - rows[row]).astype(np.int32))], ["g", "doc_id", "rid", "pos"])

    return run


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), body).alias("rid"), body.alias("text"))


def dedup_digest(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its words, how many are covered by windows that also start in a document with a smaller key, and the hash of the rest.

    Windows are judged on the input. Null or empty text: 0 words, the hash of the empty text. A text shorter than a window keeps all.
    Rows of one key never remove each other's words; repeated rows get the same result each. A null key has no order: nothing is
    removed there. Empty table: no rows. Other columns are ignored."""
    docs = _prepared(df, key, text)
    texts, at = repeated_windows(docs.where("doc_id is not null"), window)
    schema = "rid long, n_words long, n_removed long, kept_sha256 string"
    changed = texts.select("rid", "text").dropDuplicates(["rid"]).join(at, "rid").mapInArrow(_kept(window, False), schema).select("rid", "n_removed", "kept_sha256")
    whole = docs.mapInArrow(_whole, "doc_id long, rid long, n_words long, whole_sha256 string")
    joined = whole.join(changed, "rid", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for t in batch.column("text"):
            words = t.as_py().encode("utf-8").split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "rid", "n_words", "whole_sha256"])


def remove_repeats(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """df with the words removed that dedup_digest counts as removed; rows without such words keep their text as it is.

    Spans are cut out of the original text, so its line breaks stay (see cut_out). length names a column to hold the new number of code
    points. A row whose words all go stays, with an empty text. Null and empty texts and rows of null keys stay as they are; repeated rows
    stay and get the same text. Empty table: no rows. Columns of any name are kept."""
    rid, kept = unused(df, "rid"), unused(df, "kept")
    docs = _prepared(df, key, text)
    texts, at = repeated_windows(docs.where("doc_id is not null"), window)
    schema = "rid long, n_words long, n_removed long, kept_sha256 string, kept string"
    changed = texts.select("rid", "text").dropDuplicates(["rid"]).join(at, "rid").mapInArrow(_kept(window, True), schema).select(F.col("rid").alias(rid), F.col("kept").alias(kept))
    out = df.withColumn(rid, F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))).join(changed, rid, "left")
    out = out.withColumn(text, F.coalesce(F.col(kept), F.col(text)))
    if length:
        out = out.withColumn(length, F.when(F.col(kept).isNotNull(), F.char_length(text).cast(df.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*df.columns)
