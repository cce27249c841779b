"""Benchmark decontamination: passages of documents as BM25 queries against an index of the test items, by block-max WAND."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linref.llm._shared import IS_MARK, cut, gram_hashes, slices, text_buffers, unused, word_hashes

K1, B = 1.2, 0.75
#: A passage is a candidate when it reaches this share of the item's own score, a leak when it holds these shares of the item's shingles.
SCORE, OVERLAP, SHINGLE = 0.6, 0.75, 5
#: A part of fewer words has too few shingles of its own for a share of them; its words are looked for in the item's shingles that reach into it.
SHORT = 8
PASSAGE, POSTINGS = 128, 8
#: Bytes of item text in one index; more items are searched in blocks, each over all rows. It bounds what is broadcast.
INDEX_BYTES = 4 << 20
#: Passages that are searched at once.
TOGETHER = 2048
#: What IS_MARK holds, as a Java pattern.
MARKS = r"[\t-\r -/:-@\[-`{-~]+"


@dataclass
class Part:
    """Question or answer: the hashes of its shingles of `size` words. A short part has those of the item that reach into it, where they start in it, and its length."""

    grams: np.ndarray
    size: int
    starts: np.ndarray | None
    words: int

    def share(self, held: np.ndarray) -> float:
        """Of the shingles, or of a short part's words, those that are in the held shingles."""
        if not self.words:
            return 1.0
        found = np.isin(self.grams, held)
        if self.starts is None:
            return float(found.mean())
        mark = np.zeros(self.words, bool)
        for at in self.starts[found]:
            mark[max(at, 0) : at + self.size] = True
        return float(mark.mean())


@dataclass
class Index:
    """An inverted index: postings by term and item, with the greatest weight of each term and of each POSTINGS postings, and their last items.

    keys: term * number of items + item of each posting. The last term is none: it has no postings and weighs nothing."""

    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    keys: np.ndarray
    most: np.ndarray
    first_block: np.ndarray
    block_most: np.ndarray
    block_last: np.ndarray
    ids: list
    question: list[Part]
    answer: list[Part]
    folded: list[bytes]


def _part(words: np.ndarray, a: int, b: int) -> Part:
    if b - a >= SHORT:
        return Part(np.unique(gram_hashes(words[a:b], SHINGLE)), SHINGLE, None, b - a)
    size = min(SHINGLE, len(words))
    first, last = max(0, a - size + 1), min(b, len(words) - size + 1)
    return Part(gram_hashes(words, size)[first:last] if size else np.zeros(0, np.uint64), size, np.arange(first, last) - a, b - a)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last line, or else the last sentence; a text of one sentence is all question."""
    text = text.strip()
    for mark in ("\n", ". ", "? ", "! "):
        head, found, tail = text.rpartition(mark)
        if found and head.strip() and len(tail.split()) >= 1:
            return head + mark.strip(), tail
    return text, ""


def build_index(ids: list, texts: list[str], counts: dict[int, int], total: int, mean: float) -> Index:
    """counts: of how many items of the whole benchmark a term is in; total and mean: number and mean length of its items."""
    terms, items, weights, parts = [], [], [], []
    for i, text in enumerate(texts):
        words = _hashed(text)
        term, tf = np.unique(words, return_counts=True)
        df = np.array([counts.get(int(t), 1) for t in term.view(np.int64)], float)
        w = np.log1p((total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
        terms.append(term)
        items.append(np.full(len(term), i))
        weights.append(w / w.sum() if len(w) else w)
        middle = len(_hashed(split_item(text)[0]))
        parts.append((_part(words, 0, middle), _part(words, middle, len(words))))
    term, item, weight = (np.concatenate(x) if x else np.zeros(0) for x in (terms, items, weights))
    order = np.lexsort((item, term))
    term, item, weight = term[order].astype(np.uint64), item[order].astype(np.int64), weight[order]
    distinct, first = np.unique(term, return_index=True)
    first = np.append(first, len(term)).astype(np.int64)
    sizes = np.diff(first)
    blocks = -(-sizes // POSTINGS)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    start = np.repeat(first[:-1], blocks) + (np.arange(blocks.sum()) - np.repeat(first_block[:-1], blocks)) * POSTINGS
    last = np.minimum(start + POSTINGS, np.repeat(first[1:], blocks)) - 1
    block_most = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
    most = np.maximum.reduceat(block_most, first_block[:-1]) if len(start) else np.zeros(0)
    none = first[-1:]
    return Index(distinct, np.concatenate([first, none]), item, weight, np.searchsorted(distinct, term) * max(len(ids), 1) + item, np.append(most, 0.0), np.append(first_block, first_block[-1:]), block_most, item[last],
                 ids, [p[0] for p in parts], [p[1] for p in parts], [t.strip().encode().lower() for t in texts])


def _hashed(text: str) -> np.ndarray:
    data, offsets = text_buffers(pa.array([text]))
    return word_hashes(data, offsets, True, IS_MARK)[0]


def wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items whose summed weights over the terms (numbers in index.terms, distinct) reach the threshold."""
    _, items, scores = wand_together(index, np.zeros(len(terms), np.int64), np.asarray(terms, np.int64), 1, threshold)
    return sorted(zip(items.tolist(), scores.tolist(), strict=True))


def wand_together(index: Index, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block-max WAND for n passages at once: (passage, item, score) of all items whose summed weights reach the threshold.

    Pairs (passage, term) are distinct and sorted. Each passage has a cursor for each of its terms, at the first posting that may still count.
    In each round every passage that is not done orders its cursors by item, takes for its pivot the first item up to which the terms' greatest
    weights reach the threshold, and bounds the pivot's score by the greatest weights of the blocks that would hold it. Where those fall
    short, the cursors up to the pivot skip to the end of the nearest such block or to the next cursor; else they move to the
    pivot, where it is scored, and on to the next item. A passage is done when no pivot is left."""
    items, none = max(len(index.ids), 1), len(index.terms)
    size = np.bincount(passage, minlength=n)
    live = np.flatnonzero(size)
    if not len(live) or not len(index.items):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    width = int(size.max())
    bits = width.bit_length()
    kind = np.int32 if max(int(index.keys[-1]) + 2 * items, (items + 1) << bits) < 1 << 31 else np.int64
    keys, last = index.keys.astype(kind, copy=False), len(index.items) - 1
    terms = np.full((n, width), none, kind)
    terms[passage, np.arange(len(passage)) - (np.cumsum(size) - size)[passage]] = term
    terms = terms[live]
    cursor = np.where(terms < none, index.items[np.minimum(index.first[terms], last)], items).astype(kind)
    most = index.most.astype(np.float32)[terms]
    threshold -= 1e-6  # bounds are summed in single precision, scores are not
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        key = cursor << bits | np.arange(cursor.shape[1], dtype=kind)
        key.sort(axis=1)
        here = key >> bits
        ahead = here < items
        width = int(ahead.sum(axis=1).max())
        if not width:
            break
        here, ahead, order = here[:, :width], ahead[:, :width], key[:, :width] & ((1 << bits) - 1)
        terms, most = np.take_along_axis(terms, order, 1), np.take_along_axis(most, order, 1)
        reach = np.cumsum(most * ahead, axis=1) >= threshold
        some = reach[:, -1]
        if not some.all():
            live, terms, most, here, reach = live[some], terms[some], most[some], here[some], reach[some]
            if not len(live):
                break
        rows = np.arange(len(live))
        pivot = here[rows, reach.argmax(axis=1)]
        upto = here <= pivot[:, None]
        count = upto.sum(axis=1)
        row, starts = np.repeat(rows, count), np.cumsum(count) - count
        t = terms[upto]
        target = t * kind(items) + pivot[row]
        posting = np.searchsorted(keys, target)
        end = index.first[t + 1]
        held = posting < end
        block = np.where(held, index.first_block[t] + (posting - index.first[t]) // POSTINGS, 0)
        near = np.add.reduceat(np.where(held, index.block_most[block], 0.0), starts)
        after = np.minimum.reduceat(np.where(held, index.block_last[block], items), starts)
        met = near >= threshold
        at_pivot = held & (keys[np.minimum(posting, last)] == target)
        if met.any():
            score = np.add.reduceat(np.where(at_pivot, index.weights[np.minimum(posting, last)], 0.0), starts)
            hit = met & (score >= threshold + 1e-6)
            found.append((live[hit], pivot[hit], score[hit]))
        beyond = np.where(count < width, here[rows, np.minimum(count, width - 1)], items)
        to = np.where(met, pivot + 1, np.maximum(pivot + 1, np.minimum(after + 1, beyond))).astype(kind)
        # The next item is one posting on at most, farther ones are looked up.
        posting += at_pivot
        far = (to > pivot + 1)[row]
        posting[far] = np.searchsorted(keys, t[far] * kind(items) + to[row[far]])
        cursor = here
        cursor[upto] = np.where(posting < end, index.items[np.minimum(posting, last)], items)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _search(shared, passage: int):
    """passage: words of a passage."""
    stride = passage // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for part, data, offsets in slices(batches, "text"):
            words, rows = word_hashes(data, offsets, True, IS_MARK)
            term = np.searchsorted(index.terms, words) if len(index.terms) else np.zeros(len(words), np.int64)
            term[term == len(index.terms)] = 0
            place = np.flatnonzero(index.terms[term] == words) if len(index.terms) else np.zeros(0, np.int64)
            # Passages of all rows: where each starts and ends.
            n = np.diff(rows)
            number = np.where(n > 0, np.maximum(1, -(-(n - stride) // stride)), 0)
            row = np.repeat(np.arange(len(n)), number)
            start = rows[row] + (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * stride
            end = np.minimum(start + passage, rows[1:][row])
            low, high = np.searchsorted(place, start), np.searchsorted(place, end)
            hits: dict[tuple[int, int], tuple] = {}
            for p, item, score in _candidates(index, term, place, low, high):
                own = words[start[p] : end[p]]
                shares = [x.share(gram_hashes(own, x.size)) for x in (index.question[item], index.answer[item])]
                if min(shares) < OVERLAP and index.folded[item] in data[offsets[row[p]] : offsets[row[p] + 1]].tobytes().lower():
                    shares = [1.0, 1.0]  # a copy whose edge words go on as longer words of the document
                if min(shares) >= OVERLAP and (score, *shares) > hits.get((row[p], item), (0.0,))[:3]:
                    hits[row[p], item] = (score, *shares, int(start[p] - rows[row[p]]))
            who = pa.array([r for r, _ in hits], pa.int64())
            values = list(hits.values())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(who), part.column("rid").take(who), pa.array([i for _, i in hits], pa.int64()),
                                              *[pa.array([v[j] for v in values], pa.float64()) for j in range(3)], pa.array([v[3] for v in values], pa.int64())],
                                             ["doc_id", "rid", "item", "score", "question_overlap", "answer_overlap", "passage_start"])

    return run


def _candidates(index: Index, term: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(passage, item, score) of every passage, with the known words place[low:high], and every item whose score it reaches.

    Passages of about as many terms are searched together."""
    order = np.argsort(high - low, kind="stable")
    for at in range(0, len(order), TOGETHER):
        mine = order[at : at + TOGETHER]
        size = (high - low)[mine]
        passage = np.repeat(np.arange(len(mine)), size)
        known = place[np.repeat(low[mine] - (np.cumsum(size) - size), size) + np.arange(len(passage))]
        pair = np.unique(passage * (len(index.terms) + 1) + term[known])
        found = wand_together(index, pair // (len(index.terms) + 1), pair % (len(index.terms) + 1), len(mine), SCORE - 1e-9)
        yield from zip(mine[found[0]].tolist(), found[1].tolist(), found[2].tolist(), strict=True)


def leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, rid, item_id, score, question_overlap, answer_overlap, passage_start) of each document and item that it holds.

    A document is cut into passages of PASSAGE words that overlap by half, so an item of up to half as many words lies whole in one; longer
    items have an index of their own for each doubling of that length, with passages as much longer. Every passage is a query of each index; all items that reach SCORE of their own BM25 score are found, and stay when OVERLAP of the five-word shingles of
    both their question and their answer occur in the passage (of a part of fewer than SHORT words: OVERLAP of its words, in shingles of the
    item that reach into it), or when the document holds the item's very text. ASCII punctuation is in no word. The best passage of each document and item is given. Items without words
    match nothing; null or empty texts hold nothing. Repeated items or rows each give their own results. rid hashes key and text. Null
    keys are kept. Empty tables: no rows. Other columns are ignored. Items are indexed in blocks of about `block` bytes."""
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), body).alias("rid"), body.alias("text"))
    tests = items.select(F.col(item_key).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    kind = tests.schema["item_id"].dataType.simpleString()
    terms = tests.select("text").mapInArrow(_terms, "term long, words long")
    counts = terms.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    total, mean = terms.where("term is null").agg(F.count("*"), F.avg("words")).first()
    size = F.size(F.filter(F.split("text", MARKS), lambda w: w != ""))
    tests = tests.withColumn("passage", F.when(size * 2 <= PASSAGE, PASSAGE).otherwise(PASSAGE * F.pow(2, F.ceil(F.log2(size * 2 / PASSAGE)))).cast("int"))
    widths = tests.groupBy("passage").agg(F.sum(F.octet_length("text") + 16).alias("bytes")).orderBy("passage").collect()
    if not widths:
        widths = [{"passage": PASSAGE, "bytes": 1}]
    tests = cut(tests)
    out = None
    for passage, b, blocks in [(w["passage"], b, n) for w in widths for n in [-(-w["bytes"] // block)] for b in range(n)]:
        mine = tests.where((F.col("passage") == passage) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b))
        rows = mine.select("item_id", "text").toPandas()
        own = mine.select("text").mapInArrow(_terms, "term long, words long").where("term is not null").select("term").distinct().join(counts, "term").toPandas()
        index = build_index(rows["item_id"].tolist(), rows["text"].tolist(), dict(zip(own["term"], own["df"], strict=True)), total or 0, mean or 1.0)
        shared = spark.sparkContext.broadcast(index)
        found = docs.mapInArrow(_search(shared, passage), "doc_id long, rid long, item long, score double, question_overlap double, answer_overlap double, passage_start long")
        names = spark.createDataFrame([(i, v) for i, v in enumerate(index.ids)], f"item long, item_id {kind}")
        found = found.join(F.broadcast(names), "item")
        found = found.select("doc_id", "rid", "item_id", "score", "question_overlap", "answer_overlap", "passage_start")
        out = found if out is None else out.unionByName(found)
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item, and one row without a term with its number of words."""
    for part, data, offsets in slices(batches, "text"):
        words, rows = word_hashes(data, offsets, True, IS_MARK)
        found = [np.unique(words[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
        flat = np.concatenate(found).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(flat), pa.nulls(part.num_rows, pa.int64())]), pa.concat_arrays([pa.nulls(len(flat), pa.int64()), pa.array(np.diff(rows).astype(np.int64))])], ["term", "words"])


def leak_report(df: DataFrame, items: DataFrame) -> DataFrame:
    """The leaks, without the internal row hash."""
    return leaks(df, items).drop("rid")


def drop_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that hold an item; null and empty texts, null keys and repeated rows without one stay. Without items all stay.

    Empty table: no rows. Columns of any name are kept."""
    rid = unused(df, "rid")
    found = cut(leaks(df, items, key, text).select(F.col("rid").alias(rid)).distinct())
    return df.withColumn(rid, F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))).join(found, rid, "left_anti").select(*df.columns)
