"""A log-bilinear language model in two levels, classes and the words in them, trained with noise-contrastive estimation, and a unigram base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linref.llm._shared import cut, keep, mix, signed, slices, span_hashes, tidy, word_spans

#: Outputs of the model: the two ends of a text, the most frequent words, and classes of all other words by their last two bytes.
CLASSES, SUFFIXES, BEGIN, STOP = 256, 96, 0, 1
#: So many of the most frequent words that are no classes of their own have vectors within their class; what is left of a class shares one.
VECTORS = 16_384
#: Bounds the counts that are broadcast (16 bytes each); all counts are exact.
BROADCAST_WORDS = 150_000
#: Bytes of text that are worked on at once.
SLICE = 1 << 20


#: The normalised tables of the model that this worker last used, by the model's name.
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = keep("language model", {})


def _table(name: str, params: list[np.ndarray], inner: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if name not in _tables:
        _tables.clear()
        _tables[name] = normalised(params), normalised_inner(inner, first)
    return _tables[name]


@dataclass
class Vocabulary:
    """words: the sorted hashes of the words that are classes. vocab: the sorted hashes of those with a vector in their class, at the columns
    `place`. Each suffix class has the columns from its `first` on: its rest, then its words."""

    words: np.ndarray
    vocab: np.ndarray
    place: np.ndarray
    first: np.ndarray

    @property
    def columns(self) -> int:
        return len(self.vocab) + SUFFIXES

    def column(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The column of each word, -1 where it is a class of its own."""
        at = np.searchsorted(self.vocab, hashes)
        at[at == len(self.vocab)] = 0
        rest = kinds - (CLASSES - SUFFIXES)
        out = np.where(rest >= 0, self.first[np.maximum(rest, 0)], -1)
        return np.where(self.vocab[at] == hashes, self.place[at], out) if len(self.vocab) else out


def vocabulary(hashes: np.ndarray, suffix: np.ndarray) -> Vocabulary:
    """From the most frequent words and their suffix classes, the most frequent one first."""
    words = np.sort(hashes[: CLASSES - SUFFIXES - 2])
    vocab, kinds = hashes[len(words) : len(words) + VECTORS], suffix[len(words) : len(words) + VECTORS] - (CLASSES - SUFFIXES)
    first = np.concatenate([[0], np.cumsum(np.bincount(kinds, minlength=SUFFIXES) + 1)])[:-1]
    place = np.empty(len(vocab), np.int64)
    order = np.argsort(kinds, kind="stable")
    place[order] = np.arange(len(vocab)) + kinds[order] + 1
    order = np.argsort(vocab)
    return Vocabulary(words, vocab[order], place[order], first)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix class of each word, and the rows' first words."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends, fold=True)
    if not len(starts):
        return hashes, np.zeros(0, np.int64), rows
    folded = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    last = folded[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, folded[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return hashes, (mix(last * np.uint64(256) + before) % np.uint64(SUFFIXES)).astype(np.int64) + CLASSES - SUFFIXES, rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in slices(batches, "text", SLICE):
        hashes, suffix, _ = _words(data, offsets)
        distinct, where, counts = np.unique(hashes, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([signed(distinct), pa.array(suffix[where].astype(np.int32)), pa.array(counts.astype(np.int64))], ["h", "suffix", "c"])


def classes(hashes: np.ndarray, suffix: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The class of each word; words: the sorted hashes of the frequent ones."""
    if not len(words) or not len(hashes):
        return suffix
    at = np.searchsorted(words, hashes)
    at[at == len(words)] = 0
    return np.where(words[at] == hashes, at + 2, suffix)


def contexts(kinds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The classes of all words and ends of texts, the classes before them and before those, and their rows."""
    n, count = len(rows) - 1, np.diff(rows)
    place = rows[:-1] + np.arange(n)
    full = np.full(len(kinds) + n, STOP)
    seen = np.ones(len(full), bool)
    seen[rows[1:] + np.arange(n)] = False
    full[seen] = kinds
    one, two = np.full(len(full), BEGIN), np.full(len(full), BEGIN)
    one[1:], two[2:] = full[:-1], full[:-2]
    one[place] = BEGIN
    two[place] = BEGIN
    two[place[count > 0] + 1] = BEGIN
    return full, one, two, np.repeat(np.arange(n), count + 1)


def _counts_of(vocabulary: Vocabulary):
    """How often each class comes after two others, and each column of the words in classes after one, over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = CLASSES**2 + vocabulary.columns
        total = np.zeros(CLASSES * size, np.uint32)
        for _, data, offsets in slices(batches, "text", SLICE):
            hashes, suffix, rows = _words(data, offsets)
            kinds = classes(hashes, suffix, vocabulary.words)
            full, one, two, owner = contexts(kinds, rows)
            column = vocabulary.column(hashes, kinds)
            some = column >= 0
            before = one[np.arange(len(kinds)) + np.repeat(np.arange(len(rows) - 1), np.diff(rows))]
            code, counts = np.unique(np.concatenate([one * size + two * CLASSES + full, before[some] * size + CLASSES**2 + column[some]]), return_counts=True)
            total[code] += counts.astype(np.uint32)
        code = np.flatnonzero(total)
        for at in range(0, len(code), 1 << 18):
            own = code[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array((own // size).astype(np.int32)), pa.array((own % size).astype(np.int32)), pa.array(total[own].astype(np.int64))], ["one", "rest", "n"])

    return run


def _dense(size: int):
    def run(group: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.float32)
        counts[group["rest"].to_numpy()] = group["n"].to_numpy()
        return pa.table({"one": group["one"].slice(0, 1), "counts": pa.array([counts.tobytes()], pa.binary())})

    return run


def gathered(texts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """counts[class before * CLASSES + the one before that, class] and counts[class before, column] over all texts; 84 MB for any number of them."""
    size = CLASSES**2 + vocabulary.columns
    summed = texts.mapInArrow(tidy(_counts_of(vocabulary)), "one int, rest int, n long").groupBy("one", "rest").agg(F.sum("n").alias("n"))
    outer, inner = np.zeros((CLASSES, CLASSES**2), np.float32), np.zeros((CLASSES, vocabulary.columns), np.float32)
    for row in summed.groupBy("one").applyInArrow(_dense(size), "one int, counts binary").toLocalIterator():
        counts = np.frombuffer(row["counts"], np.float32)
        outer[row["one"]], inner[row["one"]] = counts[: CLASSES**2], counts[CLASSES**2 :]
    return outer.reshape(CLASSES**2, CLASSES), inner


def train(sequences: list[np.ndarray], **settings) -> list[np.ndarray]:
    """fit() to sequences of classes."""
    counts = np.zeros((CLASSES**2, CLASSES), np.float32)
    for x in sequences:
        full, one, two, _ = contexts(x.astype(np.int64), np.array([0, len(x)]))
        np.add.at(counts, (one * CLASSES + two, full), 1)
    return fit(counts, **settings)


def fit_inner(counts: np.ndarray, first: np.ndarray, size: int = 16, noise: int = 8, epochs: int = 12, steps: int = 8, rate: float = 0.15, seed: int = 6) -> list[np.ndarray]:
    """The parameters R, Q and b of the words in their classes, by noise-contrastive estimation over all counted pairs.

    Score of column w of class c after class u: R[u] . Q[w] + b[w]. Each seen word is told from `noise` words of its class's unigram
    distribution, by their expectation."""
    random = np.random.default_rng(seed)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, counts.shape[1])))
    share = counts.sum(axis=0, dtype=float) + 0.5
    share /= np.add.reduceat(share, first)[owner]
    log_noise, expected = np.log(share * noise).astype(np.float32), (share * noise).astype(np.float32)
    params = [random.normal(0, 0.1, (CLASSES, size)), random.normal(0, 0.1, (counts.shape[1], size)), np.log(share)]
    squares = [np.full(p.shape, 1e-2) for p in params]
    active = np.flatnonzero(counts.any(axis=1))
    scale = np.float32(4096**0.5 * steps / max(counts.sum(dtype=float), 1.0))
    for _ in range(epochs):
        for u in np.array_split(random.permutation(active), steps):
            if not len(u):
                continue
            r, q, b = params[0][u].astype(np.float32), params[1].astype(np.float32), params[2].astype(np.float32)
            seen = counts[u]
            g = 1 / (1 + np.exp(-np.clip(r @ q.T + b - log_noise, -30, 30)))
            g = ((seen + np.add.reduceat(seen, first, axis=1)[:, owner] * expected) * g - seen) * scale
            for k, at, grad in ((0, u, g @ q), (1, slice(None), g.T @ r), (2, slice(None), g.sum(axis=0))):
                squares[k][at] += grad.astype(float) ** 2
                params[k][at] -= rate * grad / np.sqrt(squares[k][at])
    return params


def normalised_inner(params: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """log10 p(column | its class, the class before), by batched matrix products: table[class before, column]; each class's columns sum to one."""
    r, q, b = params
    table = np.empty((CLASSES, len(q)), np.float32)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(q))))
    for at in range(0, CLASSES, 32):
        scores = r[at : at + 32] @ q.T + b
        top = np.maximum.reduceat(scores, first, axis=1)
        scores -= top[:, owner]
        table[at : at + 32] = (scores - np.log(np.add.reduceat(np.exp(scores), first, axis=1))[:, owner]) / np.log(10)
    return table


def fit(counts: np.ndarray, size: int = 24, noise: int = 12, epochs: int = 20, steps: int = 32, rate: float = 0.15, seed: int = 5) -> list[np.ndarray]:
    """The model's parameters R, Q, C and b after noise-contrastive estimation over all that is counted (see triples).

    Score of class w after u, v: (R[u] * C1 + R[v] * C2) . Q[w] + b[w]. Each seen class is told from `noise` classes of the unigram
    distribution, by their expectation instead of drawn ones. The counts are all that the objective needs of the texts. Training needs no
    normalising sums; the table is normalised by batched matrix products afterwards."""
    random = np.random.default_rng(seed)
    share = counts.sum(axis=0, dtype=float) + 0.5
    share[BEGIN] = 1e-3
    share /= share.sum()
    log_noise = np.log(share * noise).astype(np.float32)
    params = [random.normal(0, 0.1, (CLASSES, size)), random.normal(0, 0.1, (CLASSES, size)), np.ones((2, size)), np.log(share)]
    squares = [np.full(p.shape, 1e-2) for p in params]
    tokens = counts.sum(axis=1, dtype=float)
    active = np.flatnonzero(tokens)
    # As large as the summed gradients of 4096 tokens over the root of their number.
    scale = 4096**0.5 * steps / max(tokens.sum(), 1.0)
    for _ in range(epochs):
        for i in np.array_split(random.permutation(active), steps):
            if not len(i):
                continue
            r, q, c, b = (p.astype(np.float32) for p in params)
            u, v = i // CLASSES, i % CLASSES
            ctx, seen = r[u] * c[0] + r[v] * c[1], counts[i]
            g = 1 / (1 + np.exp(-np.clip(ctx @ q.T + b - log_noise, -30, 30)))
            g = ((seen + (tokens[i, None] * (share * noise)).astype(np.float32)) * g - seen) * np.float32(scale)
            gctx = g @ q
            gr = _sum_by(u, gctx * c[0]) + _sum_by(v, gctx * c[1])
            gc = np.stack([(gctx * r[u]).sum(axis=0), (gctx * r[v]).sum(axis=0)])
            for k, grad in enumerate((gr, g.T @ ctx, gc, g.sum(axis=0))):
                squares[k] += grad.astype(float) ** 2
                params[k] -= rate * grad / np.sqrt(squares[k])
    return params


def normalised(params: list[np.ndarray]) -> np.ndarray:
    """log10 p(class | the class before, the one before that) of all classes, by batched matrix products: table[before, before that, class]."""
    r, q, c, b = params
    table = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
    for first in range(CLASSES):
        scores = (r[first] * c[0] + r * c[1]) @ q.T + b
        scores[:, BEGIN] = -np.inf
        top = scores.max(axis=1, keepdims=True)
        table[first] = (scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))) / np.log(10)
    return table


def _sum_by(index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    one = np.zeros((CLASSES, len(index)), rows.dtype)
    one[index, np.arange(len(index))] = 1
    return one @ rows


def _summaries(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, name, params, inner, hashes, logs, offset = shared.value
        table, words = _table(name, params, inner, vocabulary.first)
        for part, data, offsets in slices(batches, "text", SLICE):
            h, suffix, rows = _words(data, offsets)
            kinds = classes(h, suffix, vocabulary.words)
            n, count = part.num_rows, np.diff(rows)
            row = np.repeat(np.arange(n), count)
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            found = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            log_c = np.where(found, logs[at] if len(logs) else 0.0, 0.0)
            full, one, two, owner = contexts(kinds, rows)
            lm = np.bincount(owner, table[one, two, full].astype(float), minlength=n)
            column = vocabulary.column(h, kinds)
            some = column >= 0
            lm += np.bincount(row[some], words[one[np.flatnonzero(some) + row[some]], column[some]].astype(float), minlength=n)
            # What is left of a class is shared out by smoothed counts.
            rest = some & (column == vocabulary.first[np.maximum(kinds - (CLASSES - SUFFIXES), 0)])
            lm += np.bincount(row[rest], log_c[rest] + offset[kinds[rest]], minlength=n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array((count + 1).astype(np.int64)), pa.array(np.bincount(row, found, minlength=n).astype(np.int64)),
                                              pa.array(np.bincount(row, log_c, minlength=n)), pa.array(lm)], ["doc_id", "rid", "n_tokens", "found", "log_c", "lm"])

    return run


def _rare(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.value[4]
        for part, data, offsets in slices(batches, "text", SLICE):
            h, _, rows = _words(data, offsets)
            row = np.repeat(np.arange(part.num_rows), np.diff(rows))
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            rest = hashes[at] != h if len(hashes) else np.ones(len(h), bool)
            yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(row[rest])), signed(h[rest])], ["rid", "h"])

    return run


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above the least count that at most `most` words reach, found by a histogram of at most a few thousand bins."""
    bin_of = F.floor(F.log("c") * 50)
    kept, least = 0, None
    for r in counts.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("b")).collect():
        if kept + r["n"] > most:
            break
        kept, least = kept + r["n"], r["c"]
    return counts.where(F.col("c") >= least) if least is not None else counts.where("false")


def scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: base_score by unigram counts with add-one smoothing, and score by the model; both log10 of the whole text's probability.

    Counts are learnt from all rows whose crc32(key as text) mod 7 is not 2. Tokens are words, A-Z lower-cased, and one end. The model,
    fitted to the counts of all class triples and of all words after classes in these rows, gives a class after the two classes before it, and
    a word in its class after the class before it; the most frequent words are classes of their own, VECTORS more have vectors in their suffix class, any
    other word has its smoothed share of what is left of the class, with one share more for all unseen words, so the probabilities of all
    words and the end sum to one. The counts of the
    BROADCAST_WORDS most frequent words are broadcast; all other words get theirs by a join. Null or empty text: the end alone. Repeated rows:
    equal results, counted as often as they occur. A null key is not held out. Empty table: no rows. Other columns are ignored."""
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), body).alias("rid"), body.alias("text"))
    learnt = docs.where(~held_out(F.col("doc_id")))
    counts = cut(learnt.select("text").mapInArrow(tidy(_counted), "h long, suffix int, c long").groupBy("h").agg(F.first("suffix").alias("suffix"), F.sum("c").alias("c")))
    n_docs = learnt.count()
    top = _most_frequent(counts, BROADCAST_WORDS).toPandas().sort_values(["c", "h"], ascending=[False, True])
    found = vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["suffix"].to_numpy(np.int64))
    # What is left of each class: its words less those that are classes or have vectors.
    by_class = counts.groupBy("suffix").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    n[by_class["suffix"]], v[by_class["suffix"]] = by_class["n"], by_class["v"]
    own = top.iloc[: len(found.words) + len(found.vocab)]
    n -= np.bincount(own["suffix"].to_numpy(np.int64), own["c"].to_numpy(float), minlength=CLASSES)
    v -= np.bincount(own["suffix"].to_numpy(np.int64), minlength=CLASSES)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)

    outer, pairs = gathered(learnt.select("text"), found)
    params, inner = fit(outer), fit_inner(pairs, found.first)
    del outer, pairs

    order = np.argsort(h := top["h"].to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((found, uuid4().hex, params, inner, h[order], np.log10(top["c"].to_numpy(float)[order] + 1), -np.log10(n + v + 1)))
    whole = docs.mapInArrow(tidy(_summaries(shared), "language model"), "doc_id long, rid long, n_tokens long, found long, log_c double, lm double")
    rare = docs.mapInArrow(tidy(_rare(shared), "language model"), "rid long, h long").groupBy("rid", "h").agg(F.count("*").alias("tf"))
    # Repeated rows are counted in rare as often as they occur; each has its share.
    copies = docs.groupBy("rid").agg(F.count("*").alias("copies")).where("copies > 1")
    added = rare.join(counts.select("h", "c"), "h", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("found2"), F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("log2"))
    # With all counts broadcast a rare word is an unseen one.
    out = whole.join(added, "rid", "left").join(copies, "rid", "left")
    share = F.coalesce("copies", F.lit(1))
    log2, found2 = F.coalesce("log2", F.lit(0.0)) / share, F.coalesce((F.col("found2") / share).cast("long"), F.lit(0))
    # The end is a known token as soon as any text has been learnt from.
    end = np.log10(n_docs + 1)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("found") + found2 + int(n_docs > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                      (F.col("log_c") + log2 + float(end) - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("lm") + log2).alias("score"))
