"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams, skip-grams and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linref.llm._shared import IS_MARK, cut, gram_hashes, mix, slices, span_hashes, tidy, unused, word_spans

BITS = 20
#: Bytes at which longer words count by their beginnings too, so that new compounds of a known stem are told.
BEGINNINGS = (5, 7)
#: At most so many labelled rows of each class are fitted on; the classes' true shares, over all labelled rows, set the intercept.
ROWS_PER_CLASS = 3000


@dataclass
class Model:
    """Sparse weights: their number is at most 2^BITS, whatever the corpus."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, beginnings of longer words, word pairs and pairs around one word, with their rows."""
    starts, ends, rows = word_spans(data, offsets, IS_MARK)
    words = span_hashes(data, starts, ends, fold=True)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    out, owners = [words], [row]
    for n in BEGINNINGS:
        longer = ends - starts > n
        out.append(mix(span_hashes(data, starts[longer], starts[longer] + n, fold=True) + np.uint64(n)))
        owners.append(row[longer])
    if len(words) > 1:
        same = row[1:] == row[:-1]
        out.append(gram_hashes(words, 2)[same])
        owners.append(row[1:][same])
    if len(words) > 2:
        same = row[2:] == row[:-2]
        out.append(mix(words[:-2] * np.uint64(3) + words[2:])[same])
        owners.append(row[2:][same])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(owners)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(batches, "text"):
        index, row = features(data, offsets)
        lists = [np.unique(index[row == i]) for i in range(part.num_rows)] if part.num_rows < 8 else _split(index, row, part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(lists, pa.list_(pa.int32()))], ["label", "x"])


def _split(index: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    pairs = np.unique(row.astype(np.int64) << 32 | index)
    return np.split((pairs & 0xFFFFFFFF).astype(np.int32), np.searchsorted(pairs >> 32, np.arange(1, n)))


def fit(x: list[np.ndarray], y: np.ndarray, prior: float, epochs: int = 12, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, seed: int = 7) -> Model:
    """FTRL-proximal: each coordinate has its own learning rate, and stays at zero until its sum of gradients exceeds l1."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    turn = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in turn.permutation(len(y)):
            k = x[i]
            zk, nk = z[k], n[k]
            root = np.sqrt(nk)
            w = np.where(np.abs(zk) > l1, (np.sign(zk) * l1 - zk) / ((beta + root) / alpha + l2), 0.0)
            w0 = -z0 * alpha / (beta + np.sqrt(n0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -30, 30))) - y[i]
            z[k] = zk + g - (np.sqrt(nk + g * g) - root) / alpha * w
            n[k] = nk + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * w0
            n0 += g * g
    live = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[live]) * l1 - z[live]) / ((beta + np.sqrt(n[live])) / alpha + l2)
    # The rows fitted on have their own share of label 1; the intercept is moved to the share among all labelled rows.
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    prior = np.clip(prior, 1e-6, 1 - 1e-6)
    return Model(live.astype(np.int32), w, float(-z0 * alpha / (beta + np.sqrt(n0)) + np.log(prior / (1 - prior)) - np.log(share / (1 - share))))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """From docs (doc_id, text) and labels (doc_id, label 0/1); held-out and unlabelled rows are never read. A document with both labels counts as both."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not sum(counts.values()):
        return Model(np.zeros(0, np.int32), np.zeros(0), -1.0)  # nothing is called toxic
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 1").orderBy(*order).limit(rows_per_class).unionByName(known.where("label = 0").orderBy(*order).limit(rows_per_class))
    # The choice is bounded, so it is sent to the texts rather than the texts to it.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(tidy(_examples), "label int, x array<int>").toArrow().combine_chunks()
    lists, y = rows["x"].combine_chunks(), rows["label"].to_numpy()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    ends = np.cumsum(size)
    sums = np.array([flat[b - n : b].sum(dtype=np.int64) for b, n in zip(ends, size, strict=True)])
    order = np.lexsort((size, sums, y))  # one order, however tasks ended
    return fit([flat[ends[i] - size[i] : ends[i]] for i in order], y[order].astype(float), counts.get(1, 0) / sum(counts.values()))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        weights = np.zeros(1 << BITS)
        weights[model.index] = model.weight
        live = weights != 0
        for part, data, offsets in slices(batches, "text"):
            index, row = features(data, offsets)
            keep = live[index]
            pairs = np.unique(row[keep].astype(np.int64) << 32 | index[keep])
            sums = np.bincount(pairs >> 32, weights[pairs & 0xFFFFFFFF], minlength=part.num_rows) + model.intercept
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(1 / (1 + np.exp(-np.clip(sums, -700, 700))))], ["doc_id", "rid", "score"])

    return run


def score(df: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, rid, held_out, score, predicted) of every row, from its whole text alone.

    Rows whose crc32(key as text) mod 5 is 0 are held out: their labels are not learnt from. Null or empty texts have the score
    of a text without features; without labels to learn from every score is 1 / (1 + e), so nothing is called toxic. A null key is not held out. Repeated rows:
    the same score each. Empty table: no rows. Other columns are ignored. rid hashes key and text."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), body).alias("rid"), body.alias("text"))
    model = train(docs.select("doc_id", "text"), labels, label, rows_per_class)
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = docs.mapInArrow(tidy(_scores(shared)), "doc_id long, rid long, score double")
    return out.select("doc_id", "rid", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(df: DataFrame, labels: DataFrame) -> DataFrame:
    return score(df, labels).drop("rid")


def drop_toxic(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows whose score is 0.5 or more; all other rows stay as they are, repeated ones and those of null keys too.

    Null, empty and blank texts have the score of a text without features. Without labels
    nothing goes. Empty table: no rows. Columns of any name are kept."""
    rid = unused(df, "rid")
    bad = cut(score(df, labels, key=key, text=text).where("predicted = 1").select(F.col("rid").alias(rid)).distinct())
    return df.withColumn(rid, F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))).join(bad, rid, "left_anti").select(*df.columns)
