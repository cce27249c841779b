"""Hard negatives by rotated one-bit codes: estimates from bit counts, exact intervals around them, integer scores for what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.llm._shared import cut, release

#: Components become floor(SCALE * x), held to +-MOST so that a score of any two vectors fits in a long.
SCALE, MOST = 256, 1 << 23
#: One-bit codes of a vector: the first of the vector, each further one of what the codes before it leave, each with a rotation of its own.
CODES = 4
#: Bits of an anchor's rotated components, so many counts of common bits give the product with a code.
PLANES = 8
#: Anchors that are broadcast at a time, and their bytes at most.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Pairs of a row and an anchor that are held at a time.
PAIRS = 1 << 20
CODED = "vec_id long, label long, dim int, x binary, norm double, bits binary, aligned binary, rest double"
_turns: dict[int, np.ndarray] = {}


def rotations(dim: int) -> np.ndarray:
    """CODES orthogonal matrices, the same everywhere."""
    if dim not in _turns:
        turn = np.random.default_rng(dim)
        _turns[dim] = np.stack([np.linalg.qr(turn.standard_normal((dim, dim)))[0] for _ in range(CODES)]) if dim else np.zeros((CODES, 0, 0))
    return _turns[dim]


def _words(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    n, dim = signs.shape
    packed = np.zeros((n, max(1, -(-dim // 64)) * 8), np.uint8)
    packed[:, : -(-dim // 8)] = np.packbits(signs, axis=1, bitorder="little")
    return packed.view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of integer vectors: words (n, CODES, w), alignments (n, CODES) and the lengths of what is left after the last.

    A vector is the sum of its alignments times its codes, turned back, and of a rest that is orthogonal to the last code."""
    n, dim = x.shape
    left, words, aligned = x.astype(float), [], np.zeros((n, CODES))
    for k, turn in enumerate(rotations(dim)):
        y = left @ turn.T
        signs = y >= 0
        aligned[:, k] = np.abs(y).sum(1) / max(dim, 1)
        left = left - aligned[:, k, None] * (np.where(signs, 1.0, -1.0) @ turn)
        words.append(_words(signs))
    return np.stack(words, 1), aligned, np.sqrt((left * left).sum(1))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        size, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            x = np.clip(np.floor(SCALE * flat[(starts[rows, None] + np.arange(dim)).astype(np.int64)]), -MOST, MOST)
            words, aligned, rest = encode(x)
            blob = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(np.full(len(rows), dim, np.int32)), blob(x.astype("<i4")), pa.array(np.sqrt((x * x).sum(1))), blob(words), blob(aligned), pa.array(rest)],
                                             ["vec_id", "label", "dim", "x", "norm", "bits", "aligned", "rest"])


def coded(df: DataFrame) -> DataFrame:
    """CODED rows of df (vec_id, embedding, label): all but those with a null id, label, vector or component, or one that is not finite."""
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(whole).mapInArrow(_coded, CODED)


class Anchors:
    """A block of anchors: their vectors, and the bits of their rotated components for each code, by dimension."""

    def __init__(self, table: pa.Table, slots: int):
        self.number, self.ids, self.labels = (table[c].to_numpy() for c in ("anchor", "vec_id", "label"))
        self.dims = table["dim"].to_numpy()
        self.slots, self.by_dim = slots, {}
        for dim in np.unique(self.dims):
            rows = np.flatnonzero(self.dims == dim)
            blob = b"".join(table["x"].take(pa.array(rows)).to_pylist())
            self.by_dim[int(dim)] = (rows, np.frombuffer(blob, "<i4").reshape(len(rows), dim).astype(float))

    def queries(self, dim: int):
        """Of each code: the planes (n, PLANES, w) of the rotated anchors' components, least value, step, and how far from the true ones they are."""
        rows, q = self.by_dim[dim]
        out = []
        for turn in rotations(dim):
            y = q @ turn.T
            low = y.min(1, initial=0.0)
            step = np.maximum((y.max(1, initial=0.0) - low) / (2**PLANES - 1), 1e-9)
            u = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
            off = np.sqrt(((low[:, None] + step[:, None] * u - y) ** 2).sum(1))
            out.append((np.stack([_words(u >> j & 1 == 1) for j in range(PLANES)], 1), low, step, u.sum(1), off))
        return rows, q, np.sqrt((q * q).sum(1)), out


def _products(words: np.ndarray, query, a: np.ndarray | slice, dim: int, dense: bool) -> np.ndarray:
    """<code, rotated anchor> of each row with each anchor (dense), or of the i-th row with the i-th anchor: from counts of common bits alone."""
    planes, low, step, total, _ = query
    planes, low, step, total = planes[a], low[a], step[a], total[a]
    shape = (lambda v: v[:, None]) if dense else (lambda v: v)
    ones, common = 0, 0
    for w in range(words.shape[1]):
        code = words[None, :, w] if dense else words[:, w]
        ones = ones + np.bitwise_count(words[:, w]).astype(np.int32)
        for j in range(PLANES):
            common = common + (np.bitwise_count(code & shape(planes[:, j, w])).astype(np.int32) << j)
    return 2 * (shape(low) * ones + shape(step) * common) - shape(low * dim + step * total)


def _narrowed(rows: dict, anchors, dim: int, a: slice, wanted):
    """Pairs (row, anchor of the slice) that wanted(low, high, anchor, row) keeps by the interval that their score is surely in.

    The interval is the estimate from the codes so far, give or take what the rest can add: by Cauchy-Schwarz its length times that of the
    anchor's part across the last code. After two codes the pairs that are left are listed, and only these have the further codes counted."""
    _, _, lengths, queries = anchors
    n = len(lengths[a])
    estimate, slack = np.zeros((n, len(rows["norm"]))), np.zeros((n, len(rows["norm"])))
    i = j = None
    for k, query in enumerate(queries):
        dense = i is None
        g, at = (rows["aligned"][None, :, k], a) if dense else (rows["aligned"][i, k], j + a.start)
        length, off = (lengths[a][:, None], query[4][a][:, None]) if dense else (lengths[at], query[4][at])
        t = _products(rows["words"][:, k] if dense else rows["words"][i, k], query, at, dim, dense)
        estimate, slack = estimate + g * t, slack + g * (np.sqrt(dim) * off)
        # The true product with the code is within sqrt(dim) * off of the counted one.
        along = np.maximum(np.abs(t) - np.sqrt(dim) * off, 0) / np.sqrt(max(dim, 1))
        rest = rows["rests"][:, k][None, :] if dense else rows["rests"][i, k]
        wide = rest * np.sqrt(np.maximum(length * length - along * along, 0)) + slack
        wide = wide * (1 + 1e-9) + 1e-6 + 1e-9 * np.abs(estimate)
        if k == 0:
            continue
        if dense:
            keep = wanted(estimate - wide, estimate + wide, np.arange(n)[:, None], slice(None))
            j, i = np.nonzero(keep)
            estimate, slack = estimate[j, i], slack[j, i]
        else:
            keep = wanted(estimate - wide, estimate + wide, j, i)
            i, j, estimate, slack = i[keep], j[keep], estimate[keep], slack[keep]
        if not len(i):
            break
    return i, j


def _scores(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of integer vectors."""
    out = np.zeros(len(i), np.int64)
    small = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(x.shape[1], 1) < 2**52
    for k in range(0, len(i), 1 << 16):
        s = slice(k, k + (1 << 16))
        a, b = x[i[s]], q[j[s]]
        out[s] = np.einsum("ij,ij->i", a, b).astype(np.int64) if small else np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return out


class _Best:
    """The first `most` rows of each group, higher scores first, then smaller ids; rows that agree in id, label and score count once."""

    def __init__(self, groups: int, most: int):
        self.most, self.rows = most, np.zeros((0, 4), np.int64)  # group, -score, id, label
        self.bar = np.full(groups, -np.inf)

    def add(self, group, score, ids, labels) -> None:
        both = np.unique(np.concatenate([self.rows, np.stack([group, -score, ids, labels], 1)]), axis=0)
        first = np.searchsorted(both[:, 0], both[:, 0])
        place = np.arange(len(both)) - first
        self.rows = both[place < self.most]
        last = both[place == self.most - 1]
        self.bar[last[:, 0]] = -last[:, 1]


def _read_rows(batches: Iterator[pa.RecordBatch], dims) -> Iterator[tuple[int, dict]]:
    """The coded rows in small groups of one dimension; rows whose dimension no anchor has are of no use."""
    for batch in batches:
        every = batch.column("dim").to_numpy()
        for dim in np.unique(every):
            if int(dim) not in dims:
                continue
            part = batch.take(pa.array(np.flatnonzero(every == dim)))
            n, blob = part.num_rows, lambda c: b"".join(part.column(c).to_pylist())  # noqa: B023
            words = np.frombuffer(blob("bits"), np.uint64).reshape(n, CODES, -1)
            aligned = np.frombuffer(blob("aligned"), float).reshape(n, CODES)
            norm = part.column("norm").to_numpy()
            # What is left after each code: its square is the one before less dim times the alignment's.
            rests = np.sqrt(np.maximum(norm[:, None] ** 2 - dim * np.cumsum(aligned**2, 1), 0)) + 1e-6 * norm[:, None]
            yield int(dim), {"ids": part.column("vec_id").to_numpy(), "labels": part.column("label").to_numpy(), "x": np.frombuffer(blob("x"), "<i4").reshape(n, dim).astype(float), "norm": norm, "words": words, "aligned": aligned, "rests": rests}


def _groups(batches: Iterator[pa.RecordBatch], block: Anchors):
    ready = {}
    for dim, rows in _read_rows(batches, block.by_dim):
        ready.setdefault(dim, block.queries(dim))
        n = len(ready[dim][0])
        size = min(n, 256)
        for at in range(0, len(rows["ids"]), PAIRS // size):
            s = slice(at, at + PAIRS // size)
            part = {c: v[s] for c, v in rows.items()}
            for first in range(0, n, size):
                yield dim, part, ready[dim], slice(first, min(first + size, n))


def _output(best: _Best, block: Anchors) -> pa.RecordBatch:
    group, score, ids, labels = best.rows.T
    a, slot = group // block.slots, group % block.slots
    return pa.RecordBatch.from_arrays([pa.array(block.number[a]), pa.array(block.ids[a]), pa.array(slot), pa.array(-score), pa.array(ids), pa.array(labels)], ["anchor", "anchor_id", "slot", "score", "vec_id", "label"])


BEST = "anchor long, anchor_id long, slot long, score long, vec_id long, label long"


def _positives(shared, most: int):
    """Of a task's rows the first `most` of each anchor's label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Anchors = shared.value
        best = _Best(len(block.ids), most)
        for dim, rows, anchors, a in _groups(batches, block):
            own = anchors[0][a]

            def wanted(low, high, k, i, own=own, rows=rows):
                mine = (rows["labels"][i] == block.labels[own[k]]) & (rows["ids"][i] != block.ids[own[k]])
                bar = best.bar[own]
                if low.ndim == 2 and low.shape[1] > most:
                    # Rows that surely score so high are enough to set a bar; the id alone may repeat, so it counts from distinct ids only.
                    if len(np.unique(rows["ids"])) == len(rows["ids"]):
                        bar = np.maximum(bar, np.floor(np.partition(np.where(mine, low, -np.inf), -most, axis=1)[:, -most]))
                return mine & (high >= bar[k])

            i, j = _narrowed(rows, anchors, dim, a, wanted)
            if len(i):
                best.add(own[j], _scores(rows["x"], anchors[1], i, j + a.start), rows["ids"][i], rows["labels"][i])
        yield _output(best, block)

    return run


def _negatives(shared, most: int, lowest: int, highest: int):
    """Of a task's rows the first `most` of other labels in the band of each anchor and positive: lowest to highest percent of the positive's score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, positive = shared.value  # positive: (anchors, slots) of scores, and which of them there are
        scores, there = positive
        best = _Best(scores.size, most)
        floor, roof = -(-lowest * scores // 100), highest * scores // 100
        for dim, rows, anchors, a in _groups(batches, block):
            own = anchors[0][a]

            def wanted(low, high, k, i, own=own, rows=rows):
                other = (rows["labels"][i] != block.labels[own[k]]) & (rows["ids"][i] != block.ids[own[k]])
                any_slot = np.zeros(low.shape, bool)
                for slot in range(block.slots):
                    bar = np.maximum(floor[own, slot], best.bar[own * block.slots + slot])
                    bar = np.where(there[own, slot], bar, np.inf)
                    any_slot |= (low <= roof[own, slot][k]) & (high >= bar[k])
                return other & any_slot

            i, j = _narrowed(rows, anchors, dim, a, wanted)
            if not len(i):
                continue
            s, of = _scores(rows["x"], anchors[1], i, j + a.start), own[j]
            for slot in range(block.slots):
                ok = there[of, slot] & (s >= floor[of, slot]) & (s <= roof[of, slot])
                if ok.any():
                    best.add(of[ok] * block.slots + slot, s[ok], rows["ids"][i[ok]], rows["labels"][i[ok]])
        yield _output(best, block)

    return run


def _first(df: DataFrame, most: int) -> DataFrame:
    """The first of each anchor and slot among what the tasks found, ranked."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "label")
    return df.distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, lowest: int = 80, highest: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of df (vec_id, embedding, label).

    A score is the inner product of floor(256 * x), components held to +-2^23, as whole numbers. Anchors are the rows whose vec_id is a multiple
    of `every`; an anchor's positives are its first rows of the same label, by score, then smaller vec_id; each positive's negatives the first rows of other
    labels that score between lowest and highest percent of it.

    Rows with a null vec_id, label, vector or component, or with a component that is not finite, take no part. Vectors meet those of the same
    number of components alone; without components all scores are 0. A vec_id never meets itself. Repeated rows count once: rows that agree in vec_id, label and score to the
    anchor are one. Empty table, or one without anchors: no rows. Other columns are ignored.

    Anchors are broadcast in blocks of about 4,096 (16 MB at most), each held against all rows twice: for positives, then for negatives. A task
    keeps the first rows of each anchor alone, so what is shuffled is a few rows for each anchor and task."""
    spark = df.sparkSession
    rows = cut(coded(df))
    chosen = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "dim", "x").distinct()
    count, widest = chosen.agg(F.count("*"), F.max("dim")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        release(rows)
        return spark.createDataFrame([], schema)
    per = max(1, min(BLOCK, BLOCK_BYTES // (8 * PLANES * CODES * max(1, -(-widest // 64)) + 12 * widest + 64)))
    blocks = -(-count // per)
    anchors = cut(chosen.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks)))) if blocks > 1 else cut(chosen.withColumn("block", F.lit(0).cast("long")))
    out, used = None, []
    for number in range(blocks):
        part = anchors.where(F.col("block") == number).orderBy("vec_id", "label", "x").toArrow()
        if not part.num_rows:
            continue
        part = part.append_column("anchor", pa.array(np.arange(part.num_rows) + (number << 32)))
        block = Anchors(part.combine_chunks(), 1)
        best = _first(rows.mapInArrow(_positives(spark.sparkContext.broadcast(block), positives), BEST), positives)
        best = cut(best)
        used.append(best)
        found = best.toArrow()  # at most `positives` rows for each anchor of the block
        scores, there = np.zeros((part.num_rows, positives), np.int64), np.zeros((part.num_rows, positives), bool)
        at, slot = found["anchor"].to_numpy() - (number << 32), found["place"].to_numpy() - 1
        scores[at, slot], there[at, slot] = found["score"].to_numpy(), True
        block.slots = positives
        near = _first(rows.mapInArrow(_negatives(spark.sparkContext.broadcast((block, (scores, there))), negatives, lowest, highest), BEST), negatives)
        known = best.select("anchor", (F.col("place") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        mine = near.join(known, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = mine if out is None else out.unionByName(mine)
    return out
