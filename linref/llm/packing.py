"""Packing of tokenised documents into sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linref.llm._shared import cut, keep, slices, span_hashes, tidy, word_spans

LENGTH, END = 2048, 1


class WordEncoder:
    """Token ids of texts by a tokenizer whose tokens never span white space: each distinct word is encoded once.

    The memory of words is cleared when it holds `most` words; a word then is encoded again when it is met again."""

    def __init__(self, path: str, most: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.specials = [t["content"] for t in json.load(open(path))["added_tokens"]]
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(words) > self.most:
            self.clear()
        new = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter((i for ids in new for i in ids), np.uint32, int(sizes.sum()))
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.known, self.first, self.size = known[order], first[order], np.concatenate([self.size, sizes])[order]
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one row after another, and the n + 1 offsets of the rows."""
        starts, ends, rows = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        fresh = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if fresh.any():
            raw = data.tobytes()
            self._learn_all(distinct[fresh], [raw[a:b].decode("utf-8") for a, b in zip(starts[where[fresh]], ends[where[fresh]], strict=True)], distinct, [raw[a:b] for a, b in zip(starts[where], ends[where], strict=True)] if len(self.known) + int(fresh.sum()) > self.most else None)
            at = np.searchsorted(self.known, distinct)
        first, size = self.first[at][inverse], self.size[at][inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return flat, total[rows]

    def _learn_all(self, hashes, words, distinct, every) -> None:
        if every is None:
            self._learn(hashes, words)
        else:  # the memory is full: start anew with all words at hand
            self.clear()
            most, self.most = self.most, 1 << 62
            self._learn(distinct, [w.decode("utf-8") for w in every])
            self.most = most


_encoders: dict[str, WordEncoder] = keep("packing", {})


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _separable(text: str, specials: list[str]) -> bool:
    """Whether words can be encoded alone: no special token is in the text."""
    return not any(s in text for s in specials)


def _pieces(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part, data, offsets in slices(batches, "text", 2 << 20):
            ids, ends = enc.encode(data, offsets)
            raw = data.tobytes()
            special = [i for i in range(part.num_rows) if b"<|" in raw[offsets[i] : offsets[i + 1]]] if b"<|" in raw else []
            rows: list[tuple] = []
            for i in range(part.num_rows):
                own = ids[ends[i] : ends[i + 1]]
                if i in special and not _separable(t := raw[offsets[i] : offsets[i + 1]].decode("utf-8"), enc.specials):
                    own = np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                own = np.append(own, np.uint32(end)).astype("<u4")
                for start in range(0, len(own), length):
                    piece = own[start : start + length]
                    rows.append((i, start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
            i, *rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(i)), part.column("rid").take(pa.array(i)), *[pa.array(x, pa.int64()) for x in rest]],
                                             ["doc_id", "rid", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold each length as often as the histogram says, none longer than limit.

    Lengths are placed longest first, each on the shortest packs that still take it; packs of one pattern move together, and a
    pattern's count is split when fewer are needed. The work depends on limit, not on the number of documents."""
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by their sum
    closed: list[tuple[int, list[int]]] = []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        fresh: list[tuple[int, int, list[int]]] = []
        while left:
            total = min((t for t in open_packs if open_packs[t]), default=None)
            if total is None or total + size > limit:
                # No pack is short enough: new ones, each with as many of this length as fit.
                each = limit // size
                for k in (each, left % each):
                    n = left // each if k == each else 1
                    if k and n and left:
                        fresh.append((n, k * size, [size] * k))
                        left -= n * k
                break
            count, pattern = open_packs[total].pop()
            k = min((limit - total) // size, max(1, left // count))
            used = min(count, left // k)
            fresh.append((used, total + k * size, pattern + [size] * k))
            left -= used * k
            if count > used:
                open_packs[total].append((count - used, pattern))
        for count, total, pattern in fresh:
            if total + 1 > limit:
                closed.append((count, pattern))
            else:
                open_packs[total].append((count, pattern))
    return closed + [p for packs in open_packs.values() for p in packs]


def pack(df: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text", buckets: int = 256, rows_per_bucket: int = 500_000) -> DataFrame:
    """One row per piece of a document: where it is cut and where it lies in which sequence.

    A document's ids, with the end id, are cut into full sequences and a rest; rests are packed by their length. The histogram of lengths
    has at most `length` entries, so patterns are made on the driver; documents find their places in them by their rank among
    equal lengths. Ranks are counted in `buckets` hash buckets of each length, of full pieces in as many as leave each about rows_per_bucket
    rows at most, so a frequent length is no single group.
    Null text: empty, its end id alone. Repeated rows or keys: each row has its own pieces. Null key: as any. Empty table: no rows.
    Other columns are ignored. Sequences are filled from offset 0; what is left of one is padding."""
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = cut(docs.mapInArrow(tidy(_pieces(tokenizer, length, end), "packing"), f"doc_id {kind}, rid long, start long, length long, ids_crc32 long, doc_tokens long"))
    full = max(buckets, pieces.where(F.col("length") == length).count() // rows_per_bucket)
    pieces = pieces.withColumn("b", F.pmod(F.xxhash64("rid", "start"), F.when(F.col("length") == length, full).otherwise(buckets)))
    counts = cut(pieces.groupBy("length", "b").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Each place of a pattern serves a run of ranks of its length: rank r lies in sequence base + (r - lo) at its offset.
    places, used, base = [], defaultdict(int), 0
    for count, pattern in shortest_pack_first(histogram, length):
        offset = 0
        for size in pattern:
            places.append((size, used[size], used[size] + count, base, offset))
            used[size] += count
            offset += size
        base += count
    lo = np.array([[p[0], p[1], p[3], p[4]] for p in places], np.int64).reshape(-1, 4)
    lo = lo[np.lexsort((lo[:, 1], lo[:, 0]))]
    shared = spark.sparkContext.broadcast(lo)
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("length", "b", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "rid", "start")))
    ranked = ranked.join(offsets, ["length", "b"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("r") - 1).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        code = table[:, 0] * (1 << 45) + table[:, 1]
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(code, size * (1 << 45) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(placed), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
