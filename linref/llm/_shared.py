"""Pieces that several operators use: tables that cut lineage, batches of texts, word hashes in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but these; as a Java pattern for split().
SPACES = "[ \\t-\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's own; a temporary one only where the driver is the only machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        now = sc._jsc.sc().getCheckpointDir()
        if not now.isDefined() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = now.get() if now.isDefined() else tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into a Parquet table in the shared folder and read from there, its lineage cut.

    The shuffle files behind it are then of no more use, but Spark's cleaner only learns of that when the driver collects its garbage,
    which a driver with little to do hardly does; so it is asked to, once the last reference to the finished plan is gone."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    trim()
    time.sleep(0.1)
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table._cut_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes the tables of cut() once all that is made from them has been cut itself."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def trim() -> None:
    """Gives the memory that this process has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


#: What workers keep from task to task, by the operator that it is of.
_kept: dict[str, dict] = {}


def keep(operator: str, store: dict) -> dict:
    """The store, which is emptied in a worker that turns to another operator."""
    _kept[operator] = store
    return store


def drop_others(operator: str | None) -> None:
    for name, store in _kept.items():
        if name != operator:
            store.clear()


def tidy(run, operator: str | None = None):
    """An Arrow function after whose last batch its worker gives the memory that it has freed back to the machine.

    Workers live on for later tasks, and what their allocators keep for themselves would add up to the largest that any task needed.
    Of what they keep on purpose, a task begins with this operator's own alone."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(operator)
        yield from run(batches)
        trim()

    return tidied


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sieve(hashes: DataFrame):
    """A broadcast bitmap in which each number of the one column has its bit: 16 MB at most, by 2 million rows at most. Of other numbers few
    have theirs while there are fewer numbers than bits; with many more all have, so what comes through it is to be told apart exactly later."""
    column, spark = F.col(hashes.columns[0]), hashes.sparkSession
    bits = 1 << min(27, max(10, (hashes.count() * 16).bit_length()))
    place = column.bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bitmap)


def sifted(bitmap: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit in a sieve's bitmap."""
    place = x & np.uint64(len(bitmap) * 64 - 1)
    return bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of whole rows with at most limit bytes of text (one longer text alone), with the text's buffers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation, for words without what sticks to them.
IS_MARK = IS_SPACE.copy()
IS_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for n rows the n + 1 numbers of their first words. between: the bytes that are in no word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[0] = edge[-1] = True
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; fold: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_FOLDED if fold else _LETTER)[data] * power[: len(data)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = False, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the n + 1 numbers of the rows' first words."""
    starts, ends, rows = word_spans(data, offsets, between)
    return span_hashes(data, starts, ends, fold), rows


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, built by doubling; rows are not told apart."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    scale, total, size = np.uint64(0xD6E8FEB86659FD93), None, 0
    part, length = words, 1
    while True:
        if n & length:
            if total is None:
                total, size = part, length
            else:
                m = min(len(total), len(part) - size)
                total, size = total[:m] * scale + part[size : size + m], size + length
        if size == n:
            return mix(total)
        part = part[:-length] * scale + part[length:]
        length, scale = length * 2, np.uint64(int(scale) ** 2 % (1 << 64))


def starts_of_grams(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which n words of one row start, and their rows."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.flatnonzero(np.arange(len(row)) + n <= rows[1:][row]) if len(row) else np.zeros(0, np.int64)
    return at, row[at]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    length = 1
    while length * 2 <= n:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return np.minimum(x[: len(x) - (n - length)], x[n - length :]) if n > length else x


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as Spark's longs."""
    return pa.array(x.view(np.int64))
