"""Sharding by a keyed permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linref.llm._shared import mix


def permute(x: np.ndarray, n: int, seed: int = 0, rounds: int = 6) -> np.ndarray:
    """The place of each row number of 0 to n - 1 in a permutation of 0 to n - 1.

    A balanced Feistel network permutes the smallest square domain of 2^(2k) numbers that holds n; a number that
    leaves 0 to n - 1 walks on along its cycle until it is back, so what remains is a permutation of 0 to n - 1."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + (np.uint64(seed % (1 << 64)) << np.uint64(8)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        return (left << half) | right

    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = once(out[todo])
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def global_row_numbers(df: DataFrame, key: str, ties: list[Column], name: str, buckets: int = 4096, rows_per_bucket: int = 500_000) -> tuple[DataFrame, int]:
    """df with a row number from 0 without gaps, and the number of rows.

    Rows are ordered by a bucket of the hash of key and ties, then by key and ties; a repeated or null key is spread over buckets: the order depends on the rows alone, not on files or
    partitions. Each bucket is numbered by itself, and the bucket counts give each bucket's first number: `buckets` rows, or as many as leave
    each bucket about rows_per_bucket rows."""
    buckets = max(buckets, df.count() // rows_per_bucket)
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(F.col(key), *ties), F.lit(buckets)))
    counts = {r["__bucket"]: r["count"] for r in bucketed.groupBy("__bucket").count().collect()}
    first, total = [], 0
    for b in range(buckets):
        first.append(total)
        total += counts.get(b, 0)
    spark = df.sparkSession
    starts = spark.createDataFrame(list(enumerate(first)), "__bucket long, __first long")
    within = Window.partitionBy("__bucket").orderBy(F.col(key).asc_nulls_first(), *ties)
    numbered = bucketed.withColumn("__n", F.row_number().over(within)).join(F.broadcast(starts), "__bucket")
    return numbered.withColumn(name, F.col("__first") + F.col("__n") - 1).drop("__bucket", "__first", "__n"), total


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, seed: int = 20240607) -> DataFrame:
    """Shard and slot of every row, as a reproducible shuffle: counts of the shards are at most one apart (law `rows`).

    With p the place of a row's global number under the permutation, shard = p mod shards and slot = p div shards, so both are
    computable from the row number alone, and slots have no gaps. Equal texts are not kept together: a group that holds a third
    of the rows could not be, under this law. Null text: size 1, crc of the empty text. Null key: its own place, as any key.
    Repeated rows: each has its own place. Empty table: no rows. Other columns are ignored, whatever their names.
    grown_shard is null, as it belongs to another law."""
    body = F.coalesce(F.col(text), F.lit(""))
    light = df.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"))
    numbered, n = global_row_numbers(light, "doc_id", [F.col("text_crc32"), F.col("size")], "__row")

    @F.pandas_udf(T.LongType())
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return numbered.withColumn("__place", place("__row")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("__place") % shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
