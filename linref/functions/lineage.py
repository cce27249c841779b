"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder, so that the next round's plan starts from files that all executors see.

    The folder is the one in spark.checkpoint.dir; see shared_folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """df computed once into a table in the shared folder whose rows are dealt out by the key, into as many files as a shuffle has partitions.

    Later plans know how a table's rows are dealt out, which a checkpoint forgets: what is done key by key needs no shuffle then."""
    spark, name = df.sparkSession, f"settled_{uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's own; a temporary one only where the driver is the only machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def dealt(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle, however small it is thought to be.

    Sizes are guessed from compressed files, in which derived edges take few bytes each, and nothing tells how many cells a row is looked up in: what is thought to be
    10 MB, which is sent whole through the driver to every task, can be gigabytes. So it is for sides that grow with the input."""
    return df.hint("merge")


def ranged(df: DataFrame, keys: list[str], name: str, rows_per_range: int = 100_000, most_ranges: int = 100_000, place: bool = False, settled: bool = False) -> DataFrame:
    """df settled in ranges of its keys of about as many rows each, with the number of the range: however the keys are spread, no range is large.

    With place each range is in the order of its keys, and the name holds monotonically_increasing_id: the range's number and the row's place in it.
    settled: df is made of settled rows already."""
    df = df if settled else settle(df)
    ranges = min(most_ranges, max(1, df.count() // rows_per_range))
    dealt = df.repartitionByRange(ranges, *keys)
    return settle(dealt.sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()) if place else dealt.withColumn(name, F.spark_partition_id()))
