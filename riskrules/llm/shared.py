"""Helpers of the llm operators: shared tables and fixed-size key filters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bits of a key filter; its size (8 MiB) never depends on the data.
FILTER_BITS = 1 << 26


#: Bytes of an Arrow batch handed to a worker, and Spark's own (eight times larger) default.
BATCH, BATCH_DEFAULT, BATCH_KEY = "8m", "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Ask for batches of whole texts that stay small in a worker, unless the
    session has a setting of its own."""
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH)


def shared_table(df: DataFrame, name: str, *, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The written table cuts the lineage: later stages, and retries after a lost
    executor, read files instead of replaying the plan.  The folder is the one
    the cluster names in ``spark.checkpoint.dir``; its owner clears it.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bits_of(keys: np.ndarray) -> np.ndarray:
    """Bit of each 64-bit key: its high bits after one multiplication."""
    mixed = keys.astype(np.uint64, copy=False) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def key_filter(keys: DataFrame, key: str):
    """Broadcast bitset holding every ``key`` of ``keys`` (long column).

    A member always tests true; others may (they only cost work later, joins
    decide).  Partial bitsets are combined per 64-bit word on the executors
    and the driver gets at most FILTER_BITS / 8 bytes, however many keys exist.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        for b in batches:
            if b.num_rows:
                bits = np.unique(bits_of(np.asarray(b.column(0)).view(np.uint64)))
                at, first = np.unique(bits >> 6, return_index=True)
                words[at] |= np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype(np.uint64), first)
        at = np.flatnonzero(words)
        for i in range(0, len(at), 65536):
            yield pa.record_batch([pa.array(at[i : i + 65536]), pa.array(words[at[i : i + 65536]].view(np.int64))], names=["at", "word"])

    words = keys.select(key).mapInArrow(pages, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    # at most FILTER_BITS / 64 rows of 16 bytes, moved in Arrow batches
    got = words.toArrow()
    bitset = np.zeros(FILTER_BITS // 64, np.int64)
    bitset[got.column("at").to_numpy()] = got.column("word").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bitset.view(np.uint64))


def passes(bitset: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit ``keys`` may be in the filter (all that are, do)."""
    bit = bits_of(keys)
    return (bitset[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder.  In local mode, where the package may be run
    from its source folder, workers get that folder on their path."""
    bounded_batches(spark)
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        sc.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
