"""Join and materialisation helpers that stay safe at cluster scale.

* ``attach`` joins a keyed table (one row per key) on to a large row table.
  It broadcasts the keyed table only after measuring its rows and bytes, within
  what is left of the plan's ``Budget``; above the limits it
  uses a sort-merge join in which hot keys (a key may hold a third of all
  rows) and the NULL key are spread over several tasks with a salt.
* ``materialize`` cuts lineage with ``checkpoint`` in the directory the
  cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..roles import Params

#: Spark's limit on the bytecode of a fused method, and the JVM's for compiling one.
METHOD_KEY, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000
#: Whether Spark removes a query's shuffle files at its end, or when the driver collects its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SALT = "__salt"
NSALT = "__n_salt"


#: Bytes a row and a fixed-width value take in a broadcast table, and an array in all.
ROW_BYTES, VALUE_BYTES, ARRAY_BYTES = 32, 8, 96


@dataclass
class Budget:
    """Bytes that the broadcasts of one plan may still take; they are held at once."""

    left: int

    def takes(self, rows: int, nbytes: int, params: Params) -> bool:
        """Whether a table may be broadcast; if so, its bytes are gone."""
        if rows > params.max_broadcast_rows or nbytes > self.left:
            return False
        self.left -= nbytes
        return True


def fixed_width(fields) -> int:
    """Bytes of a row of these fields without the contents of texts."""
    return ROW_BYTES + sum(ARRAY_BYTES if isinstance(f.dataType, T.ArrayType) else VALUE_BYTES for f in fields)


def text_bytes(fields) -> F.Column:
    """Bytes of a row's texts."""
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    total = F.lit(0).cast("long")
    for c in quoted:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a table, in one aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(text_bytes(df.schema.fields)).alias("texts")).first()
    return r["n"], r["n"] * fixed_width(df.schema.fields) + int(r["texts"] or 0)


def row_hash(df: DataFrame) -> F.Column:
    """Deterministic per-row hash over the atomic columns (stable on retry)."""
    atomic = [
        F.col(f"`{f.name}`")
        for f in df.schema.fields
        if f.dataType.typeName() not in ("array", "map", "struct", "vector", "udt")
    ]
    return F.xxhash64(*atomic) if atomic else F.lit(0).cast("long")


def attach(
    rows: DataFrame,
    keyed: DataFrame,
    key: str,
    params: Params,
    *,
    count_col: str | None = None,
    keyed_size: tuple[int, int] | None = None,
    budget: Budget | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``rows LEFT JOIN keyed USING (key)``, planned for size and skew.

    ``keyed`` must hold at most one row per non-NULL key (a profile or a
    frequency table).  ``count_col`` is the number of ``rows`` behind each key
    (``tx_count`` of a profile); it tells which keys are hot.  ``keyed_size``
    is its known number of rows and bytes (the size check); when it is not given,
    ``keyed`` is persisted and measured here, and the caller may ``unpersist`` it
    after the join has run.  ``budget`` is shared by the joins of one plan.
    ``partitions``: into so many the salted join deals the rows.
    """
    if keyed_size is None:
        # the measure fills the cache the join then reads (no second aggregation)
        keyed = keyed.persist(StorageLevel.MEMORY_AND_DISK)
        keyed_size = measure(keyed)
    budget = budget if budget is not None else Budget(params.max_broadcast_bytes)
    if budget.takes(*keyed_size, params):
        return rows.join(F.broadcast(keyed), on=key, how="left")
    if count_col is None:
        # no weights: sort-merge join, AQE splits skewed partitions
        return rows.join(keyed, on=key, how="left")
    return _salted_left_join(rows, keyed, key, count_col, params, partitions)


def _salted_left_join(
    rows: DataFrame, keyed: DataFrame, key: str, count_col: str, params: Params, partitions: int | None = None
) -> DataFrame:
    stats = keyed.agg(
        F.sum(count_col).alias("total"),
        F.sum(F.when(F.col(key).isNull(), F.col(count_col))).alias("nulls"),
    ).first()
    total = int(stats["total"] or 0)
    per_task = max(params.rows_per_task, math.ceil(total / max(params.max_hot_keys, 1)))
    # sum(count) == total, so at most total / per_task <= max_hot_keys keys are hot
    hot = keyed.where(F.col(key).isNotNull() & (F.col(count_col) > per_task)).select(
        key, F.ceil(F.col(count_col) / F.lit(per_task)).cast("int").alias(NSALT)
    )
    null_salts = max(1, math.ceil(int(stats["nulls"] or 0) / per_task))

    tagged = rows.join(F.broadcast(hot), on=key, how="left")
    n_salt = F.when(F.col(key).isNull(), F.lit(null_salts)).otherwise(F.coalesce(F.col(NSALT), F.lit(1)))
    tagged = tagged.withColumn(SALT, F.pmod(row_hash(rows), n_salt).cast("int")).drop(NSALT)

    copies = (
        keyed.join(F.broadcast(hot), on=key, how="left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(NSALT), F.lit(1)) - 1)))
        .drop(NSALT)
    )
    if partitions is not None:
        # Spark joins them as they are dealt, and leaves a stated number as it is
        tagged, copies = (side.repartition(partitions, key, SALT) for side in (tagged, copies))
    return tagged.join(copies, on=[key, SALT], how="left").drop(SALT)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private temp folder only when unset (tests)."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError(
                "set spark.checkpoint.dir to a shared folder: checkpoints must survive lost executors"
            )
        # local mode only (tests): spark.checkpoint.dir is a core config and
        # cannot be set at run time, so name a private folder on the context
        d = tempfile.mkdtemp(prefix="riskrules-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared checkpoint folder (lineage cut)."""
    checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        # a query has the setting of the moment when it is stated
        return df.select("*").checkpoint(eager=True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def compiled_methods(spark: SparkSession):
    """Generated code only as far as the JVM compiles it.

    The JVM interprets methods of more than 8,000 bytes for good.  Joins and projections of
    a hundred columns fused into one stage make such a method; with this limit they run
    operator by operator instead, each compiled."""
    return _setting(spark, METHOD_KEY, str(min(int(spark.conf.get(METHOD_KEY)), METHOD_BYTES)))


def shuffles_removed(spark: SparkSession):
    """The shuffle files of what is checkpointed go when it is stored.

    Nothing reads them again.  Else they lie beside the next steps' files until the driver
    happens to collect its garbage, which on a cluster may be after the last step.  Spark
    before 4.1 does not know the setting and keeps them."""
    return _setting(spark, CLEANUP_KEY, "true") if spark.conf.isModifiable(CLEANUP_KEY) else nullcontext()


def partitions_by_rows(spark: SparkSession, rows: int, params: Params) -> int | None:
    """Partitions that do not grow with ``rows`` rows; None if few rows may stay as they are.

    After a shuffle Spark merges partitions by their bytes, down to one a core; rows that
    grow wide after that need more."""
    n = math.ceil(rows / params.rows_per_partition)
    return n if n > spark.sparkContext.defaultParallelism else None


def materialize(df: DataFrame, params: Params) -> DataFrame:
    """Reuse ``df`` across jobs without recomputing its lineage.

    ``checkpoint``: written to the shared checkpoint folder (survives lost
    executors without replaying the upstream plan).  ``persist``: memory and
    disk cache, recomputed from lineage on loss.
    """
    if params.materialize == "checkpoint":
        with compiled_methods(df.sparkSession):
            return checkpoint(df)
    if params.materialize == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def default_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
