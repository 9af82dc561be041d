"""Global ranking without pulling a table into one task.

``Window.orderBy`` without ``partitionBy`` moves every row into a single
partition.  ``global_rank`` range-partitions by the sort key instead, numbers
rows inside each range, and adds the number of rows in all earlier ranges
(one small row per partition, broadcast).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import checkpoint, default_partitions

PID = "__pid"
RN = "__rn"
OFF = "__off"


ROWS_PER_RANGE = 1_000_000


def range_partitions(spark, rows_hint: int | None) -> int:
    """Range partitions for ``rows_hint`` rows: about ROWS_PER_RANGE each,
    at most the session's shuffle partitions."""
    cap = default_partitions(spark)
    if rows_hint is None:
        return cap
    return max(1, min(cap, math.ceil(rows_hint / ROWS_PER_RANGE)))


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    rank_col: str = "rank",
    partitions: int | None = None,
    rows_hint: int | None = None,
) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in ``order``.

    ``order`` must be a total order (add tie-breaking keys), as with
    ``row_number``.  The numbered rows are checkpointed before they are counted:
    range partitioning samples its bounds, and two uses of one plan would sample
    them twice and disagree.  Rows and counts therefore read one written table.
    The range count is sized from ``rows_hint`` (an upper bound of the rows)
    when known, so a small table does not run the cluster's shuffle partitions.
    """
    n = partitions or range_partitions(df.sparkSession, rows_hint)
    ranged = df.repartitionByRange(n, *order).withColumn(PID, F.spark_partition_id())
    numbered = checkpoint(ranged.withColumn(RN, F.row_number().over(Window.partitionBy(PID).orderBy(*order))))
    # at most n rows: one per range partition
    offsets = numbered.groupBy(PID).agg(F.count(F.lit(1)).alias("__cnt")).select(
        PID,
        F.coalesce(
            F.sum("__cnt").over(Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias(OFF),
    )
    return (
        numbered.join(F.broadcast(offsets), on=PID, how="inner")
        .withColumn(rank_col, (F.col(OFF) + F.col(RN)).cast("int"))
        .drop(PID, RN, OFF)
    )
