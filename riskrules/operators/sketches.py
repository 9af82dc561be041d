"""Mergeable sketches per period (A12, A14): distinct values and quantiles without a rescan.

One row per period and column holds a sketch of a few kilobytes, made by Spark's own
aggregates with partial aggregation before the shuffle, so a period with a third of all
rows costs one sketch per map task.  Sketches are stored as a table; a question
over any set of periods merges its rows, and a new or corrected period replaces only its own
rows.  Their size does not depend on the rows behind them.

Distinct values: HyperLogLog, relative standard error ``1.04 / sqrt(2 ** lg_k)`` (0.8 %
at the default 14).  NULL is counted apart, as one value.  Quantiles: KLL, rank error about
1 % at the default k of 400; NULL and NaN take no part, the quantiles 0 and 1 are exact.
Compaction in KLL tosses coins, so two runs may differ within that error.  A column without
a value in the chosen periods has 0 distinct values and NULL quantiles; no rows give no
sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import category_text

LG_K = 14
KLL_K = 400


def _long(df: DataFrame, features: Sequence[str], period: str, value) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), value(f).alias("value")) for f in features])
    return df.select(F.col(period), F.inline(pairs)).groupBy(period, "feature")


def category_sketches(df: DataFrame, features: Sequence[str], period: str, lg_k: int = LG_K) -> DataFrame:
    """``<period>, feature, sketch, has_null, n``: values as ``encode`` counts them."""
    return _long(df, features, period, category_text).agg(
        F.hll_sketch_agg("value", lg_k).alias("sketch"),
        F.max(F.col("value").isNull()).alias("has_null"),
        F.count(F.lit(1)).alias("n"),
    )


def merged_cardinality(sketches: DataFrame) -> DataFrame:
    """``feature, n_distinct, n`` over all periods of ``sketches``; NULL counts as one value."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy("feature").agg(
        (merged + F.max(F.col("has_null").cast("long"))).alias("n_distinct"), F.sum("n").alias("n")
    )


def value_sketches(df: DataFrame, features: Sequence[str], period: str, k: int = KLL_K) -> DataFrame:
    """``<period>, feature, sketch, n`` of the numbers in each column (``n``: those that count)."""

    def number(f: str):
        v = F.col(f).cast("double")
        return F.when(~F.isnan(v), v)

    return _long(df, features, period, number).agg(
        F.kll_sketch_agg_double("value", k).alias("sketch"), F.count("value").alias("n")
    )


def merged_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``feature, quantiles array<double>, n`` over all periods, one quantile per share."""
    asked = F.array(*[F.lit(float(s)) for s in shares])
    # a sketch of no number has no quantiles
    merged = sketches.groupBy("feature").agg(
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("sketch"), F.sum("n").alias("n")
    )
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", asked))
    return merged.select("feature", found.alias("quantiles"), "n")


def replace_periods(stored: DataFrame, fresh: DataFrame, period: str) -> DataFrame:
    """``stored`` with the rows of the periods in ``fresh`` replaced (NULL is a period too)."""
    new = fresh.select(F.col(period).alias("__new")).distinct()
    return stored.join(new, F.col(period).eqNullSafe(F.col("__new")), "left_anti").unionByName(fresh)
