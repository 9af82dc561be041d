"""Score band (P1) and amount buckets / flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import amount_bucket
from ..roles import Params, Roles

BUCKET = "amount_bucket"


def score_band(df: DataFrame, roles: Roles, params: Params) -> DataFrame:
    """Rows with ``min_score <= score < max_score``; NULL score is dropped."""
    s = F.col(roles.score)
    return df.where((s >= F.lit(float(params.min_score))) & (s < F.lit(float(params.max_score))))


def with_amount_bucket(df: DataFrame, roles: Roles, params: Params) -> DataFrame:
    if BUCKET in df.columns:
        return df
    return df.withColumn(BUCKET, amount_bucket(roles.amount, params.amount_thresholds))


def amount_flag_columns(params: Params) -> list:
    """``amount_range_i`` = 1.0 when the row is in bucket i, else 0.0 (NULL amount: all 0)."""
    n = len(params.amount_thresholds) + 1
    return [
        F.when(F.col(BUCKET) == F.lit(i), 1.0).otherwise(0.0).alias(f"amount_range_{i}") for i in range(n)
    ]


def with_amount_flags(df: DataFrame, roles: Roles, params: Params) -> DataFrame:
    df = with_amount_bucket(df, roles, params)
    return df.select("*", *amount_flag_columns(params))


def amount_bounds(params: Params, bucket: int) -> tuple[float | None, float | None]:
    t = params.amount_thresholds
    lo = None if bucket == 0 else float(t[bucket - 1])
    hi = None if bucket == len(t) else float(t[bucket])
    return lo, hi
