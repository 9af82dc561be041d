"""Categorical encoders (A14, A15, J4, J5, E2, E3) and the -1 fill.

One pass counts the values of every categorical column at once (long format
``feature, value, n``, partially aggregated before the shuffle).  That table
answers the cardinality check, gives the one-hot slot order (frequency
descending, ties by text, as a frequency-ordered string index) and the
frequency encoding, so the rows are not scanned again per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import category_text
from ..functions.joins import Budget, attach
from ..roles import Params, is_numeric


def category_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature string, value string, n long`` for all features in one pass.

    NULL is a value of its own (one group); ``""`` becomes ``__empty__``.
    """
    arr = F.array(
        *[F.struct(F.lit(f).alias("feature"), category_text(f).alias("value")) for f in features]
    )
    return (
        df.select(F.inline(arr))
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cardinality(counts: DataFrame) -> DataFrame:
    """``feature, n_distinct``; NULL counts as one value."""
    return counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))


def plan_encoding(
    counts: DataFrame, features: Sequence[str], params: Params, card: dict[str, int] | None = None
) -> tuple[dict[str, list[str]], list[str]]:
    """Decide one-hot vs frequency per feature.

    Returns ({feature: labels in slot order} for one-hot, [features] for
    frequency).  The collects are bounded: one row per feature, and at most
    ``onehot_max_values`` labels per one-hot feature.  ``card`` (known
    cardinalities) saves the cardinality job.
    """
    if card is None:
        card = {r["feature"]: r["n_distinct"] for r in cardinality(counts).collect()}
    onehot = [f for f in features if card.get(f, 0) <= params.onehot_max_values]
    freq = [f for f in features if f not in onehot]
    labels: dict[str, list[str]] = {f: [] for f in onehot}
    if onehot:
        rows = counts.where(F.col("feature").isin(onehot) & F.col("value").isNotNull()).collect()
        for r in sorted(rows, key=lambda r: (r["feature"], -r["n"], r["value"])):
            labels[r["feature"]].append(r["value"])
    return labels, freq


def onehot_columns(feature: str, labels: Sequence[str]) -> list:
    """0/1 columns ``<feature>_vec_<i>``: one slot per known value; NULL or an
    unseen value gives all zeros."""
    v = category_text(feature)
    return [
        F.when(v == F.lit(lab), 1.0).otherwise(0.0).alias(f"{feature}_vec_{i}") for i, lab in enumerate(labels)
    ]


def category_slots(feature: str, labels: Sequence[str]) -> dict:
    """``<feature>_vec`` for ``slots.add_slots``."""
    return {f"{feature}_vec": (category_text(feature), labels)}


def frequency_table(counts: DataFrame, feature: str) -> DataFrame:
    """``__value, <feature>_freq``: share of all rows holding the value.

    The total is a one-row aggregate read as a scalar subquery.
    """
    fc = counts.where(F.col("feature") == F.lit(feature))
    total = fc.agg(F.sum("n").alias("__total"))
    return fc.withColumn("__total", total.scalar()).select(
        F.col("value").alias("__value"),
        (F.col("n") / F.col("__total")).alias(f"{feature}_freq"),
        F.col("n").alias(f"__{feature}_n"),
    )


def attach_frequency(
    rows: DataFrame,
    counts: DataFrame,
    feature: str,
    params: Params,
    *,
    size: Callable[[DataFrame], tuple[int, int]] | None = None,
    budget: Budget | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Left join of the frequency of ``feature``'s value; NULL values get NULL.

    ``size`` tells the known rows and bytes of the frequency table (the size check of
    the join); without it the table is measured."""
    table = frequency_table(counts, feature)
    keyed = rows.withColumn("__value", category_text(feature))
    keyed_size = size(table) if size is not None else None
    out = attach(keyed, table, "__value", params, count_col=f"__{feature}_n", keyed_size=keyed_size, budget=budget, partitions=partitions)
    return out.drop("__value", f"__{feature}_n")


def fill_sentinel(df: DataFrame, columns: Sequence[str] | None = None, value: float = -1.0) -> DataFrame:
    """NULL -> -1 in numeric columns only (booleans, strings, vectors untouched)."""
    cols = [
        f.name
        for f in df.schema.fields
        if is_numeric(f.dataType) and (columns is None or f.name in columns)
    ]
    return df.fillna(value, subset=cols) if cols else df
