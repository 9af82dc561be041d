"""Risk tiers (A12, A13, T1-T3, J6) and their one-hot columns.

Bins are the percentiles 0/50/90/95/100 of the DISTINCT non-NULL entity
rates, ties removed.  They live in a one-row DataFrame that reaches the
profile (one row per entity) as a scalar subquery, never through a Python
collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import tier_expr
from ..functions.joins import checkpoint
from ..functions.order_stats import percentiles
from ..roles import UNKNOWN_TIER, Params, Roles
from .profiles import BINS as ROW_BINS
from .profiles import measure_names

BINS = "bins"


BINS_SCHEMA = "__gid long, bins array<double>"


def _bins_of(rates: DataFrame, params: Params) -> DataFrame:
    """``__gid, bins``: sorted distinct percentile edges of the distinct rates
    (``group, value``) of each group; at most one row per group."""
    spark = rates.sparkSession
    found = percentiles(checkpoint(rates.where(F.col("value").isNotNull()).distinct()), [float(p) for p in params.tier_percentiles])
    return spark.createDataFrame([(g, list(dict.fromkeys(edges))) for g, edges in sorted(found.items())], BINS_SCHEMA)


def risk_bins(profile: DataFrame, rate_col: str, params: Params, *, by: str | None = None, approx: bool = False) -> DataFrame:
    """One row, ``bins array<double>``: sorted distinct percentile edges.  ``by``: a
    whole-number column; a row ``<by>, bins`` for each of its values that has rates.

    Exact, with linear interpolation between order statistics (NumPy's default),
    by grouped counts of shrinking ranges (``functions.order_stats``), whatever the
    number of rates; NULL without rates.  ``approx``: ``percentile_approx``.
    """
    group = F.lit(0) if by is None else F.col(by)
    rates = profile.select(group.cast("long").alias("group"), F.col(rate_col).cast("double").alias("value"))
    if approx and by is not None:
        raise ValueError("approximate bins are those of one group")
    if approx:
        pcts = F.array(*[F.lit(float(p)) for p in params.tier_percentiles])
        rates = rates.where(F.col("value").isNotNull()).distinct()
        return rates.agg(F.array_distinct(F.percentile_approx("value", pcts, params.percentile_accuracy)).alias(BINS))
    bins = _bins_of(rates, params)
    return bins.agg(F.first(BINS).alias(BINS)) if by is None else bins.withColumnRenamed("__gid", by)


def tier_name(key: str, roles: Roles) -> str:
    names = measure_names(key, roles)
    return names["rate"].replace("_fraud_rate", "_risk_tier")


def with_risk_tier(
    profile: DataFrame,
    key: str,
    roles: Roles,
    params: Params,
    bins: DataFrame | None = None,
) -> DataFrame:
    """Profile + tier column; ``bins`` (one row) is read as a scalar subquery."""
    rate = measure_names(key, roles)["rate"]
    if bins is None:
        bins = risk_bins(profile, rate, params)
    return (
        profile.withColumn(BINS, bins.scalar())
        .withColumn(tier_name(key, roles), tier_expr(F.col(rate), F.col(BINS)))
        .drop(BINS)
    )


def tier_row_counts(profile_with_tier: DataFrame, key: str, roles: Roles) -> DataFrame:
    """Rows of the population per tier, from the profile alone (no scan of rows).

    Rows with a NULL key get no profile in the left join, so they are 'unknown'.
    """
    tier = tier_name(key, roles)
    cnt = measure_names(key, roles)["count"]
    t = F.when(F.col(key).isNull(), F.lit(UNKNOWN_TIER)).otherwise(F.col(tier))
    return profile_with_tier.groupBy(t.alias("value")).agg(F.sum(cnt).alias("n"))


def tier_labels(profile_with_tier: DataFrame, key: str, roles: Roles) -> list[str]:
    """Tier labels in one-hot slot order: row frequency descending, ties by text.

    At most five labels exist, so this collect is bounded.
    """
    rows = tier_row_counts(profile_with_tier, key, roles).collect()
    return [r["value"] for r in sorted(rows, key=lambda r: (-r["n"], r["value"]))]


def tier_onehot_columns(key: str, roles: Roles, labels: list[str]) -> list:
    """0/1 columns ``<tier>_enc_<i>`` (one slot per label, as index+one-hot with keep)."""
    tier = tier_name(key, roles)
    v = F.coalesce(F.col(tier), F.lit(UNKNOWN_TIER))
    return [
        F.when(v == F.lit(lab), 1.0).otherwise(0.0).alias(f"{tier}_enc_{i}") for i, lab in enumerate(labels)
    ]


def tier_slots(key: str, roles: Roles, labels: list[str]) -> dict:
    """``<tier>_enc`` for ``slots.add_slots``; a row without a tier is 'unknown'."""
    tier = tier_name(key, roles)
    return {f"{tier}_enc": (F.coalesce(F.col(tier), F.lit(UNKNOWN_TIER)), labels)}


def tier_population(stats, roles: Roles, params: Params):
    """Tiers of every entity of every id from the one population aggregate.

    Bins of all ids come from one set of passes over the distinct (id, rate) pairs
    (``percentiles``).  The bins table has one row per id (bounded) and is
    broadcast; tiers are one projection; the tier labels of all ids are one small
    aggregate.

    Returns ({id: profile with tier column}, {id: tier labels in slot order}).
    """
    ids = list(stats.ids)
    if not ids:
        return {}, {}
    gids = {k: stats.gid[k] for k in ids}
    table = stats.table.where(F.col("__gid").isin(list(gids.values())))
    bins = _bins_of(table.select(F.col("__gid").cast("long").alias("group"), F.col("__rate").alias("value")), params)
    tiered = (
        table.join(F.broadcast(bins), on="__gid", how="left")
        .withColumn("__tier", tier_expr(F.col("__rate"), F.col(BINS)))
        .withColumnRenamed(BINS, ROW_BINS)
    )
    if params.own_label:
        tiered = tiered.drop(ROW_BINS)
    # one row per entity, always checkpointed (small): the band joins several
    # profiles cut from this one table, and repeated references to a cached
    # plan can be re-instantiated by the analyzer and miss the cache, while a
    # checkpointed relation is always read back, never recomputed.
    tiered = checkpoint(tiered)
    value = F.when(stats.key_is_null(), F.lit(UNKNOWN_TIER)).otherwise(F.col("__tier"))
    rows = tiered.groupBy("__gid", value.alias("value")).agg(F.sum("__count").alias("n")).collect()
    by_gid: dict[int, list] = {}
    for r in rows:
        by_gid.setdefault(r["__gid"], []).append(r)
    labels = {
        k: [r["value"] for r in sorted(by_gid.get(gids[k], []), key=lambda r: (-r["n"], r["value"]))] for k in ids
    }
    # without the row's own label, each row gets the tier of its own rate (the edges come along)
    edges = [] if params.own_label else [F.col(ROW_BINS)]
    profiles = {
        k: stats.profile(k, tiered, extra=[F.col("__tier").alias(tier_name(k, roles)), *edges]) for k in ids
    }
    return profiles, labels
