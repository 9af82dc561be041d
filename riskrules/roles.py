"""Column roles and tuning parameters.

The transaction table has no fixed schema: which columns play which part is
declared once in :class:`Roles` and checked against ``df.schema``.  Every
operator takes ``Roles`` and ``Params`` instead of hard-wired names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)


@dataclass(frozen=True)
class Roles:
    """Names of the columns that carry a meaning for rule mining."""

    label: str = "is_fraud"
    amount: str = "amount"
    # score whose grey band is studied (half-open [min_score, max_score))
    score: str = "fraud_score"
    # score that gets an interval condition instead of an equality in rules
    interval_score: str = "community_fraud_score_amount_d"
    # id columns with a dedicated profile
    merchant: str = "mch_id_trimmed"
    issuer: str = "issuer_member"
    # optional issuer measures, switched on when the columns exist
    status: str = "trans_status"
    auth_mode: str = "three_ds_mode"
    issuing_country: str = "issuer_bin_profile_issuing_cou"
    merchant_country: str = "merchant_country_code"
    categoricals: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()

    def with_(self, **kw) -> "Roles":
        return replace(self, **kw)

    def check(self, df: DataFrame) -> "Roles":
        """Fail early when a required column is missing, or when the label, the amount
        or the score is no number."""
        cols = set(df.columns)
        need = [self.label, self.amount, self.score, *self.categoricals, *self.ids]
        missing = [c for c in need if c not in cols]
        if missing:
            raise ValueError(f"columns missing from the transaction table: {missing}")
        numbers = {c: df.schema[c].dataType for c in (self.label, self.amount, self.score)}
        wrong = [f"{c} ({t.simpleString()})" for c, t in numbers.items() if not is_numeric(t)]
        if wrong:
            raise ValueError(f"columns of the transaction table that must be numbers: {wrong}")
        return self


# Fixed values of the method (they define the rules and must not drift):
# amount thresholds 3000, 10000, 25000, 50000, 100000 (six buckets, right-closed);
# tier percentiles 0, 50, 90, 95, 100 with labels low, medium, high, very_high;
# one-hot for categoricals with at most 50 distinct values, else frequency;
# tree max depth 5, at least 100 rows per node, seed 42; top 10 features;
# confidence: prediction 1 and P(fraud) >= 0.7; support >= 50 rows;
# score interval half-width 0.05 clipped to [0, 1], bounds at 3 decimals;
# band [50, 70); target precision 0.3; at most 5 rules.
AMOUNT_THRESHOLDS = (3000.0, 10000.0, 25000.0, 50000.0, 100000.0)
TIER_PERCENTILES = (0.0, 0.5, 0.9, 0.95, 1.0)
TIER_LABELS = ("low", "medium", "high", "very_high")
UNKNOWN_TIER = "unknown"


@dataclass(frozen=True)
class Params:
    min_score: float = 50.0
    max_score: float = 70.0
    target_precision: float = 0.3
    amount_thresholds: tuple[float, ...] = AMOUNT_THRESHOLDS
    tier_percentiles: tuple[float, ...] = TIER_PERCENTILES
    onehot_max_values: int = 50
    max_depth: int = 5
    min_instances_per_node: int = 100
    seed: int = 42
    top_features: int = 10
    # a caller may keep ids and categoricals with more values than this out of
    # mining (they are listed in MiningResult.left_out); None mines them whatever
    # their number, as the method does (min_support bounds the patterns)
    mining_max_values: int | None = None
    # the method's top-10 list includes zero-importance features; True keeps
    # them as mining candidates too (parity), False skips them
    keep_zero_importance: bool = False
    confidence: float = 0.7
    min_support: int = 50
    # mine the maximal frequent patterns over all subsets of the mining columns
    # (a column whose values never repeat min_support times then leaves the others
    # their patterns); False groups by all columns at once, as the method does
    mine_subsets: bool = True
    # False: the measures of a row's profile (and its tier) are learned from the other
    # rows of the entity, so that its own label does not reach its model inputs;
    # True: from all rows, as the method does
    own_label: bool = True
    score_half_width: float = 0.05
    # grid of the interval score when mining; None = the grid whose step is
    # the rule interval's width (2 x 0.05 = 0.1, one decimal), so the cell of
    # a pattern, round(x) = v, is its own rule interval [v - w, v + w)
    score_decimals: int | None = None
    max_rules: int = 5
    # accuracy of approximate bins (risk_bins(approx=True))
    percentile_accuracy: int = 100_000
    # explicit size checks before any broadcast of a data-derived table
    max_broadcast_rows: int = 2_000_000
    # bytes of all keyed tables that one plan may broadcast together
    max_broadcast_bytes: int = 512 * 1024 * 1024
    # rows one task should handle in a salted join (hot keys are split)
    rows_per_task: int = 5_000_000
    # rows of the population behind one partition of the stored band
    rows_per_partition: int = 500_000
    # at most this many hot keys are split (bounded broadcast of the key list)
    max_hot_keys: int = 100_000
    # "checkpoint" cuts lineage in spark.checkpoint.dir, "persist" caches
    materialize: str = "checkpoint"
    extra_excluded_features: tuple[str, ...] = field(default_factory=tuple)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @property
    def score_grid_decimals(self) -> int | None:
        """Decimals of the score grid; None if its step is no power of ten."""
        if self.score_decimals is not None:
            return self.score_decimals
        step = 2 * self.score_half_width
        if step <= 0:
            return 2
        d = round(-math.log10(step))
        return d if d >= 0 and math.isclose(step, 10.0**-d) else None


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType
