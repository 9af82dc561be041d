"""Frequent patterns among flagged rows (A16) and their rule conditions.

A pattern is a combination of the amount bucket and the values of the mining
features, seen on at least ``min_support`` flagged rows.  All buckets are
mined in one grouping (the bucket is a grouping key), so a pattern always
belongs to the bucket its rows are in.  ``mine_patterns`` groups by all features at
once; ``mine_lattice`` also mines their subsets.

Rule conditions are built as columns, never by parsing text:
* a NULL value, or -1 in a numeric column, puts no condition on the feature
  (wildcard);
* the interval score gets ``lo <= x < hi`` with ``lo = round(max(0, v - w), 3)``
  and ``hi = round(min(1, v + w), 3)``;
* other numeric and boolean values give an equality, strings a quoted one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import fmt3, quote_literal
from ..functions.joins import checkpoint
from ..roles import Params, Roles, is_numeric
from .bands import BUCKET, amount_bounds

LO = "score_lo"
HI = "score_hi"
MASK = "mask"
RULE_ID = "rule_id"

CONDITION = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
    ]
)


def is_interval(feature: str, dtype: T.DataType, roles: Roles) -> bool:
    return feature == roles.interval_score and is_numeric(dtype)


def on_grid(score: Column, params: Params) -> Column:
    """The score rounded to steps of the interval's width (2 x half-width), or to
    ``Params.score_decimals``."""
    d = params.score_grid_decimals
    if d is not None:
        return F.round(score, d)
    step = F.lit(2.0 * params.score_half_width)
    return F.round(F.round(score / step) * step, 6)


def mine_patterns(
    rows: DataFrame, flagged: Column, features: Sequence[str], roles: Roles, params: Params
) -> DataFrame:
    """``amount_bucket, <features>, support`` with support >= min_support.

    The interval score is grouped on its value rounded to the grid of the
    rule interval (``on_grid``, steps of twice the half-width): continuous
    scores would otherwise almost never repeat 50 times, and each pattern's rows
    then lie inside its own rule interval.
    """
    keys = [F.col(BUCKET)]
    for f in features:
        if is_interval(f, rows.schema[f].dataType, roles):
            keys.append(on_grid(F.col(f), params).alias(f))
        else:
            keys.append(F.col(f))
    return (
        rows.where(flagged & F.col(BUCKET).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("support"))
        .where(F.col("support") >= F.lit(params.min_support))
    )


def _lattice_rows(rows: DataFrame, flagged: Column, features: Sequence[str], roles: Roles, params: Params) -> DataFrame:
    """Flagged rows with the mining values that can be bound; others are NULL."""
    cols = []
    for f in features:
        dtype = rows.schema[f].dataType
        v = on_grid(F.col(f), params) if is_interval(f, dtype, roles) else F.col(f)
        cols.append(F.when(_bound(v, dtype), v).alias(f))
    return rows.where(flagged & F.col(BUCKET).isNotNull()).select(BUCKET, *cols)


def _n_bound(features: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in features])


def _level(cells: DataFrame, sets: Sequence[tuple[str, ...]], features: Sequence[str], params: Params) -> DataFrame:
    """Frequent patterns of some column sets of one size, in one GROUPING SETS pass.

    A group counts if it binds all columns of its set; its other columns are NULL."""
    size = len(sets[0])
    grouped = cells.groupingSets([[BUCKET, *s] for s in sets], BUCKET, *features).agg(F.sum("__n").alias("support"))
    kept = grouped.where((F.col("support") >= F.lit(params.min_support)) & (_n_bound(features) == F.lit(size)))
    return checkpoint(kept.select(BUCKET, *features, "support"))


def _only_frequent(cells: DataFrame, frequent: DataFrame, features: Sequence[str], n_values: dict[str, int], params: Params) -> DataFrame:
    """Cells whose values that are not frequent alone are NULL, summed up again."""
    for f in features:
        held = frequent.where(F.col(f).isNotNull()).select(BUCKET, f, F.lit(True).alias("__held"))
        held = F.broadcast(held) if n_values[f] <= params.max_broadcast_rows else held
        cells = cells.join(held, [BUCKET, f], "left").withColumn(f, F.when(F.col("__held"), F.col(f))).drop("__held")
    return checkpoint(cells.groupBy(BUCKET, *features).agg(F.sum("__n").alias("__n")))


def mine_lattice(
    rows: DataFrame, flagged: Column, features: Sequence[str], roles: Roles, params: Params, *, maximal: bool = False
) -> DataFrame:
    """``amount_bucket, <features>, support``: frequent patterns over every subset
    of the features (at least one), level by level.

    A pattern binds the columns of its subset; the others are NULL, which is the
    wildcard of ``rule_conditions``.  A column such as an id, whose values do not
    repeat, therefore does not empty the result.  Support cannot grow with more
    columns, which prunes twice: values that are not frequent alone become NULL
    after the first level (so the rows collapse to few cells), and a column set is
    tried only if all its subsets of the level before hold a frequent pattern.  Each
    level is one GROUPING SETS pass over the cells, the first one over the flagged
    rows.  ``maximal`` keeps the patterns that no frequent pattern extends.
    """
    features = list(features)
    empty = _lattice_rows(rows, flagged, features, roles, params).limit(0).withColumn("support", F.lit(0).cast("long"))
    if not features:
        return empty
    base = _lattice_rows(rows, flagged, features, roles, params).withColumn("__n", F.lit(1).cast("long"))
    levels = [_level(base, [(f,) for f in features], features, params)]
    values = levels[0].agg(*[F.count(f).alias(f) for f in features]).first().asDict()
    alive = [f for f in features if values[f]]
    found = {(f,) for f in alive}
    cells = None
    while found and len(levels) < len(alive):
        size = len(levels) + 1
        wanted = [s for s in combinations(alive, size) if all(t in found for t in combinations(s, size - 1))]
        if not wanted:
            break
        if cells is None:
            cells = _only_frequent(base.select(BUCKET, *alive, "__n"), levels[0], alive, values, params)
        levels.append(_level(cells, wanted, alive, params))
        # column sets with a frequent pattern: at most one row per set tried
        held = levels[-1].select(*[F.col(f).isNotNull().alias(f) for f in alive]).distinct().collect()
        found = {tuple(f for f in alive if r[f]) for r in held}
    missing = {f: F.lit(None).cast(empty.schema[f].dataType) for f in features}
    whole = [d.select(BUCKET, *[F.col(f) if f in d.columns else missing[f].alias(f) for f in features], "support") for d in levels]
    out = reduce(lambda a, b: a.unionByName(b), whole)
    return _maximal(out, features) if maximal else out


def _maximal(patterns: DataFrame, features: Sequence[str]) -> DataFrame:
    """Patterns that no other one extends.  If any does, one with a single further
    column does, so each pattern names those with one column less."""
    key = [BUCKET, *features]
    less = [F.when(F.col(f).isNotNull(), F.struct(BUCKET, *[(F.lit(None).cast(patterns.schema[g].dataType) if g == f else F.col(g)).alias(g) for g in features])) for f in features]
    shorter = patterns.select(F.explode(F.filter(F.array(*less), lambda s: s.isNotNull())).alias("s")).select("s.*")
    shorter = shorter.select(rule_key(key).alias("__short")).distinct()
    keyed = patterns.withColumn("__key", rule_key(key))
    return keyed.join(shorter, F.col("__key") == F.col("__short"), "left_anti").drop("__key")


def _bound(v: Column, dtype: T.DataType) -> Column:
    if is_numeric(dtype):
        return v.isNotNull() & (v != F.lit(-1))
    return v.isNotNull()


def amount_text(roles: Roles, params: Params) -> Column:
    """Rendered amount condition of each bucket (fixed per parameters)."""
    a = f"event.{roles.amount}"
    texts = []
    for b in range(len(params.amount_thresholds) + 1):
        lo, hi = amount_bounds(params, b)
        parts = []
        if lo is not None:
            parts.append(f"{a} > {lo!r}")
        if hi is not None:
            parts.append(f"{a} <= {hi!r}")
        texts.append(" AND ".join(parts))
    return F.element_at(F.array(*[F.lit(t) for t in texts]), F.col(BUCKET) + 1)


def rule_key(names: Sequence[str]) -> Column:
    """Key of a pattern: a digest of its values, each marked as NULL or written
    with its length, so that no two patterns share a text."""
    parts = []
    for f in names:
        v = F.col(f).cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat_ws("|", *parts), 256)


def rule_conditions(patterns: DataFrame, features: Sequence[str], roles: Roles, params: Params) -> DataFrame:
    """Patterns + ``rule_id, amount_lo, amount_hi, score_lo, score_hi, mask,
    conditions, rule_string``."""
    t = params.amount_thresholds
    lo_arr = F.array(F.lit(None).cast("double"), *[F.lit(float(x)) for x in t])
    hi_arr = F.array(*[F.lit(float(x)) for x in t], F.lit(None).cast("double"))
    conds, texts = [], []
    mask = F.lit(0)
    score_lo = F.lit(None).cast("double")
    score_hi = F.lit(None).cast("double")
    for i, f in enumerate(features):
        dtype = patterns.schema[f].dataType
        v = F.col(f)
        bound = _bound(v, dtype)
        mask = mask + F.when(bound, F.lit(1 << i)).otherwise(F.lit(0))
        name = f"event.{f}"
        if is_interval(f, dtype, roles):
            w = float(params.score_half_width)
            lo = F.round(F.greatest(F.lit(0.0), v - F.lit(w)), 3)
            hi = F.round(F.least(F.lit(1.0), v + F.lit(w)), 3)
            score_lo = F.when(bound, lo)
            score_hi = F.when(bound, hi)
            cond = F.struct(F.lit(f), F.lit("range"), F.lit(None).cast("string"), lo, hi)
            text = F.concat(F.lit(f"{name} >= "), fmt3(lo), F.lit(f" AND {name} < "), fmt3(hi))
        elif is_numeric(dtype) or isinstance(dtype, T.BooleanType):
            cond = F.struct(F.lit(f), F.lit("="), v.cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"))
            text = F.concat(F.lit(f"{name} = "), v.cast("string"))
        else:
            cond = F.struct(F.lit(f), F.lit("="), v.cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"))
            text = F.concat(F.lit(f"{name} = "), quote_literal(v.cast("string")))
        conds.append(F.when(bound, cond.cast(CONDITION)))
        texts.append(F.when(bound, text))
    conditions = F.filter(F.array(*conds), lambda c: c.isNotNull()) if conds else F.array().cast(T.ArrayType(CONDITION))
    rule_string = F.array_join(F.array(amount_text(roles, params), *texts), " AND ")
    return patterns.select(
        rule_key([BUCKET, *features]).alias(RULE_ID),
        "*",
        F.element_at(lo_arr, F.col(BUCKET) + 1).alias("amount_lo"),
        F.element_at(hi_arr, F.col(BUCKET) + 1).alias("amount_hi"),
        score_lo.alias(LO),
        score_hi.alias(HI),
        mask.alias(MASK),
        conditions.alias("conditions"),
        rule_string.alias("rule_string"),
    )
