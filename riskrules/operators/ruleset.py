"""The final ruleset.

* ``choose``: top K rules by rank.
* ``combined_rule``: the K rule texts as one ``(r1) OR (r2) ...`` string.
* ``metrics``: the additive totals of the chosen rules (a row hit by two
  rules counts twice), as the method reports them.
* ``hits`` / ``union_metrics``: rows hit by the OR of the rules, each row once.
  Rows are looked up by cell (bucket, bound values, the interval score's segment
  between rule bounds): the rules mark the cells once, rows meet the marked cells in
  one semi join, and the metrics are sums over marked cells (no row key is needed,
  rows are never duplicated).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import money_again, money_sum, money_total
from ..functions.joins import checkpoint
from ..roles import Params, Roles
from .bands import BUCKET
from .patterns import HI, LO, MASK, RULE_ID, is_interval
from .rules import (
    BIN, any_bound, bin_width, bound_features, interval_feature, mask_counts, masks_of, match_rules, rank_order, rule_cells,
    total_fraud_amount, with_bin,
)

ROW = "__t"
SEGMENT = "__segment"


def choose(rules: DataFrame, params: Params, k: int | None = None, *, features: Sequence[str] | None = None) -> DataFrame:
    """The best ``k`` rules.  Given ``features``, unranked rules are sorted and cut
    in one top-k step (no rank of all rules); the window numbers k rows."""
    k = k or params.max_rules
    if features is None:
        return rules.where(F.col("rank") <= F.lit(k))
    order = rank_order(features)
    top = rules.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def combined_rule(selected: DataFrame) -> DataFrame:
    """One row: ``combined_rule`` (rules in rank order, each in parentheses)."""
    texts = F.array_sort(F.collect_list(F.struct("rank", "rule_string")))
    return selected.agg(
        F.array_join(
            F.transform(texts, lambda x: F.concat(F.lit("("), x["rule_string"], F.lit(")"))), " OR "
        ).alias("combined_rule")
    )


def metrics(selected: DataFrame) -> DataFrame:
    """One row of additive totals; no rule gives 0 rules and NULL averages."""
    return selected.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.avg("precision").alias("average_precision"),
        F.coalesce(money_sum("captured_fraud_amount"), F.lit(0.0)).alias("total_captured_fraud_amount"),
        F.coalesce(F.sum("num_transactions"), F.lit(0)).cast("long").alias("total_transactions"),
        F.coalesce(F.sum("num_frauds"), F.lit(0)).cast("long").alias("total_frauds"),
    )


def _segment(x: Column, bounds: Column) -> Column:
    """Number of bounds at or below x (NULL for NULL): lo <= x < hi is a range of these."""
    return F.when(x.isNotNull(), F.size(F.filter(bounds, lambda b: b <= x)))


def _by_segment(rows: DataFrame, selected: DataFrame, interval: str | None, i: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the segment of the interval score, and the rules as one row per
    segment they span, so that every condition is an equality."""
    if interval is None:
        return rows, selected
    ends = selected.select(F.explode(F.array(LO, HI)).alias("b")).where("b IS NOT NULL")
    # at most two bounds a rule, for the chosen rules: a one-row scalar subquery
    bounds = ends.agg(F.sort_array(F.collect_set("b")).alias("bounds"))
    rows = rows.withColumn("__bounds", bounds.scalar()).withColumn(SEGMENT, _segment(F.col(interval), F.col("__bounds"))).drop("__bounds")
    span = F.sequence(_segment(F.col(LO), F.col("__bounds")), _segment(F.col(HI), F.col("__bounds")) - 1)
    some = selected.withColumn("__bounds", bounds.scalar())
    has = F.col(MASK).bitwiseAND(F.lit(1 << i)) != 0
    each = F.when(has & (F.col(LO) < F.col(HI)), span).when(~has, F.array(F.lit(None).cast("int")))
    return rows, some.withColumn(SEGMENT, F.explode(each)).drop("__bounds")


def marked_cells(rows: DataFrame, selected: DataFrame, features: Sequence[str], roles: Roles, params: Params):
    """Rows with their cell key, the key's columns, and a function that keeps the
    cells (key, other columns) that some rule hits; None without rules."""
    masks = mask_counts(selected)
    if not masks:
        return None
    bound = any_bound(masks, features)
    interval = next((f for f in bound if is_interval(f, rows.schema[f].dataType, roles)), None)
    keyed, rules = _by_segment(rows, selected, interval, list(features).index(interval) if interval else 0)
    names = [SEGMENT if f == interval else f for f in features]
    keys = [BUCKET, *(n for n in names if n in bound or n == SEGMENT)]

    def hit(cells: DataFrame) -> DataFrame:
        # a rule has at most one row per segment between the bounds of all rules
        n = sum(masks.values())
        found = match_rules(cells, rules, names, roles.with_(interval_score=""), params, keep=keys, masks={**masks, 0: masks.get(0, 0) + 2 * n * n})
        return cells.join(found.select(*keys).distinct(), _same_cell(cells, found, keys), "left_semi")

    return keyed, keys, hit


def _same_cell(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hits(rows: DataFrame, selected: DataFrame, features: Sequence[str], roles: Roles, params: Params) -> DataFrame:
    """Rows matching at least one selected rule (each row at most once)."""
    if rows.isStreaming:
        return _hits_of_stream(rows, selected, features, roles, params)
    marked = marked_cells(rows, selected, features, roles, params)
    if marked is None:
        return rows.limit(0)
    keyed, keys, hit = marked
    cells = checkpoint(hit(keyed.where(F.col(BUCKET).isNotNull()).select(*keys).distinct()))
    cells = cells.select(*[F.col(f"`{k}`").alias(f"__c{i}") for i, k in enumerate(keys)])
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(keys)])
    return keyed.join(cells, on, "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])


def _hits_of_stream(rows: DataFrame, selected: DataFrame, features: Sequence[str], roles: Roles, params: Params) -> DataFrame:
    """The same for a stream, whose cells are not known: an EXISTS per wildcard mask."""
    interval = interval_feature(rows, features, roles)
    base = with_bin(rows, interval, params).alias(ROW)
    exists = []
    for m in masks_of(selected):
        alias = f"__r{m}"
        r = _rule_side(selected, m, features, interval, params).alias(alias)
        cond = F.col(f"{alias}.__r_bucket") == F.col(f"{ROW}.{BUCKET}").outer()
        for f in bound_features(m, features):
            if f == interval:
                cond = cond & (F.col(f"{alias}.__r_bin") == F.col(f"{ROW}.{BIN}").outer())
                cond = cond & (F.col(f"{ROW}.`{f}`").outer() >= F.col(f"{alias}.__r_lo"))
                cond = cond & (F.col(f"{ROW}.`{f}`").outer() < F.col(f"{alias}.__r_hi"))
            else:
                cond = cond & (F.col(f"{alias}.`__r_{f}`") == F.col(f"{ROW}.`{f}`").outer())
        exists.append(r.where(cond).exists())
    if not exists:
        return rows.where(F.lit(False))
    out = base.where(reduce(lambda a, b: a | b, exists))
    return out.select(*[F.col(f"{ROW}.`{c}`") for c in rows.columns])


def _rule_side(rules: DataFrame, mask: int, features: Sequence[str], interval: str | None, params: Params) -> DataFrame:
    bound = bound_features(mask, features)
    cols = [F.col(RULE_ID), F.col(BUCKET).alias("__r_bucket")]
    cols += [F.col(f).alias(f"__r_{f}") for f in bound if f != interval]
    r = rules.where(F.col(MASK) == F.lit(mask))
    if interval in bound:
        w = bin_width(params)
        cols += [F.col(LO).alias("__r_lo"), F.col(HI).alias("__r_hi")]
        bins = F.sequence(F.floor(F.col(LO) / F.lit(w)), F.floor(F.col(HI) / F.lit(w)))
        cols.append(F.explode(bins).alias("__r_bin"))
    return r.select(*cols)


def union_metrics(rows: DataFrame, selected: DataFrame, features: Sequence[str], roles: Roles, params: Params) -> DataFrame:
    """One row: transactions, frauds, captured amount, precision and amount
    recall of the OR of the selected rules, each row counted once."""
    marked = marked_cells(rows, selected, features, roles, params)
    if marked is None:
        agg = rows.limit(0).agg(
            F.lit(0).cast("long").alias("union_transactions"), F.lit(0).cast("long").alias("union_frauds"), F.lit(0.0).alias("union_captured_fraud_amount")
        )
    else:
        keyed, keys, hit = marked
        agg = hit(rule_cells(keyed, keys[1:], roles)).agg(
            F.sum("__cell_n").alias("n"), F.sum("__cell_frauds").alias("frauds"), *money_again("__cell")
        ).select(
            F.coalesce("n", F.lit(0)).cast("long").alias("union_transactions"),
            F.coalesce("frauds", F.lit(0)).cast("long").alias("union_frauds"),
            F.coalesce(money_total("__cell"), F.lit(0.0)).alias("union_captured_fraud_amount"),
        )
    total = total_fraud_amount(rows, roles)
    return agg.withColumn("total_fraud_amount", total.scalar()).select(
        "union_transactions",
        "union_frauds",
        "union_captured_fraud_amount",
        F.coalesce(F.try_divide(F.col("union_frauds").cast("double"), F.col("union_transactions").cast("double")), F.lit(0.0)).alias("union_precision"),
        F.when(F.col("total_fraud_amount") > 0, F.col("union_captured_fraud_amount") / F.col("total_fraud_amount"))
        .otherwise(F.lit(0.0))
        .alias("union_amount_recall"),
    )
