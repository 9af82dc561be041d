"""Rule evaluation (J7, A17-A20), precision gate (P11) and ranking (O1).

Every rule is measured over ALL rows of the band (not only flagged rows), which
are first aggregated once to cells of equal bucket and bound mining values.
Matching is one join of cells and rules, whatever the number of rules and of
wildcard masks:

* a cell has an atom (feature, value) for each bound feature; the interval score's
  value is a bin number ``floor(x / w)``;
* a rule is filed under its rarest atom, the one that the fewest cells hold (a rule
  without any bound feature is filed under its bucket alone).  An interval is filed
  under the few bins it spans; a cell lies in one bin, and ``floor(x / w)`` is
  monotone in x, so no match is lost and none is doubled;
* cells meet the rules filed under their atoms in one equi-join on the bucket and
  the atom; the rest of a rule's conditions is the join's residual test.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import money_again, money_parts, money_sum, money_total
from ..functions.joins import checkpoint
from ..functions.rank import global_rank
from ..roles import Params, Roles
from .bands import BUCKET
from .patterns import HI, LO, MASK, RULE_ID, is_interval

BIN = "__bin"


def bin_width(params: Params) -> float:
    return float(params.score_half_width) if params.score_half_width > 0 else 0.05


def mask_counts(rules: DataFrame) -> dict[int, int]:
    """Rules per wildcard mask, in one small job (at most 2^features rows)."""
    return {r[MASK]: r["n"] for r in rules.groupBy(MASK).agg(F.count(F.lit(1)).alias("n")).collect()}


def masks_of(rules: DataFrame) -> list[int]:
    return sorted(mask_counts(rules))


def bound_features(mask: int, features: Sequence[str]) -> list[str]:
    return [f for i, f in enumerate(features) if mask >> i & 1]


def any_bound(masks: Iterable[int], features: Sequence[str]) -> list[str]:
    """Features that at least one of the masks binds."""
    return bound_features(reduce(lambda a, b: a | b, masks, 0), features)


def _in_mask(i: int) -> Column:
    return F.col(MASK).bitwiseAND(F.lit(1 << i)) != 0


def _atom(i: int, values: Column) -> Column:
    return F.struct(F.lit(i).alias("f"), values.alias("v"))


def _cell_atoms(features: Sequence[str], interval: str | None, bound: Sequence[str]) -> Column:
    """The atoms of a cell; number -1 holds for every cell."""
    atoms = [_atom(-1, F.lit(""))]
    for i, f in enumerate(features):
        if f in bound:
            v = F.col(BIN) if f == interval else F.col(f)
            atoms.append(F.when(v.isNotNull(), _atom(i, v.cast("string"))))
    return F.filter(F.array(*atoms), lambda a: a.isNotNull())


def _rule_atoms(rules: DataFrame, features: Sequence[str], interval: str | None, bound: Sequence[str], params: Params) -> DataFrame:
    """``rule_id, amount_bucket, f, v``: a row per atom under which a rule may be filed."""
    atoms = [F.when(F.col(MASK) == 0, _atom(-1, F.array(F.lit(""))))]
    w = bin_width(params)
    for i, f in enumerate(features):
        if f in bound:
            if f == interval:
                bins = F.sequence(F.floor(F.col(LO) / F.lit(w)), F.floor(F.col(HI) / F.lit(w)))
                values = F.transform(bins, lambda x: x.cast("string"))
            else:
                values = F.array(F.col(f).cast("string"))
            atoms.append(F.when(_in_mask(i), _atom(i, values)))
    each = rules.select(RULE_ID, BUCKET, F.explode(F.filter(F.array(*atoms), lambda a: a.isNotNull())).alias("atom"))
    return each.select(RULE_ID, BUCKET, F.col("atom.f").alias("f"), F.explode("atom.v").alias("v"))


def _filed(rules: DataFrame, atoms: DataFrame, cell_atoms: DataFrame, small: bool) -> DataFrame:
    """``rule_id, f, v``: the places of each rule, those of its rarest atom.

    Only atoms that some rule holds are counted."""
    mark = F.broadcast if small else (lambda d: d)
    wanted = atoms.select(BUCKET, "f", "v").distinct()
    counts = cell_atoms.join(mark(wanted), [BUCKET, "f", "v"], "left_semi").groupBy(BUCKET, "f", "v").agg(F.count(F.lit(1)).alias("cells"))
    held = atoms.join(mark(counts), [BUCKET, "f", "v"], "left")
    per_atom = held.groupBy(RULE_ID, "f").agg(F.sum(F.coalesce("cells", F.lit(0))).alias("cells"), F.collect_set("v").alias("vs"))
    best = per_atom.groupBy(RULE_ID).agg(F.min_by(F.struct("f", "vs"), F.struct("cells", "f")).alias("best"))
    return best.select(RULE_ID, F.col("best.f").alias("f"), F.explode("best.vs").alias("v"))


def _residual(features: Sequence[str], interval: str | None, bound: Sequence[str]) -> Column:
    """The conditions of a rule (columns ``__r_...``) on a cell."""
    cond = F.lit(True)
    for i, f in enumerate(features):
        if f not in bound:
            continue
        if f == interval:
            hit = (F.col(f) >= F.col("__r_lo")) & (F.col(f) < F.col("__r_hi"))
        else:
            hit = F.col(f) == F.col(f"__r_{f}")
        cond = cond & (~_in_mask(i) | F.coalesce(hit, F.lit(False)))
    return cond


def interval_feature(rows: DataFrame, features: Sequence[str], roles: Roles) -> str | None:
    for f in features:
        if is_interval(f, rows.schema[f].dataType, roles):
            return f
    return None


def with_bin(rows: DataFrame, interval: str | None, params: Params) -> DataFrame:
    if interval is None:
        return rows
    return rows.withColumn(BIN, F.floor(F.col(interval) / F.lit(bin_width(params))))


def match_rules(
    rows: DataFrame,
    rules: DataFrame,
    features: Sequence[str],
    roles: Roles,
    params: Params,
    *,
    keep: Sequence[str] = (),
    masks: dict[int, int] | None = None,
) -> DataFrame:
    """``rule_id, <keep>`` for every (row or cell, rule) match."""
    masks = mask_counts(rules) if masks is None else masks
    if not masks:
        return rows.limit(0).select(F.lit(None).cast("string").alias(RULE_ID), *keep)
    bound = any_bound(masks, features)
    interval = next((f for f in bound if is_interval(f, rows.schema[f].dataType, roles)), None)
    # size check before broadcasting the rule side: an interval spans at
    # most 3 bins of width w, so each rule has at most 4 places
    small = sum(masks.values()) * 4 <= params.max_broadcast_rows
    mark = F.broadcast if small else (lambda d: d)
    base = with_bin(rows.select(*dict.fromkeys([BUCKET, *bound, *keep])), interval, params)
    base = base.withColumn("__atom", F.explode(_cell_atoms(features, interval, bound)))
    base = base.withColumns({"__f": F.col("__atom.f"), "__v": F.col("__atom.v")}).drop("__atom")
    atoms = _rule_atoms(rules, features, interval, bound, params)
    places = _filed(rules, atoms, base.select(BUCKET, F.col("__f").alias("f"), F.col("__v").alias("v")), small)
    cols = [F.col(RULE_ID), F.col(MASK), F.col(BUCKET).alias("__r_bucket")]
    cols += [F.col(f).alias(f"__r_{f}") for f in bound if f != interval]
    if interval is not None:
        cols += [F.col(LO).alias("__r_lo"), F.col(HI).alias("__r_hi")]
    side = rules.select(*cols).join(mark(places.withColumnRenamed("f", "__r_f").withColumnRenamed("v", "__r_v")), RULE_ID)
    on = (F.col(BUCKET) == F.col("__r_bucket")) & (F.col("__f") == F.col("__r_f")) & (F.col("__v") == F.col("__r_v"))
    return base.join(mark(side), on & _residual(features, interval, bound)).select(RULE_ID, *keep)


def fraud_amount(roles: Roles) -> Column:
    return F.when(F.col(roles.label) == 1, F.col(roles.amount)).otherwise(F.lit(0.0))


def total_fraud_amount(rows: DataFrame, roles: Roles) -> DataFrame:
    """One row: fraud amount of all rows (computed once, not per rule)."""
    return rows.agg(F.coalesce(money_sum(fraud_amount(roles)), F.lit(0.0)).alias("total_fraud_amount"))


def rule_cells(rows: DataFrame, features: Sequence[str], roles: Roles) -> DataFrame:
    """The rows aggregated once to (bucket, bound mining values) cells with their
    measures.  Rules see only these columns, so a cell matches as its rows do;
    rules then scan cells, not rows, and a frequent value is one cell.
    Checkpointed: the atom counts and the join read it."""
    cells = rows.where(F.col(BUCKET).isNotNull()).groupBy(BUCKET, *features).agg(
        F.count(F.lit(1)).alias("__cell_n"),
        F.sum(F.col(roles.label).cast("int")).alias("__cell_frauds"),
        *money_parts(fraud_amount(roles), "__cell"),
    )
    return checkpoint(cells)


def evaluate_rules(
    rows: DataFrame, rules: DataFrame, features: Sequence[str], roles: Roles, params: Params, *, masks: dict[int, int] | None = None
) -> DataFrame:
    """Rules + num_transactions, num_frauds, captured_fraud_amount, precision, amount_recall.

    ``rules`` should be persisted by the caller: it is read by the mask job,
    the rule index and the final projection.
    """
    masks = mask_counts(rules) if masks is None else masks
    # values that no rule binds do not split cells; without rules one empty cell list is enough
    cells = rule_cells(rows if masks else rows.limit(0), any_bound(masks, features), roles)
    measures = [c for c in cells.columns if c.startswith("__cell")]
    matches = match_rules(cells, rules, features, roles, params, keep=measures, masks=masks)
    stats = matches.groupBy(RULE_ID).agg(
        F.sum("__cell_n").alias("num_transactions"),
        F.sum("__cell_frauds").cast("long").alias("num_frauds"),
        *money_again("__cell"),
    ).withColumn("captured_fraud_amount", money_total("__cell"))
    total = total_fraud_amount(rows, roles)
    out = (
        # one row per rule on both sides; the rule count is known (mask job)
        rules.join(F.broadcast(stats) if sum(masks.values()) <= params.max_broadcast_rows else stats, on=RULE_ID, how="left")
        .withColumn("total_fraud_amount", total.scalar())
        .select(
            *[F.col(c) for c in rules.columns],
            F.coalesce(F.col("num_transactions"), F.lit(0)).cast("long").alias("num_transactions"),
            F.coalesce(F.col("num_frauds"), F.lit(0)).cast("long").alias("num_frauds"),
            F.coalesce(F.col("captured_fraud_amount"), F.lit(0.0)).alias("captured_fraud_amount"),
            "total_fraud_amount",
        )
    )
    return out.withColumns(
        {
            "precision": F.coalesce(F.try_divide(F.col("num_frauds").cast("double"), F.col("num_transactions").cast("double")), F.lit(0.0)),
            "amount_recall": F.when(
                F.col("total_fraud_amount") > 0, F.col("captured_fraud_amount") / F.col("total_fraud_amount")
            ).otherwise(F.lit(0.0)),
        }
    ).drop("total_fraud_amount")


def keep_precise(evaluated: DataFrame, params: Params) -> DataFrame:
    return evaluated.where(F.col("precision") >= F.lit(float(params.target_precision)))


def rank_order(features: Sequence[str]) -> list[Column]:
    """Recall descending, then a total tie-break on the pattern itself."""
    return [F.desc("amount_recall"), F.asc(BUCKET), *[F.asc_nulls_first(f) for f in features]]


def rank_rules(kept: DataFrame, features: Sequence[str], n_rules: int | None = None) -> DataFrame:
    """``rank`` by ``rank_order``; ``n_rules`` (an upper bound, e.g. the rule
    count from the mask job) sizes the range partitions."""
    return global_rank(kept, rank_order(features), "rank", rows_hint=n_rules)
