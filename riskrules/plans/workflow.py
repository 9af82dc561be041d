"""The whole method as one composition (W1): profile -> tier -> encode ->
band -> train -> score -> mine -> evaluate -> rank -> choose.

Everything the profiles, tiers and encoders learn is learned on the whole
population; the score band is applied to the rows before the joins so only
band rows are joined, shuffled and scored.  The band is materialised once
(checkpoint in ``spark.checkpoint.dir`` by default) before the tree, and the
scored band once before mining, so the many passes of training, mining and
rule evaluation never replay the profile joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import Budget, materialize, partitions_by_rows
from ..operators.bands import BUCKET, amount_flag_columns, score_band, with_amount_bucket
from ..operators.encode import attach_frequency, category_slots, fill_sentinel, frequency_table, plan_encoding
from ..operators.model import confident, feature_ranking, model_inputs, score, train
from ..operators.patterns import mine_lattice, mine_patterns, rule_conditions
from ..operators.profiles import PopulationStats, attach_profile, measure_names, profile_columns, with_cross_border
from ..operators.rules import evaluate_rules, keep_precise, mask_counts, rank_rules
from ..operators.ruleset import choose, combined_rule, metrics, union_metrics
from ..operators.slots import INDEX, Slot, add_slot_places, input_slots, slots_of_places
from ..operators.tiers import tier_name, tier_population, tier_slots
from ..roles import Params, Roles, is_numeric


@dataclass
class Prepared:
    band: DataFrame
    inputs: list[str]
    source_of: dict[str, str]
    # the places of the model's vector, in order (several for a one-hot vector)
    slots: list[Slot] = field(default_factory=list)
    profiles: dict[str, DataFrame] = field(default_factory=dict)
    counts: DataFrame | None = None
    # distinct values per id / categorical column (NULL counts as one)
    cardinality: dict[str, int] = field(default_factory=dict)


@dataclass
class MiningResult:
    model: PipelineModel
    ranking: DataFrame
    features: list[str]
    left_out: list[str]
    scored: DataFrame
    patterns: DataFrame
    rules: DataFrame
    selected: DataFrame
    combined_rule: DataFrame
    metrics: DataFrame
    union_metrics: DataFrame


def _quoted(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


@dataclass
class KeyedJoin:
    """A table to join on to the band: whether it is broadcast, the columns it adds, and the
    join ``(rows, params, partitions)``."""

    broadcast: bool
    adds: list[str]
    join: Callable[[DataFrame, Params, int | None], DataFrame]


def join_profile(prof: DataFrame, key: str, roles: Roles, params: Params, size: tuple[int, int], budget: Budget) -> KeyedJoin:
    fits = budget.takes(*size, params)

    def join(rows: DataFrame, params: Params, partitions: int | None) -> DataFrame:
        # what was decided for all tables in their order holds
        own = Budget(size[1] if fits else 0)
        return attach_profile(rows, prof, key, roles, params, keyed_size=size, budget=own, partitions=partitions)

    return KeyedJoin(fits, profile_columns(prof, key), join)


def join_frequency(counts: DataFrame, feature: str, params: Params, size: tuple[int, int], budget: Budget) -> KeyedJoin:
    fits = budget.takes(*size, params)

    def join(rows: DataFrame, params: Params, partitions: int | None) -> DataFrame:
        own = Budget(size[1] if fits else 0)
        return attach_frequency(rows, counts, feature, params, size=lambda _: size, budget=own, partitions=partitions)

    return KeyedJoin(fits, [f"{feature}_freq"], join)


def join_all(band: DataFrame, joins: Sequence[KeyedJoin], rows: int, params: Params) -> DataFrame:
    """``band``, rows of a population of ``rows``, with all tables joined on to it, in
    partitions that do not grow with the rows.

    Tables that are not broadcast come first, the narrowest before the others, so the rows
    are shuffled before they are wide; the last of these joins deals them into the
    partitions, hot keys split by the same number.  Without such a join the rows are
    dealt before they are joined.  Few rows are joined as they lie."""
    n = partitions_by_rows(band.sparkSession, rows, params)
    by_key = sorted((j for j in joins if not j.broadcast), key=lambda j: len(j.adds))
    if n is not None and not by_key:
        band = band.repartition(n)
    dealt = params if n is None else params.with_(rows_per_task=min(params.rows_per_task, params.rows_per_partition))
    for i, j in enumerate(by_key, 1):
        band = j.join(band, dealt, n) if i == len(by_key) else j.join(band, params, None)
    for j in joins:
        if j.broadcast:
            band = j.join(band, params, None)
    return band


def preprocess(
    df: DataFrame, roles: Roles, params: Params, *, profile_df: DataFrame | None = None, columns: Sequence[str] | None = None
) -> Prepared:
    """Band rows with every model input attached.

    ``profile_df`` (optional) is the population profiles, tiers and encoders
    are learned on; by default the rows themselves (as the method does, which
    lets a row's own label reach its profile).  ``columns`` (optional) are the
    columns wanted beside the label, the amount bucket and the model inputs; by
    default all are kept.
    """
    roles.check(df)
    if profile_df is not None and not params.own_label:
        raise ValueError("own_label=False takes a row's label off its own population; profile_df is another one")
    pop = profile_df if profile_df is not None else df
    if roles.issuer in roles.ids:
        df = with_cross_border(df, roles)
        pop = with_cross_border(pop, roles)
    source_of: dict[str, str] = {}
    profiles: dict[str, DataFrame] = {}
    # all profiles and category counts in one pass over the population
    stats = PopulationStats(pop, roles, params, roles.categoricals) if (roles.ids or roles.categoricals) else None
    # one small job: every id's and categorical's cardinality (also the size
    # checks of the profile joins)
    card: dict[str, int] = stats.cardinalities() if stats is not None else {}
    # tiers of every entity of every id in one plan, labels in one small job
    profiles, tiers = tier_population(stats, roles, params) if roles.ids else ({}, {})
    for key, prof in profiles.items():
        for c in profile_columns(prof, key):
            if not c.startswith("__"):
                source_of[c] = key
    counts = None
    onehot: dict[str, list[str]] = {}
    freq: list[str] = []
    if roles.categoricals:
        counts = stats.counts
        onehot, freq = plan_encoding(counts, roles.categoricals, params, card)

    # all keyed tables of the band's plan are held at once, so they share one budget
    budget = Budget(params.max_broadcast_bytes)
    joins: list[KeyedJoin] = []
    # one sparse vector per tier and one-hot source, made of places that are stored
    vectors: dict[str, tuple[Column, Sequence[str]]] = {}
    for i in range(len(params.amount_thresholds) + 1):
        source_of[f"amount_range_{i}"] = roles.amount
    shown: list[str] = []
    for key, prof in profiles.items():
        shown += [c for c in profile_columns(prof, key) if not c.startswith("__")]
        if key in freq and key in stats.by_id and df.schema[key].dataType == pop.schema[key].dataType:
            # the id's own count is the category's: one join for both
            prof = prof.withColumn(f"{key}_freq", F.col(measure_names(key, roles)["count"]) / F.lit(stats.rows()))
        joins.append(join_profile(prof, key, roles, params, stats.size(key, prof), budget))
        tier = tier_slots(key, roles, tiers[key])
        vectors.update(tier)
        source_of.update({v: tier_name(key, roles) for v in tier})
    for f, labels in onehot.items():
        vec = category_slots(f, labels)
        vectors.update(vec)
        source_of.update({v: f for v in vec})
    for f in freq:
        if not any(f"{f}_freq" in j.adds for j in joins):
            joins.append(join_frequency(counts, f, params, stats.size(f, frequency_table(counts, f), categorical=True), budget))
        shown.append(f"{f}_freq")
        source_of[f"{f}_freq"] = f
    # a learned population may be another one than the rows
    rows = stats.rows() if stats is not None and profile_df is None else score_band(df, roles, params).count()
    band = with_amount_bucket(join_all(score_band(df, roles, params), joins, rows, params), roles, params)
    # as if every id had been joined in turn, which puts it first
    ids = list(profiles)[::-1]
    own = [*ids, *[c for c in df.columns if c not in ids], *[c for c in band.columns if c == BUCKET and c not in df.columns]]
    coded = add_slot_places(band.select(*[_quoted(c) for c in (*own, *shown)]), vectors)

    def whole(stored: DataFrame) -> DataFrame:
        """A stored row with what is derived from it alone: amount flags and vectors."""
        at = [c for c in own if c in stored.columns]
        rest = [c for c in stored.columns if c not in own]
        flags = amount_flag_columns(params)
        return slots_of_places(stored.select(*[_quoted(c) for c in at], *flags, *[_quoted(c) for c in rest]), vectors)

    shape = whole(coded)
    inputs = model_inputs(shape, roles, params)
    slots = input_slots(shape, inputs)
    coded = fill_sentinel(coded, [c for c in inputs if c in coded.columns])
    if columns is not None:
        wanted = {roles.label, BUCKET, *inputs, *columns}
        coded = coded.select(*[_quoted(c) for c in coded.columns if c in wanted or c.startswith(INDEX)])
    band = whole(materialize(coded, params))
    if stats is not None and params.materialize == "checkpoint":
        # the band no longer depends on the population aggregate
        stats.unpersist()
    return Prepared(band=band, inputs=inputs, source_of=source_of, slots=slots, profiles=profiles, counts=counts, cardinality=card)


def mineable(df: DataFrame, name: str, roles: Roles) -> bool:
    if name not in df.columns or name in (roles.label, roles.amount, roles.score, BUCKET):
        return False
    dt = df.schema[name].dataType
    if name == roles.interval_score and is_numeric(dt):
        return True
    return isinstance(dt, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def mining_features(
    ranked_inputs: Sequence[tuple[str, float]],
    source_of: dict[str, str],
    scored: DataFrame,
    roles: Roles,
    params: Params,
    cardinality: dict[str, int] | None = None,
) -> tuple[list[str], list[str]]:
    """Columns to mine, and those left out.

    Importances are summed per source column (one-hot slots fold back onto their
    column, tier slots onto the tier); the top ``top_features`` sources with
    non-zero importance are wanted.  Of them, continuous columns other than the
    interval score and columns with more than ``mining_max_values`` values are
    left out and listed: equality on them rarely repeats ``min_support`` times.
    """
    card, most = cardinality or {}, params.mining_max_values
    total: dict[str, float] = {}
    for name, imp in ranked_inputs:
        src = source_of.get(name, name)
        total[src] = total.get(src, 0.0) + imp
    ranked = sorted(total, key=lambda s: (-total[s], s))[: params.top_features]
    wanted = [s for s in ranked if total[s] > 0 or params.keep_zero_importance]
    mined = [s for s in wanted if mineable(scored, s, roles) and (most is None or card.get(s, 0) <= most)]
    return mined, [s for s in wanted if s not in mined]


def extract_rules(
    scored: DataFrame, features: Sequence[str], roles: Roles, params: Params, *, flagged: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Patterns among the confident rows of a scored frame, and the precise rules
    they give, ranked.  ``scored`` comes from ``score`` of a fitted model; another
    ``target_precision`` needs only this step.  With ``Params.mine_subsets`` the
    patterns are the maximal frequent ones over all subsets of the features."""
    if flagged is None and "prediction" not in scored.columns:
        raise ValueError("score the rows with a trained model first, or say which rows are flagged")
    flagged = flagged if flagged is not None else confident(params)
    if params.mine_subsets:
        patterns = mine_lattice(scored, flagged, features, roles, params, maximal=True)
    else:
        patterns = mine_patterns(scored, flagged, features, roles, params)
    rules = rule_conditions(patterns, features, roles, params).persist(StorageLevel.MEMORY_AND_DISK)
    masks = mask_counts(rules)
    evaluated = evaluate_rules(scored, rules, features, roles, params, masks=masks).persist(StorageLevel.MEMORY_AND_DISK)
    kept = keep_precise(evaluated, params)
    return patterns, rank_rules(kept, features, sum(masks.values())).persist(StorageLevel.MEMORY_AND_DISK)


def mine_rules(
    df: DataFrame,
    roles: Roles,
    params: Params | None = None,
    *,
    features: Sequence[str] | None = None,
    flagged: Column | None = None,
    profile_df: DataFrame | None = None,
) -> MiningResult:
    params = params or Params()
    spark = df.sparkSession
    prep = preprocess(df, roles, params, profile_df=profile_df)
    model = train(prep.band, prep.inputs, roles, params)
    ranking = feature_ranking(spark, model, prep.slots, prep.source_of)
    # the table names each slot's source already
    ranked_inputs = [(r["source"], r["importance"]) for r in sorted(ranking.collect(), key=lambda r: r["rank"])]
    scored = materialize(score(model, prep.band), params)
    feats, left_out = (list(features), []) if features is not None else mining_features(ranked_inputs, {}, scored, roles, params, prep.cardinality)
    patterns, ranked = extract_rules(scored, feats, roles, params, flagged=flagged)
    selected = choose(ranked, params)
    return MiningResult(
        model=model,
        ranking=ranking,
        features=feats,
        left_out=left_out,
        scored=scored,
        patterns=patterns,
        rules=ranked,
        selected=selected,
        combined_rule=combined_rule(selected),
        metrics=metrics(selected),
        union_metrics=union_metrics(scored, selected, feats, roles, params),
    )
