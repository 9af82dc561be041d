"""Registered queries over the test tables (roles mapped by ``sources.fixtures``).

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
WHOLE tables.  Where rules are mined without a model, "flagged" is the plain
condition ``cs >= 0.35`` so the result can be stated in SQL as well.
Sample standard deviations are shown at 4 decimals and percentile edges at
12 (the last bits of those depend on the order of floating additions).
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import checkpoint, checkpoint_dir
from ..operators import bands, encode, model, patterns, profiles, rules, ruleset, sketches, slots, tiers
from ..operators.bands import BUCKET
from ..roles import Params, Roles
from ..sources.conform import conform
from ..sources.fixtures import FIXTURE_ROLES, table, tx_frame
from ..sources.publish import publish, read_published
from .workflow import extract_rules, mine_rules, preprocess

R: Roles = FIXTURE_ROLES
P: Params = Params()
MCH, ISS, PART = "mch_id_trimmed", "issuer_member", "part_id"
MINING = ["cs", "card_profile_dep"]
LATTICE = ["cs", "card_profile_dep", "part_id", "ship_address_usage_ind"]
FLAG_MIN = 0.35
ONEHOT_DEMO = ["card_profile_dep", "ship_address_usage_ind"]
CATEGORICAL_CHECK = ["ship_address_usage_ind", "card_profile_dep", "bill_count", "part_id"]


def _tx(spark: SparkSession, sf: str) -> DataFrame:
    return tx_frame(spark, sf)


def _std_col(key: str) -> str:
    return profiles.measure_names(key, R)["std"]


def _profile(spark: SparkSession, sf: str, key: str) -> DataFrame:
    tx = _tx(spark, sf)
    if key == ISS:
        tx = profiles.with_cross_border(tx, R)
    return profiles.entity_profile(tx, key, R, P)


def _shown(profile: DataFrame, key: str) -> DataFrame:
    s = _std_col(key)
    return profile.withColumn(s, F.round(F.col(s), 4))


def q_tx_scan(spark, sf):
    return _tx(spark, sf)


def q_merchant_profile(spark, sf):
    return _shown(_profile(spark, sf, MCH), MCH)


def q_issuer_profile(spark, sf):
    return _shown(_profile(spark, sf, ISS), ISS)


def q_id_profile(spark, sf):
    return _shown(_profile(spark, sf, PART), PART)


def _attached(spark, sf, key):
    tx = _tx(spark, sf)
    prof = _shown(_profile(spark, sf, key), key)
    return profiles.attach_profile(tx, prof, key, R, P)


def q_attach_merchant_profile(spark, sf):
    return _attached(spark, sf, MCH)


def q_attach_issuer_profile(spark, sf):
    return _attached(spark, sf, ISS)


def q_attach_id_profile(spark, sf):
    return _attached(spark, sf, PART)


def q_attach_issuer_profile_salted(spark, sf):
    """J2 through the path taken above the broadcast limit: salted sort-merge
    join, with a per-task budget small enough that most issuers are hot."""
    tx = _tx(spark, sf)
    prof = _shown(_profile(spark, sf, ISS), ISS)
    salted = P.with_(max_broadcast_rows=0, rows_per_task=16, max_hot_keys=1_000_000)
    return profiles.attach_profile(tx, prof, ISS, R, salted).select(*tx.columns, *profiles.profile_columns(prof, ISS))


def _without_self(spark, sf, key):
    tx = _tx(spark, sf)
    prof = _shown(profiles.entity_profile(tx, key, R, P, states=True), key)
    keep = [c for c in profiles.profile_columns(prof, key) if not c.startswith(profiles.STATE)]
    return profiles.attach_profile(tx, prof, key, R, P).select(*tx.columns, *keep)


def q_attach_merchant_without_self(spark, sf):
    """J1, A1, A5-A7 learned from the other rows of the merchant."""
    return _without_self(spark, sf, MCH)


def q_attach_issuer_without_self(spark, sf):
    """J2, A1, A5, A11 learned from the other rows of the issuer."""
    return _without_self(spark, sf, ISS)


def q_risk_bins(spark, sf):
    """A12, A13 of three ids, from one aggregate over the rows."""
    keys = [MCH, ISS, PART]
    b = tiers.risk_bins(profiles.entity_rates(_tx(spark, sf), keys, R), "rate", P, by="entity")
    entity = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("entity") + 1).cast("int")).alias("entity")
    return b.select(entity, F.posexplode(tiers.BINS).alias("edge_index", "edge")).select(
        "entity", F.col("edge_index").cast("int"), F.round("edge", 12).alias("edge")
    )


def _tiered(spark, sf, key):
    names = profiles.measure_names(key, R)
    # read by the bins and by the tiers: aggregated once, and of the measures the rate alone
    prof = _profile(spark, sf, key).select(key, names["rate"]).persist(StorageLevel.MEMORY_AND_DISK)
    return tiers.with_risk_tier(prof, key, R, P).select(key, names["rate"], tiers.tier_name(key, R))


def q_risk_tier_merchant(spark, sf):
    return _tiered(spark, sf, MCH)


def q_risk_tier_issuer(spark, sf):
    return _tiered(spark, sf, ISS)


def q_risk_tier_id(spark, sf):
    return _tiered(spark, sf, PART)


def q_tier_onehot(spark, sf):
    tx = _tx(spark, sf)
    names = profiles.measure_names(MCH, R)
    # read by the bins, the labels and the join: aggregated once
    prof = profiles.entity_profile(tx, MCH, R, P).select(MCH, names["rate"], names["count"]).persist(StorageLevel.MEMORY_AND_DISK)
    t = tiers.with_risk_tier(prof, MCH, R, P)
    labels = tiers.tier_labels(t, MCH, R)
    name = tiers.tier_name(MCH, R)
    out = profiles.attach_profile(tx, t.select(MCH, name, names["count"]), MCH, R, P)
    return out.select(MCH, "amount", "is_fraud", name, *tiers.tier_onehot_columns(MCH, R, labels))


def q_cardinality(spark, sf):
    return encode.cardinality(encode.category_counts(_tx(spark, sf), CATEGORICAL_CHECK))


def q_freq_table(spark, sf):
    counts = encode.category_counts(_tx(spark, sf), [PART])
    return encode.frequency_table(counts, PART).select(
        F.col("__value").cast("long").alias(PART), f"{PART}_freq"
    )


def q_freq_encode(spark, sf):
    tx = _tx(spark, sf)
    # read by the size check, the total and the join: count once
    counts = encode.category_counts(tx, [PART]).persist(StorageLevel.MEMORY_AND_DISK)
    return encode.attach_frequency(tx, counts, PART, P)


def q_onehot_encode(spark, sf):
    tx = _tx(spark, sf)
    # read by the cardinality and the label collects: count once
    counts = encode.category_counts(tx, ONEHOT_DEMO).persist(StorageLevel.MEMORY_AND_DISK)
    labels, _ = encode.plan_encoding(counts, ONEHOT_DEMO, P)
    cols = [c for f in ONEHOT_DEMO for c in encode.onehot_columns(f, labels[f])]
    return tx.select(MCH, "amount", *ONEHOT_DEMO, *cols)


def q_amount_flags(spark, sf):
    out = bands.with_amount_flags(_tx(spark, sf), R, P)
    return out.select("amount", "is_fraud", BUCKET, *[f"amount_range_{i}" for i in range(len(P.amount_thresholds) + 1)])


def q_amount_bucket_counts(spark, sf):
    return bands.with_amount_bucket(_tx(spark, sf), R, P).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"))


def q_score_band(spark, sf):
    return bands.score_band(_tx(spark, sf), R, P)


def q_cross_border_flag(spark, sf):
    return profiles.with_cross_border(_tx(spark, sf), R)


def q_null_sentinel(spark, sf):
    tx = _tx(spark, sf)
    prof = _shown(profiles.entity_profile(tx, MCH, R, P), MCH)
    band = bands.score_band(tx, R, P)
    return encode.fill_sentinel(profiles.attach_profile(band, prof, MCH, R, P))


# ---- rules with a plain score as confidence -------------------------------------------


def _band(spark, sf):
    return bands.with_amount_bucket(bands.score_band(_tx(spark, sf), R, P), R, P).persist(StorageLevel.MEMORY_AND_DISK)


def _flag():
    return F.col("cs") >= F.lit(FLAG_MIN)


def _patterns(spark, sf):
    return patterns.mine_patterns(_band(spark, sf), _flag(), MINING, R, P)


def _rules(spark, sf, band=None):
    band = band if band is not None else _band(spark, sf)
    pats = patterns.mine_patterns(band, _flag(), MINING, R, P)
    return patterns.rule_conditions(pats, MINING, R, P).persist(StorageLevel.MEMORY_AND_DISK)


def _evaluated(spark, sf, band=None):
    band = band if band is not None else _band(spark, sf)
    return rules.evaluate_rules(band, _rules(spark, sf, band), MINING, R, P).persist(StorageLevel.MEMORY_AND_DISK)


def _ranked(spark, sf, band=None):
    return rules.rank_rules(rules.keep_precise(_evaluated(spark, sf, band), P), MINING).persist(StorageLevel.MEMORY_AND_DISK)


METRIC_COLS = ["num_transactions", "num_frauds", "captured_fraud_amount", "precision", "amount_recall"]


def q_mine_patterns(spark, sf):
    return _patterns(spark, sf)


def q_mine_lattice(spark, sf):
    """A16 over every subset of the mining columns, an id among them."""
    return patterns.mine_lattice(_band(spark, sf), _flag(), LATTICE, R, P)


def _lattice_ranked(spark, sf, band):
    _, ranked = extract_rules(band, LATTICE, R, P, flagged=_flag())
    return ranked


def q_lattice_rules(spark, sf):
    """Rules of the maximal patterns (R1 wildcards, J7, A17-A20, O1) with an id mined."""
    return _lattice_ranked(spark, sf, _band(spark, sf)).select("rank", BUCKET, *LATTICE, "rule_string", "support", *METRIC_COLS)


def q_lattice_hits(spark, sf):
    """Rows hit by the best lattice rules, whose masks differ."""
    band = _band(spark, sf)
    best = ruleset.choose(_lattice_ranked(spark, sf, band), P, 8).persist(StorageLevel.MEMORY_AND_DISK)
    return ruleset.hits(band, best, LATTICE, R, P)


def _null_band(spark, sf):
    """The band with NULL scores, NULL categories and the -1 sentinel in a number."""
    b = F.col("bill_count")
    return _band(spark, sf).select(
        "is_fraud", "amount", BUCKET, F.when(b % 11 != 0, F.col("cs")).alias("cs"),
        F.when(b % 7 != 0, F.col("card_profile_dep")).alias("card_profile_dep"), (b % 3 - 1).alias("n"),
    )


def q_null_rules(spark, sf):
    """R1, J7 and A17-A20 with wildcards: NULL and -1 put no condition on a column."""
    band, feats = _null_band(spark, sf).persist(StorageLevel.MEMORY_AND_DISK), ["cs", "card_profile_dep", "n"]
    # few rows repeat four values; a lower support gives rules with every kind of wildcard
    pats = patterns.mine_patterns(band, F.col("is_fraud") == 1, feats, R, P.with_(min_support=5))
    found = patterns.rule_conditions(pats, feats, R, P).persist(StorageLevel.MEMORY_AND_DISK)
    return rules.evaluate_rules(band, found, feats, R, P).select(BUCKET, *feats, "rule_string", "support", *METRIC_COLS)


def q_null_view_sentinel(spark, sf):
    """P7 on rows that hold NULL: numbers become -1, texts stay."""
    return encode.fill_sentinel(_null_band(spark, sf))


def q_rule_text(spark, sf):
    return _rules(spark, sf).select(BUCKET, *MINING, "support", "rule_string")


def q_rule_conditions(spark, sf):
    return _rules(spark, sf).select(BUCKET, *MINING, F.inline("conditions"))


def q_rule_eval(spark, sf):
    return _evaluated(spark, sf).select(BUCKET, *MINING, "support", *METRIC_COLS)


def q_rules_kept(spark, sf):
    return rules.keep_precise(_evaluated(spark, sf), P).select(BUCKET, *MINING, "support", *METRIC_COLS)


def q_fraud_amount_total(spark, sf):
    return rules.total_fraud_amount(_band(spark, sf), R)


def q_rules_ranked(spark, sf):
    return _ranked(spark, sf).select("rank", BUCKET, *MINING, "amount_recall")


def q_extract_rules(spark, sf):
    return _ranked(spark, sf).select("rank", BUCKET, *MINING, "rule_string", "support", *METRIC_COLS)


def _selected(spark, sf, band=None):
    kept = rules.keep_precise(_evaluated(spark, sf, band), P)
    return ruleset.choose(kept, P, features=MINING).persist(StorageLevel.MEMORY_AND_DISK)


def q_top_rules(spark, sf):
    return _selected(spark, sf).select("rank", BUCKET, *MINING, "amount_recall")


def q_ruleset_rules(spark, sf):
    return _selected(spark, sf).select(
        "rank", BUCKET, "amount_lo", "amount_hi", *MINING, "score_lo", "score_hi", "rule_string", "support", *METRIC_COLS
    )


def _metrics_shown(m: DataFrame) -> DataFrame:
    return m.withColumn("average_precision", F.round("average_precision", 12))


def q_ruleset_metrics(spark, sf):
    return _metrics_shown(ruleset.metrics(_selected(spark, sf)))


def q_combined_rule(spark, sf):
    return ruleset.combined_rule(_selected(spark, sf))


def q_ruleset(spark, sf):
    sel = _selected(spark, sf)
    return _metrics_shown(ruleset.metrics(sel)).withColumn("combined_rule", ruleset.combined_rule(sel).scalar())


def q_ruleset_hits(spark, sf):
    band = _band(spark, sf)
    return ruleset.hits(band, _selected(spark, sf, band), MINING, R, P)


def q_ruleset_union_metrics(spark, sf):
    band = _band(spark, sf)
    return ruleset.union_metrics(band, _selected(spark, sf, band), MINING, R, P)


# ---- sources and sinks ------------------------------------------------------------------

#: What the raw view below has to fit; the label, the amount and the merchant are required.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("mch_id_trimmed", T.LongType(), False),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("is_fraud", T.IntegerType(), False),
        T.StructField("cs", T.DoubleType(), True),
        T.StructField("bill_count", T.IntegerType(), True),
        T.StructField("card_profile_dep", T.StringType(), True),
        T.StructField("auth_note", T.StringType(), True),
    ]
)


def _raw(spark, sf):
    """Transactions as a careless export gives them: numbers as text, "n/a", NULLs,
    halves and out-of-range values in an integer, a column too many, one missing."""
    b, c = F.col("bill_count"), F.col
    return _tx(spark, sf).select(
        F.when(b % 17 != 0, c("mch_id_trimmed")).alias("mch_id_trimmed"),
        F.when(b % 13 == 0, "n/a").when(b % 19 != 0, c("amount").cast("string")).alias("amount"),
        F.when(b == 41, F.lit(3_000_000_000)).otherwise(c("is_fraud").cast("long")).alias("is_fraud"),
        F.when(b % 11 != 0, c("cs").cast("string")).alias("cs"),
        F.when(b % 10 == 3, b + 0.5).when(b % 10 != 7, b.cast("double")).alias("bill_count"),
        "card_profile_dep", "issuer_member",
    )


def q_schema_rows(spark, sf):
    """The rows that keep the schema, typed."""
    return conform(_raw(spark, sf), RAW_SCHEMA).rows


def q_schema_rejected(spark, sf):
    """The rejected rows, each with all its reasons."""
    bad = conform(_raw(spark, sf), RAW_SCHEMA).rejected
    reasons = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["column"], e["reason"])), ",")
    shown = [F.get_json_object("row", f"$.{c}").alias(c) for c in ("card_profile_dep", "issuer_member")]
    return bad.select(*shown, reasons.alias("reasons"))


def q_schema_report(spark, sf):
    """How many rows break the schema, by column and reason."""
    return conform(_raw(spark, sf), RAW_SCHEMA).report


def q_published_rules(spark, sf):
    """S3: all precise rules published, then the chosen ones; what a reader gets."""
    kept = rules.keep_precise(_evaluated(spark, sf), P).persist(StorageLevel.MEMORY_AND_DISK)
    base = f"{checkpoint_dir(spark)}/published-{uuid4().hex}"
    first = publish(kept, base)
    latest = publish(ruleset.choose(kept, P, features=MINING), base)
    before = read_published(spark, base, first).agg(F.count(F.lit(1)).alias("n"))
    return read_published(spark, base).select(
        "rank", BUCKET, *MINING, "rule_string", "support", *METRIC_COLS,
        F.lit(latest).cast("long").alias("version"), before.scalar().alias("rules_before"),
    )


# ---- sketches per day -------------------------------------------------------------------

SKETCHED = ["event_id", "user_id", "event_type"]
SHARES = [0.0, 0.5, 0.9, 0.95, 1.0]
#: Over three standard errors of the distinct counts, and twice the rank error of the quantiles.
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.02


def _daily(spark, sf):
    return table(spark, sf, "events").withColumn("day", F.to_date("ts"))


def q_sketch_cardinality(spark, sf):
    """A14 by merged sketches of days, beside the exact counts they stand for."""
    ev = _daily(spark, sf)
    stored = checkpoint(sketches.category_sketches(ev, SKETCHED, "day"))
    near = sketches.merged_cardinality(stored).withColumnRenamed("n_distinct", "about")
    exact = encode.cardinality(encode.category_counts(ev, SKETCHED))
    within = F.abs(F.col("about") - F.col("n_distinct")) <= DISTINCT_ERROR * F.col("n_distinct")
    return exact.join(near, "feature").select("feature", "n_distinct", "n", within.alias("within_error"))


def q_sketch_quantiles(spark, sf):
    """A12 by merged sketches of days: each quantile's true rank lies within the error."""
    ev = _daily(spark, sf)
    stored = checkpoint(sketches.value_sketches(ev, ["value"], "day"))
    # one row, read by every row's comparison and by the result
    asked = checkpoint(sketches.merged_quantiles(stored, SHARES)).select("quantiles")
    rows = ev.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("q", asked.scalar())
    at = [(F.col("value") < F.col("q")[i], F.col("value") <= F.col("q")[i]) for i in range(len(SHARES))]
    share = lambda c: F.avg(c.cast("int"))
    ranks = F.array(*[F.struct(F.lit(s).alias("share"), share(lo).alias("lo"), share(hi).alias("hi")) for s, (lo, hi) in zip(SHARES, at)])
    found = rows.agg(F.count(F.lit(1)).alias("n"), ranks.alias("ranks")).select("n", F.inline("ranks"))
    within = (F.col("lo") - RANK_ERROR <= F.col("share")) & (F.col("share") <= F.col("hi") + RANK_ERROR)
    return found.select("share", "n", within.alias("within_error"))


# ---- a tree as a table ----------------------------------------------------------------------

#: A small stated tree over a score, a number and a flag (thresholds as a fitted tree has them).
STATED_TREE = [
    (1, False, "cs", 0.35, 0.0, 0.3),
    (2, False, "cross", 0.5, 0.0, 0.1),
    (3, False, "cs", 0.65, 1.0, 0.7),
    (4, True, None, None, 0.0, 0.05),
    (5, True, None, None, 0.0, 0.2),
    (6, False, "n", 24.5, 1.0, 0.55),
    (7, True, None, None, 1.0, 0.95),
    (12, True, None, None, 0.0, 0.45),
    (13, True, None, None, 1.0, 0.72),
]
TREE_COLUMNS = "node_id long, is_leaf boolean, feature string, threshold double, prediction double, share double"


def _tree_rows(spark, sf):
    b = F.col("bill_count")
    rows = bands.score_band(_tx(spark, sf), R, P).select(
        MCH, "amount", "is_fraud", F.when(b % 11 != 0, F.col("cs")).alias("cs"), F.when(b % 5 != 0, b).alias("n"),
        F.when(b % 7 != 0, F.col("issuer_bin_profile_issuing_cou") != F.col("merchant_country_code")).alias("cross"),
    )
    return model.score_by_tree(rows, spark.createDataFrame(STATED_TREE, TREE_COLUMNS))


def q_tree_rows(spark, sf):
    """Every band row scored by a stated tree, NULLs in all three inputs."""
    return _tree_rows(spark, sf)


def q_tree_positive_rows(spark, sf):
    """P8 on the stated tree."""
    return _tree_rows(spark, sf).where(model.confident(P))


# ---- model-backed queries (no SQL oracle: a trained tree decides) ------------------------

TREE_P = P.with_(max_depth=4)
# the workflow mines ids whatever their number of values: min_support decides
WORKFLOW_P = TREE_P.with_(max_rules=3)


def _prepared(spark, sf, columns=None):
    return preprocess(_tx(spark, sf), R, TREE_P, columns=columns)


#: Columns of a band row that the queries show beside its label and model inputs.
SHOWN = (MCH, "amount")
TIERED = ("merchant", "issuer", "part_id")
VECTORS = [f"{x}_risk_tier_enc" for x in TIERED] + [f"{c}_vec" for c in ("ship_address_usage_ind", "card_profile_dep", "bill_count")]


def q_slot_rows(spark, sf):
    """The slot each one-hot vector of the stored band marks, per row."""
    band = _prepared(spark, sf).band
    tier = [f"{x}_risk_tier" for x in TIERED]
    marked = [slots.active_slot(v).cast("long").alias(f"{v}_slot") for v in VECTORS]
    return band.select(MCH, "amount", "is_fraud", "ship_address_usage_ind", "card_profile_dep", "bill_count", *tier, *marked)


def q_slot_counts(spark, sf):
    """Every slot by its name in the metadata, with the band rows that mark it."""
    return slots.slot_counts(_prepared(spark, sf).band, VECTORS)


def q_features(spark, sf):
    prep = _prepared(spark, sf, SHOWN)
    return model.assemble(prep.band, prep.inputs).select(MCH, "amount", "is_fraud", model.FEATURES)


def _trained(spark, sf, columns=()):
    prep = _prepared(spark, sf, columns)
    return prep, model.train(prep.band, prep.inputs, R, TREE_P)


def q_feature_ranking(spark, sf):
    prep, m = _trained(spark, sf)
    return model.feature_ranking(spark, m, prep.slots, prep.source_of)


def q_train_tree(spark, sf):
    prep, m = _trained(spark, sf)
    return model.tree_nodes(spark, m, prep.slots)


def q_score_rows(spark, sf):
    prep, m = _trained(spark, sf, SHOWN)
    return model.score(m, prep.band).select(MCH, "amount", "is_fraud", "cs", "prediction", model.PROB)


def q_positive_rows(spark, sf):
    prep, m = _trained(spark, sf, SHOWN)
    scored = model.score(m, prep.band)
    return scored.where(model.confident(TREE_P)).select(MCH, "amount", "is_fraud", "cs", model.PROB)


def q_tree_agreement(spark, sf):
    """The fitted tree as an expression against the fitted model, whole band."""
    prep, m = _trained(spark, sf)
    by_model = model.score(m, prep.band)
    mine = model.tree_column(by_model, model.tree_nodes(spark, m, prep.slots))
    both = by_model.withColumn("__tree", mine)
    p, q = F.col("__tree.prediction"), F.col(f"__tree.{model.PROB}")
    flagged = (p == 1.0) & (q >= F.lit(float(TREE_P.confidence)))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        count(~p.eqNullSafe(F.col("prediction"))).alias("predictions_differ"),
        count(~q.eqNullSafe(F.col(model.PROB))).alias("probabilities_differ"),
        count(~flagged.eqNullSafe(model.confident(TREE_P))).alias("flags_differ"),
    )


def q_workflow(spark, sf):
    res = mine_rules(_tx(spark, sf), R, WORKFLOW_P)
    return res.selected.select("rank", "rule_string", *METRIC_COLS)


def q_workflow_union_metrics(spark, sf):
    res = mine_rules(_tx(spark, sf), R, WORKFLOW_P)
    return res.union_metrics


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
