"""Hand fixture of 8 rows with known profile, tier, band and bucket values."""

import pytest
from pyspark.sql import functions as F

from riskrules import Params, Roles
from riskrules.functions.exprs import amount_bucket
from riskrules.operators import bands, profiles, tiers

ROLES = Roles(ids=("mch_id_trimmed",))
P = Params()

ROWS = [
    ("A", 1, 1000.0, 55.0),
    ("A", 0, 3000.0, 60.0),
    ("A", 1, 120000.0, 10.0),
    ("B", 0, 5000.0, 50.0),
    ("B", 0, 7000.0, 70.0),
    ("C", 1, 10000.0, 69.9),
    ("D", None, 0.0, 55.0),
    (None, 1, 2000.0, 52.0),
]
SCHEMA = "mch_id_trimmed string, is_fraud int, amount double, fraud_score double"

EXPECTED = {
    # mch: rate, count, avg, std, fraud_amount_rate, small, large, tier
    "A": (0.666667, 3, 41333.3333, 68134.6706, 0.975806, 0.5, 1.0, "low"),
    "B": (0.0, 2, 6000.0, 1414.2136, 0.0, None, None, "low"),
    "C": (1.0, 1, 10000.0, None, 1.0, None, None, "very_high"),
    "D": (None, 1, 0.0, None, None, None, None, "unknown"),
    None: (1.0, 1, 2000.0, None, 1.0, 1.0, None, "very_high"),
}


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def close(a, b, tol=1e-4):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(b, str):
        return a == b
    return abs(a - b) <= tol * max(1.0, abs(b))


def test_merchant_profile_and_tier(hand):
    prof = tiers.with_risk_tier(profiles.entity_profile(hand, "mch_id_trimmed", ROLES, P), "mch_id_trimmed", ROLES, P)
    cols = [
        "merchant_fraud_rate", "merchant_tx_count", "merchant_avg_amount", "merchant_amount_std",
        "merchant_fraud_amount_rate", "merchant_small_amount_fraud_rate", "merchant_large_amount_fraud_rate",
        "merchant_risk_tier",
    ]
    got = {r["mch_id_trimmed"]: tuple(r[c] for c in cols) for r in prof.collect()}
    assert set(got) == set(EXPECTED)
    for k, exp in EXPECTED.items():
        assert all(close(a, b) for a, b in zip(got[k], exp)), (k, got[k], exp)


def test_bins(hand):
    prof = profiles.entity_profile(hand, "mch_id_trimmed", ROLES, P)
    b = tiers.risk_bins(prof, "merchant_fraud_rate", P).first()["bins"]
    assert [round(x, 12) for x in b] == [0.0, round(2 / 3, 12), round(14 / 15, 12), round(29 / 30, 12), 1.0]


def test_attach_null_key_gets_null_measures(hand):
    prof = profiles.entity_profile(hand, "mch_id_trimmed", ROLES, P)
    out = profiles.attach_profile(hand, prof, "mch_id_trimmed", ROLES, P)
    assert out.count() == 8
    r = out.where(F.col("mch_id_trimmed").isNull()).first()
    assert r["merchant_fraud_rate"] is None and r["merchant_tx_count"] is None


def test_salted_join_equals_broadcast(hand):
    prof = profiles.entity_profile(hand, "mch_id_trimmed", ROLES, P)
    forced = P.with_(max_broadcast_rows=0, rows_per_task=1, max_hot_keys=100)
    a = profiles.attach_profile(hand, prof, "mch_id_trimmed", ROLES, P)
    b = profiles.attach_profile(hand, prof, "mch_id_trimmed", ROLES, forced)
    assert "__salt" in b._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_band_and_buckets(hand):
    band = bands.score_band(hand, ROLES, P)
    assert band.count() == 6
    assert set(r["fraud_score"] for r in band.collect()) == {55.0, 60.0, 50.0, 69.9, 52.0}
    buckets = [r[0] for r in hand.select(amount_bucket("amount", P.amount_thresholds)).collect()]
    assert buckets == [0, 0, 5, 1, 1, 1, 0, 0]


def test_amount_flags_sum_to_one(hand):
    out = bands.with_amount_flags(hand, ROLES, P)
    total = sum(F.col(f"amount_range_{i}") for i in range(6))
    assert {r[0] for r in out.select(total).collect()} == {1.0}


def test_zero_amount_group_no_error(hand):
    prof = profiles.entity_profile(hand, "mch_id_trimmed", ROLES, P)
    d = prof.where(F.col("mch_id_trimmed") == "D").first()
    assert d["merchant_fraud_amount_rate"] is None


def test_cross_border_null_is_zero(spark):
    df = spark.createDataFrame(
        [("FR", "FR"), ("FR", "US"), (None, "US"), ("FR", None)],
        "issuer_bin_profile_issuing_cou string, merchant_country_code string",
    )
    out = profiles.with_cross_border(df, Roles())
    assert [r["is_cross_border"] for r in out.collect()] == [0, 1, 0, 0]


def test_population_stats_equal_separate_aggregates(spark):
    from riskrules.operators import encode
    from riskrules.operators.profiles import PopulationStats
    from riskrules.sources.fixtures import FIXTURE_ROLES, tx_frame

    from .conftest import SF0001

    tx = profiles.with_cross_border(tx_frame(spark, SF0001), FIXTURE_ROLES)
    cats = ["card_profile_dep", "part_id"]
    st = PopulationStats(tx, FIXTURE_ROLES, P, cats)

    def norm(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())

    for key in FIXTURE_ROLES.ids:
        sep = profiles.entity_profile(tx, key, FIXTURE_ROLES, P)
        fused = st.profile(key)
        assert fused.columns == sep.columns
        assert norm(fused) == norm(sep)
    assert norm(st.counts) == norm(encode.category_counts(tx, cats))


def test_bins_equal_the_percentile_aggregate(spark):
    from riskrules.sources.fixtures import FIXTURE_ROLES, tx_frame

    from .conftest import SF0001

    tx = tx_frame(spark, SF0001)
    for key in ("issuer_member", "part_id"):
        prof = profiles.entity_profile(tx, key, FIXTURE_ROLES, P).persist()
        rate = profiles.measure_names(key, FIXTURE_ROLES)["rate"]
        a = tiers.risk_bins(prof, rate, P).first()["bins"]
        pcts = F.array(*[F.lit(float(p)) for p in P.tier_percentiles])
        b = prof.select(rate).where(F.col(rate).isNotNull()).distinct().agg(F.array_distinct(F.percentile(rate, pcts)).alias("b")).first()["b"]
        assert len(a) == len(b) and all(abs(x - y) <= 1e-12 for x, y in zip(a, b))


def test_tier_population_equals_per_id_tiers(spark):
    from riskrules.operators.profiles import PopulationStats
    from riskrules.sources.fixtures import FIXTURE_ROLES, tx_frame

    from .conftest import SF0001

    tx = profiles.with_cross_border(tx_frame(spark, SF0001), FIXTURE_ROLES)
    st = PopulationStats(tx, FIXTURE_ROLES, P, ())
    profs, labels = tiers.tier_population(st, FIXTURE_ROLES, P)
    for key in FIXTURE_ROLES.ids:
        ref = tiers.with_risk_tier(profiles.entity_profile(tx, key, FIXTURE_ROLES, P), key, FIXTURE_ROLES, P)
        name = tiers.tier_name(key, FIXTURE_ROLES)
        got = {r[key]: r[name] for r in profs[key].select(key, name).collect()}
        exp = {r[key]: r[name] for r in ref.select(key, name).collect()}
        assert got == exp
        assert labels[key] == tiers.tier_labels(ref, key, FIXTURE_ROLES)


def test_salted_join_splits_hot_key(spark):
    """A key holding most rows is spread over several join tasks (AQE off, so
    the partitioning is the planned one); the plain join keeps it in one."""
    rows = [("H", 1, float(i), 55.0) for i in range(3000)] + [(f"K{i % 50}", 0, 10.0, 55.0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    prof = profiles.entity_profile(df, "mch_id_trimmed", ROLES, P)
    forced = P.with_(max_broadcast_rows=0, rows_per_task=400, max_hot_keys=100)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    old_bc = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = profiles.attach_profile(df, prof, "mch_id_trimmed", ROLES, forced)
        parts = salted.where(F.col("mch_id_trimmed") == "H").select(F.spark_partition_id().alias("p")).distinct().count()
        plain = df.join(prof, "mch_id_trimmed", "left")
        plain_parts = plain.where(F.col("mch_id_trimmed") == "H").select(F.spark_partition_id().alias("p")).distinct().count()
        assert salted.count() == 3500
        assert salted.where(F.col("merchant_tx_count") == 3000).count() == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_bc)
    assert plain_parts == 1
    assert parts >= 4
