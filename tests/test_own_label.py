"""Profiles without the row's own label, against their definition."""

import math

import pytest
from pyspark.sql import functions as F

from riskrules import Params, Roles, preprocess
from riskrules.operators.model import model_inputs
from riskrules.operators.profiles import attach_profile, entity_profile
from riskrules.plans import queries as Q
from riskrules.sources.fixtures import FIXTURE_ROLES, tx_frame

from .conftest import SF0001

ROLES = Roles(merchant="m", issuer="i", ids=("m",))
ROWS = [
    (0, "a", 1, 100.0), (1, "a", 0, 200.1), (2, "a", None, 50.0), (3, "a", 1, None), (4, "a", 1, 200000.0),
    (5, "b", 1, 10.0), (6, None, 1, 10.0), (7, None, 0, 20.0), (8, "c", 0, 0.0), (9, "c", 1, 0.0),
    (10, "d", 1, 5.0), (11, "d", 1, 5.0), (12, "e", None, 7.0), (13, "e", None, 8.0),
]


def mean(xs):
    return sum(xs) / len(xs) if xs else None


def test_equals_profile_of_the_other_rows(spark):
    df = spark.createDataFrame(ROWS, "id int, m string, is_fraud int, amount double")
    for params in (Params(), Params(max_broadcast_rows=0, rows_per_task=1)):
        prof = entity_profile(df, "m", ROLES, params, states=True)
        got = attach_profile(df, prof, "m", ROLES, params)
        assert not [c for c in got.columns if c.startswith("__")]
        for r in got.collect():
            others = [x for x in ROWS if x[1] == r["m"] and x[0] != r["id"]]
            if r["m"] is None:
                assert r["merchant_fraud_rate"] is r["merchant_fraud_amount_rate"] is r["merchant_tx_count"] is None
                continue
            y = [(x[2], x[3]) for x in others if x[2] is not None]
            assert r["merchant_fraud_rate"] == mean([a for a, _ in y])
            assert r["merchant_small_amount_fraud_rate"] == mean([a for a, b in y if b is not None and b <= 3000])
            assert r["merchant_large_amount_fraud_rate"] == mean([a for a, b in y if b is not None and b > 100000])
            amount = math.fsum(x[3] for x in others if x[3] is not None)
            positive = math.fsum(x[3] for x in others if x[3] is not None and x[2] == 1)
            want = positive / amount if amount else None
            assert r["merchant_fraud_amount_rate"] == (pytest.approx(want, rel=1e-15) if want is not None else None)
            assert r["merchant_tx_count"] == len(others) + 1


def test_label_of_a_row_does_not_reach_its_inputs(spark):
    tx = tx_frame(spark, SF0001).where("fraud_score >= 50 AND fraud_score < 70").withColumn("uid", F.monotonically_increasing_id()).checkpoint()
    params = Params(own_label=False)
    one = tx.agg(F.min("uid")).first()[0]
    flipped = tx.withColumn("is_fraud", F.when(F.col("uid") == one, 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    rates = ["merchant_fraud_rate", "issuer_fraud_rate", "part_id_fraud_rate", "merchant_fraud_amount_rate", "issuer_cross_border_fraud_rate"]
    seen = [preprocess(t, FIXTURE_ROLES, params).band.where(F.col("uid") == one).select(*rates).first() for t in (tx, flipped)]
    assert seen[0] == seen[1]
    own = [preprocess(t, FIXTURE_ROLES, Params()).band.where(F.col("uid") == one).select(*rates).first() for t in (tx, flipped)]
    assert own[0] != own[1]


def test_workflow_option(spark):
    tx = tx_frame(spark, SF0001)
    with_own, without = (preprocess(tx, FIXTURE_ROLES, Params(own_label=o)) for o in (True, False))
    assert with_own.inputs == without.inputs and model_inputs(without.band, FIXTURE_ROLES, Params()) == without.inputs
    assert with_own.source_of == without.source_of and not [c for c in without.band.columns if c.startswith("__")]
    # every row's tier follows the rate it shows
    worst = without.band.where("merchant_risk_tier = 'low'").agg(F.max("merchant_fraud_rate")).first()[0]
    best = without.band.where("merchant_risk_tier = 'very_high'").agg(F.min("merchant_fraud_rate")).first()[0]
    assert best is None or worst is None or worst <= best
    with pytest.raises(ValueError, match="own_label"):
        preprocess(tx, FIXTURE_ROLES, Params(own_label=False), profile_df=tx)


def test_registered_query_keeps_every_row(spark):
    assert Q.q_attach_merchant_without_self(spark, SF0001).count() == tx_frame(spark, SF0001).count()
