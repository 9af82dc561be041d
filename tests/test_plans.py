"""Plan shape: no Python workers, one fused aggregate, joins on keys."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SF0001

PY_EVAL = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["merchant_profile", "issuer_profile", "attach_merchant_profile", "risk_tier_merchant", "freq_encode",
     "onehot_encode", "tier_onehot", "rule_eval", "extract_rules", "ruleset_hits", "ruleset_union_metrics"],
)
def test_no_python_eval(spark, name):
    p = plan(E.queries()[name](spark, SF0001))
    assert not any(x in p for x in PY_EVAL), name


def test_profile_is_one_aggregate(spark):
    from riskrules.operators.profiles import entity_profile
    from riskrules.roles import Params, Roles

    li = spark.read.parquet(f"{SF0001}/lineitem.parquet").selectExpr(
        "l_suppkey AS mch_id_trimmed", "CAST(l_linenumber % 2 AS INT) AS is_fraud", "l_extendedprice AS amount"
    )
    p = entity_profile(li, "mch_id_trimmed", Roles(), Params())._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"HashAggregate", p)) == 2, p
    assert p.count("FileScan parquet") == 1 or p.count("Scan parquet") == 1


def test_rule_eval_joins_on_keys(spark):
    p = plan(E.queries()["rule_eval"](spark, SF0001))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_band_filter_reaches_scan(spark):
    from riskrules.operators.bands import score_band
    from riskrules.roles import Params, Roles

    df = spark.read.parquet(f"{SF0001}/lineitem.parquet").selectExpr("l_discount * 1000 AS fraud_score", "l_tax")
    df = spark.read.parquet(f"{SF0001}/lineitem.parquet").withColumnRenamed("l_discount", "fraud_score")
    p = plan(score_band(df, Roles(), Params()).select("fraud_score", "l_tax"))
    assert "PushedFilters: [IsNotNull(fraud_score)" in p or "PushedFilters: [IsNotNull(l_discount)" in p
    assert "ReadSchema: struct<l_tax:double,l_discount:double>" in p or "ReadSchema: struct<l_discount:double,l_tax:double>" in p


@pytest.mark.parametrize("mode", ["checkpoint", "persist"])
def test_band_reads_population_aggregates_back(spark, monkeypatch, mode):
    """The band joins several profiles cut from one aggregate beside its own
    scan of the input: the aggregate must be read back (checkpoint), never
    recomputed inside the band's plan (no Expand, one scan per input table)."""
    import riskrules.plans.workflow as W
    from riskrules.plans.queries import R, TREE_P
    from riskrules.sources.fixtures import tx_frame

    monkeypatch.setattr(W, "materialize", lambda df, params: df)  # inspect the band's own plan
    prep = W.preprocess(tx_frame(spark, SF0001), R, TREE_P.with_(materialize=mode))
    p = prep.band._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in p
    for table in ("lineitem", "orders", "customer", "supplier"):
        assert p.count(f"{table}.parquet") == 1, (table, p.count(f"{table}.parquet"))
