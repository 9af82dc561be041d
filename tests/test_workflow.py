"""End-to-end: the tree, the workflow, the entry contract and streaming."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskrules import Params, mine_rules, preprocess
from riskrules.plans import queries as Q
from riskrules.sources.fixtures import FIXTURE_ROLES, tx_frame
from riskrules.streaming import flag_events, start_flagging

from .conftest import SF0001, SF001


def test_entry_contract(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns[:2] == ["rank", "rule_string"]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
    assert all(r["precision"] >= 0.3 for r in rows)
    qs, ora = E.queries(), E.oracle_sql()
    assert set(ora) <= set(qs)


def test_preprocess_inputs_are_numeric_and_filled(spark):
    prep = preprocess(tx_frame(spark, SF0001), FIXTURE_ROLES, Params(max_depth=4))
    assert "mch_id_trimmed" not in prep.inputs and "amount" not in prep.inputs and "is_fraud" not in prep.inputs
    assert "cs" in prep.inputs and "merchant_fraud_rate" in prep.inputs and "part_id_freq" in prep.inputs
    nulls = prep.band.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in prep.inputs]).first()
    assert all(v == 0 for v in nulls.asDict().values())
    assert prep.band.count() == prep.band.where("fraud_score >= 50 AND fraud_score < 70").count()


def test_tree_flags_planted_signal(spark):
    prep = preprocess(tx_frame(spark, SF001), FIXTURE_ROLES, Q.TREE_P)
    from riskrules.operators import model

    m = model.train(prep.band, prep.inputs, FIXTURE_ROLES, Q.TREE_P)
    rank = model.feature_ranking(spark, m, prep.slots, prep.source_of).orderBy("rank").first()
    assert rank["feature"] == "cs"
    nodes = model.tree_nodes(spark, m, prep.slots).collect()
    assert len(nodes) == m.stages[-1].numNodes
    root = [n for n in nodes if n["node_id"] == 1][0]
    assert root["feature"] == "cs" and not root["is_leaf"] and root["rows"] == 12023
    assert all(n["is_leaf"] == (n["feature"] is None) for n in nodes)
    scored = model.score(m, prep.band)
    assert prep.band.count() == 12023
    assert scored.where(model.confident(Q.TREE_P)).count() == 2215


def test_workflow_rules_are_precise(spark):
    res = mine_rules(tx_frame(spark, SF001), FIXTURE_ROLES, Q.TREE_P.with_(max_rules=3))
    assert res.features[0] == "cs"
    assert not set(res.left_out) & set(res.features)
    sel = res.selected.collect()
    assert 0 < len(sel) <= 3
    assert all(r["precision"] >= 0.3 for r in sel)
    m = res.metrics.first()
    u = res.union_metrics.first()
    assert m["total_rules"] == len(sel)
    assert u["union_transactions"] <= m["total_transactions"]


def test_registered_workflow_mines_ids_of_any_number_of_values(spark, monkeypatch):
    from riskrules.plans.workflow import mining_features

    used = []

    class Stop(Exception):
        pass

    def seen(df, roles, params):
        used.append(params)
        raise Stop

    monkeypatch.setattr(Q, "mine_rules", seen)
    for query in (Q.q_workflow, Q.q_workflow_union_metrics):
        with pytest.raises(Stop):
            query(spark, SF0001)
    scored = tx_frame(spark, SF0001)
    ids = {c: c for c in ("mch_id_trimmed", "issuer_member", "part_id", "bill_count")}
    for params in used:
        mined, left_out = mining_features([(c, 0.25) for c in ids], ids, scored, FIXTURE_ROLES, params, {c: 1_000_000 for c in ids})
        assert sorted(mined) == sorted(ids) and not left_out


def test_streaming_equals_batch(spark):
    band = Q._band(spark, SF001)
    sel = Q._selected(spark, SF001, band)
    d = tempfile.mkdtemp(prefix="riskrules-stream-")
    events = band.drop("amount_bucket")
    events.write.mode("overwrite").parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(events.schema).parquet(os.path.join(d, "in"))
    q = start_flagging(
        stream, sel, Q.MINING, Q.R, Q.P, name="flag_test", sink_format="memory", checkpoint=os.path.join(d, "ckpt")
    )
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT COUNT(*) FROM flag_test").first()[0]
    exp = flag_events(events, sel, Q.MINING, Q.R, Q.P).count()
    assert got == exp == 732
