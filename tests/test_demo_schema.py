"""The method's 15-column schema end to end, on rows taken from the given tables:
read with an explicit schema, mine rules, publish them.  Holds a boolean column,
the categories "" and "nan", NULLs, string ids and the issuer's measures."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskrules import Params, Roles, mine_rules
from riskrules.operators.slots import slot_labels
from riskrules.sources.fixtures import tx_frame
from riskrules.sources.transactions import TRANSACTION_SCHEMA, read_transactions, write_rules

from .conftest import SF001


def as_transactions(tx):
    line = F.col("ship_address_usage_ind").cast("int")
    made = {
        "community_fraud_score_amount_d": F.col("cs"),
        "mch_id_trimmed": F.concat(F.lit("shop-"), F.col("mch_id_trimmed") % 40),
        "issuer_member": F.concat(F.lit("bank-"), F.col("issuer_member") % 10),
        "panalias_hab_cp_bill_count_45d": F.col("bill_count"),
        "panalias_hab_ipaddress_count_4": F.when(line > 1, line),
        "isres_dpt_estimated_fact": F.col("bill_count") % 2,
        "is_correct_bill_dept": F.when(line != 3, line < 4),
        "card_profile_dep": F.when(line == 1, "").when(line == 2, "nan").otherwise(F.col("card_profile_dep")),
    }
    rows = tx.withColumns(made)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRANSACTION_SCHEMA.fields])


@pytest.fixture(scope="module")
def demo(spark):
    d = tempfile.mkdtemp(prefix="riskrules-demo-")
    as_transactions(tx_frame(spark, SF001)).write.mode("overwrite").parquet(os.path.join(d, "tx"))
    return d, read_transactions(spark, os.path.join(d, "tx"), TRANSACTION_SCHEMA)


def test_read_with_schema(demo):
    _, df = demo
    assert df.schema == TRANSACTION_SCHEMA
    assert df.where("card_profile_dep = ''").count() > 0 and df.where("panalias_hab_ipaddress_count_4 IS NULL").count() > 0


def test_mine_rules_on_demo_schema_and_publish(spark, demo):
    d, df = demo
    roles = Roles(categoricals=("ship_address_usage_ind", "card_profile_dep"), ids=("mch_id_trimmed", "issuer_member"))
    res = mine_rules(df, roles, Params(max_depth=4, min_support=20, max_rules=3))
    inputs = set(res.scored.columns)
    # boolean (with NULLs) kept as a model input, "" tokenised, issuer auth / 3DS measures present
    assert "is_correct_bill_dept" in inputs and "issuer_auth_rate" in inputs and "issuer_3ds_usage_rate" in inputs
    assert "__empty__" in slot_labels(res.scored, "card_profile_dep_vec")
    assert not any(c.startswith("card_profile_dep_vec_") for c in inputs)
    sel = res.selected.collect()
    assert res.features[0] == "community_fraud_score_amount_d"
    assert 0 < len(sel) <= 3
    assert all(r["precision"] >= 0.3 for r in sel)
    out = os.path.join(d, "rules")
    write_rules(res.selected, out)
    back = spark.read.parquet(out)
    assert back.count() == len(sel)
    assert set(["rule_string", "precision", "amount_recall", "conditions"]) <= set(back.columns)
    combined = res.combined_rule.first()["combined_rule"]
    assert (combined or "").count(" OR ") == max(len(sel) - 1, 0)
