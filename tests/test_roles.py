"""Roles, parameters and small helpers."""

import pytest
from pyspark.sql import functions as F

from riskrules import Params, Roles
from riskrules.functions.joins import checkpoint_dir
from riskrules.functions.rank import global_rank, range_partitions


def test_score_grid_follows_interval_width():
    assert Params().score_grid_decimals == 1  # half-width 0.05 -> step 0.1
    assert Params(score_half_width=0.005).score_grid_decimals == 2
    assert Params(score_decimals=3).score_grid_decimals == 3


def test_roles_check_names_missing_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 55.0)], "is_fraud int, amount double, fraud_score double")
    Roles().check(df)
    with pytest.raises(ValueError, match="mch_id_trimmed"):
        Roles(ids=("mch_id_trimmed",)).check(df)


def test_range_partitions_sized_from_rows(spark):
    cap = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert range_partitions(spark, 40) == 1
    assert range_partitions(spark, 2_500_000) == min(cap, 3)
    assert range_partitions(spark, None) == cap


def test_global_rank_with_row_hint(spark):
    df = spark.range(500).withColumn("v", (F.col("id") * 7919) % 500)
    out = {r["v"]: r["rank"] for r in global_rank(df, [F.desc("v")], rows_hint=500).collect()}
    assert out == {v: 500 - v for v in range(500)}


def test_checkpoint_dir_is_the_sessions(spark):
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() is not None
