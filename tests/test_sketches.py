"""Sketches of periods: merged counts and quantiles, replaced periods."""

import pytest
from pyspark.sql import functions as F

from riskrules.operators import encode, sketches
from riskrules.plans import queries as Q

from .conftest import SF001


def rows(spark, n=60_000):
    """Day 0 holds a third of the rows; NULL and "" values, NaN numbers, a NULL day."""
    i = F.col("id")
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    return spark.range(0, n, 1, 8).select(
        F.when(i % 3 == 0, 0).when(i % 97 != 0, i % 10 + 1).alias("day"),
        F.when(i % 31 != 0, (h % 20_000).cast("string")).alias("many"),
        F.when(i % 2 == 0, "").otherwise("x").alias("few"),
        F.lit(None).cast("string").alias("none"),
        F.when(i % 17 == 0, float("nan")).when(i % 19 != 0, h / 1000.0).alias("v"),
        F.lit(None).cast("double").alias("w"),
    )


FEATURES = ["many", "few", "none"]


def test_merged_cardinality_is_near_the_exact_one(spark):
    df = rows(spark)
    exact = {r["feature"]: r["n_distinct"] for r in encode.cardinality(encode.category_counts(df, FEATURES)).collect()}
    got = {r["feature"]: r for r in sketches.merged_cardinality(sketches.category_sketches(df, FEATURES, "day")).collect()}
    assert {f: r["n"] for f, r in got.items()} == dict.fromkeys(FEATURES, 60_000)
    # few values are counted exactly; NULL alone is one value
    assert got["few"]["n_distinct"] == exact["few"] == 2 and got["none"]["n_distinct"] == exact["none"] == 1
    assert abs(got["many"]["n_distinct"] - exact["many"]) <= 0.03 * exact["many"]


def test_merged_quantiles_have_near_ranks(spark):
    df, shares = rows(spark), [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["feature"]: r for r in sketches.merged_quantiles(sketches.value_sketches(df, ["v", "w"], "day"), shares).collect()}
    values = sorted(r["v"] for r in df.where("v IS NOT NULL AND NOT isnan(v)").collect())
    assert got["v"]["n"] == len(values) and got["w"]["n"] == 0 and got["w"]["quantiles"] is None
    q = got["v"]["quantiles"]
    assert q[0] == values[0] and q[-1] == values[-1]
    for share, at in zip(shares, q):
        rank = sum(x <= at for x in values) / len(values)
        assert abs(rank - share) <= 0.02


@pytest.mark.parametrize("day", [0, 4, None])
def test_replaced_period_equals_a_rebuild(spark, day):
    df = rows(spark, 20_000)
    old = df.where(~F.col("day").eqNullSafe(F.lit(day).cast("long")) | (F.col("few") == "x"))
    stored = sketches.category_sketches(old, FEATURES, "day")
    fresh = sketches.category_sketches(df.where(F.col("day").eqNullSafe(F.lit(day).cast("long"))), FEATURES, "day")
    now = sketches.replace_periods(stored, fresh, "day")
    whole = sketches.category_sketches(df, FEATURES, "day")
    key = lambda t: sorted((r["feature"], r["n_distinct"], r["n"]) for r in sketches.merged_cardinality(t).collect())
    assert key(now) == key(whole) and now.count() == whole.count()


def test_old_days_are_not_read_again(spark):
    stored = sketches.category_sketches(rows(spark), FEATURES, "day").checkpoint()
    plan = sketches.merged_cardinality(stored)._jdf.queryExecution().toString()
    assert "Range" not in plan and plan.count("Exchange hashpartitioning(feature") >= 1


def test_no_rows(spark):
    none = rows(spark).limit(0)
    assert sketches.merged_cardinality(sketches.category_sketches(none, FEATURES, "day")).count() == 0
    assert sketches.merged_quantiles(sketches.value_sketches(none, ["v"], "day"), [0.5]).count() == 0


def test_registered_queries(spark):
    for q in (Q.q_sketch_cardinality, Q.q_sketch_quantiles):
        got = q(spark, SF001).collect()
        assert got and all(r["within_error"] for r in got)
