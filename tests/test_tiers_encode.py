"""Tier expression on fixed cases and by bisection; encoders."""

import bisect
import random

from pyspark.sql import functions as F

from riskrules import Params
from riskrules.functions.exprs import tier_expr
from riskrules.operators import encode
from riskrules.sources.fixtures import tx_frame

from .conftest import SF0001

P = Params()


EDGES = [0.0, 0.2, 0.5, 0.8, 1.0]
#: rate, edges, tier
TIERS = [
    (None, EDGES, "unknown"), (-0.5, EDGES, "low"), (0.0, EDGES, "low"), (0.2, EDGES, "low"), (0.21, EDGES, "medium"),
    (0.5, EDGES, "medium"), (0.8, EDGES, "high"), (0.81, EDGES, "very_high"), (1.0, EDGES, "very_high"),
    (1.01, EDGES, "unknown"), (0.3, [0.3], "unknown"), (0.3, [], "unknown"), (0.3, None, "unknown"),
    (0.1, [0.1, 0.4], "low"), (0.4, [0.1, 0.4], "low"), (0.5, [0.1, 0.4], "unknown"), (0.7, [0.1, 0.4, 0.9], "medium"),
]


def test_tier_of_fixed_cases(spark):
    df = spark.createDataFrame([(r, b) for r, b, _ in TIERS], "rate double, bins array<double>")
    assert [r[0] for r in df.select(tier_expr("rate", "bins")).collect()] == [t for _, _, t in TIERS]


def test_tier_by_bisection(spark):
    rng = random.Random(23)
    cases = [(rng.random(), sorted(rng.sample([0.05, 0.1, 0.3, 0.6, 0.9, 0.99], rng.randint(2, 5)))) for _ in range(200)]
    df = spark.createDataFrame(cases, "rate double, bins array<double>")
    for (rate, edges), row in zip(cases, df.select(tier_expr("rate", "bins")).collect(), strict=True):
        under = bisect.bisect_left(edges, rate)
        names = ["low", "low", "medium", "high", "very_high"]
        assert row[0] == ("unknown" if under == len(edges) else names[under])


def test_tier_monotone_in_rate(spark):
    bins = [0.0, 0.2, 0.5, 0.8, 1.0]
    rates = [i / 100 for i in range(101)]
    df = spark.createDataFrame([(r, bins) for r in rates], "rate double, bins array<double>")
    order = {"low": 1, "medium": 2, "high": 3, "very_high": 4}
    got = [order[r[0]] for r in df.orderBy("rate").select(tier_expr("rate", "bins")).collect()]
    assert got == sorted(got)


def test_onehot_rows_sum_to_one_or_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,)], "c string")
    counts = encode.category_counts(df, ["c"])
    labels, freq = encode.plan_encoding(counts, ["c"], P)
    assert freq == [] and labels["c"][0] == "b"  # most frequent first
    assert "__empty__" in labels["c"]
    out = df.select("c", *encode.onehot_columns("c", labels["c"]))
    sums = {r["c"]: sum(r[i] for i in range(1, len(out.columns))) for r in out.collect()}
    assert sums == {"a": 1.0, "b": 1.0, "": 1.0, None: 0.0}


def test_cardinality_counts_null_and_threshold(spark):
    tx = tx_frame(spark, SF0001)
    counts = encode.category_counts(tx, ["card_profile_dep", "part_id"])
    card = {r["feature"]: r["n_distinct"] for r in encode.cardinality(counts).collect()}
    assert card["card_profile_dep"] == 5
    labels, freq = encode.plan_encoding(counts, ["card_profile_dep", "part_id"], P)
    assert freq == ["part_id"] and len(labels["card_profile_dep"]) == 5


def test_frequency_sums_to_one(spark):
    tx = tx_frame(spark, SF0001)
    counts = encode.category_counts(tx, ["part_id"])
    total = encode.frequency_table(counts, "part_id").agg(F.sum("part_id_freq")).first()[0]
    assert abs(total - 1.0) < 1e-9


def test_fill_sentinel_numeric_only(spark):
    df = spark.createDataFrame([(None, None, None)], "a double, b boolean, c string")
    r = encode.fill_sentinel(df).first()
    assert r["a"] == -1.0 and r["b"] is None and r["c"] is None
