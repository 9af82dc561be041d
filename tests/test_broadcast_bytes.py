"""Broadcasts are decided by measured rows and bytes, summed over a plan."""

import pytest
from pyspark.sql import functions as F

from riskrules import Params, preprocess
from riskrules.functions.joins import Budget, attach, measure
from riskrules.operators.profiles import PopulationStats
from riskrules.sources.fixtures import FIXTURE_ROLES, tx_frame

from .conftest import SF0001


def hinted(df) -> int:
    """Broadcast hints that the analysed plan holds."""
    return df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast")


def keyed(spark, width: int):
    return spark.range(500).select(F.lpad(F.col("id").cast("string"), width, "k").alias("k"), F.lit(3).alias("n"), F.col("id").alias("v"))


def test_measure_counts_texts_in_bytes(spark):
    df = spark.createDataFrame([("é", 1), (None, 2), ("abc", None)], "t string, n long")
    rows, nbytes = measure(df)
    assert rows == 3 and nbytes == 3 * (32 + 8 + 8) + 2 + 3
    assert measure(df.limit(0)) == (0, 0)


def test_wide_keys_change_the_path_not_the_result(spark):
    params = Params(max_broadcast_bytes=100_000, rows_per_task=1)
    for width, hints in ((8, 1), (1000, 2)):
        rows = keyed(spark, width).select("k").unionByName(keyed(spark, width).select("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
        out = attach(rows, keyed(spark, width), "k", params, count_col="n")
        # one hint: the keyed table; two: the bounded list of hot keys on both sides of the salted join
        assert hinted(out) == hints and ("__salt" in out._jdf.queryExecution().analyzed().toString()) == (hints == 2)
        got = out.groupBy().agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("v")).first()
        assert (got["c"], got["v"]) == (1001, 2 * sum(range(500)))


def test_budget_is_shared_by_the_joins_of_a_plan(spark):
    params, budget = Params(), Budget(60_000)
    rows = keyed(spark, 8).select("k")
    one = measure(keyed(spark, 8))[1]
    assert one <= 60_000 < 2 * one + one
    taken = [budget.takes(500, one, params) for _ in range(4)]
    assert taken == [n * one <= 60_000 for n in (1, 2, 3, 4)] and not taken[-1]
    assert budget.left == 60_000 - sum(taken) * one
    assert hinted(attach(rows, keyed(spark, 8), "k", params, budget=Budget(0))) == 0
    assert not Budget(10**9).takes(params.max_broadcast_rows + 1, 10, params)


@pytest.mark.parametrize("own", [True, False])
def test_population_knows_the_sizes(spark, own):
    tx = tx_frame(spark, SF0001)
    params = Params(own_label=own)
    stats = PopulationStats(tx, FIXTURE_ROLES, params, FIXTURE_ROLES.categoricals)
    for key in FIXTURE_ROLES.ids:
        prof = stats.profile(key)
        rows, nbytes = stats.size(key, prof)
        assert (rows, nbytes) == measure(prof) and rows == stats.cardinalities()[key]


def test_same_band_with_and_without_broadcasts(spark):
    tx = tx_frame(spark, SF0001)
    a, b = (preprocess(tx, FIXTURE_ROLES, Params(max_broadcast_bytes=n)) for n in (10**9, 0))
    assert a.band.exceptAll(b.band.select(a.band.columns)).count() == 0 and a.band.count() == b.band.count()
