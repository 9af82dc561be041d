"""What the queries shuffle, store and compile stays in step with the input."""

import re
import tempfile
import time

import pytest
from pyspark.sql import functions as F

import riskrules.plans.queries as Q
from riskrules import Params, preprocess
from riskrules.functions import joins
from riskrules.operators import encode, profiles, tiers
from riskrules.operators.profiles import PopulationStats
from riskrules.sources import fixtures
from riskrules.sources.fixtures import FIXTURE_ROLES, tx_frame

from .conftest import SF0001

P = Params()


def tables(spark) -> str:
    """Six tiny tables whose keys repeat, miss their partner or are NULL."""
    d = tempfile.mkdtemp(prefix="riskrules-tx-")
    lines = [
        (o, p, s, n, float(n), 10.0 * n, 0.06, t, f, "F" if n % 2 else "O")
        for n, (o, p, s, t, f) in enumerate(
            [(1, 5, 7, 0.04, "R"), (1, 5, 7, 0.04, "R"), (2, 6, 8, 0.07, "N"), (3, 6, 9, 0.01, "A"), (None, 5, 7, 0.02, "N"),
             (2, None, 8, None, None), (4, 5, None, 0.03, "R"), (9, 5, 7, 0.03, "R")]
        )
    ]
    made = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string"),
        "orders": ([(1, 1, "P", "1-URGENT"), (2, 2, "O", None), (2, 2, "F", "5-LOW"), (3, None, "O", "5-LOW"), (4, 1, None, "5-LOW"), (None, 1, "P", "x")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "customer": ([(1, 1), (2, 2), (2, 1), (None, 1)], "c_custkey long, c_nationkey int"),
        "supplier": ([(7, 1), (8, 2), (8, 2), (9, None), (None, 1)], "s_suppkey long, s_nationkey int"),
        "nation": ([(1, "FRANCE"), (2, "PERU")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def plain_tx(spark, d: str):
    """The view in the order of its SQL."""
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    c = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cn"))
    s = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("sn"))
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    fraud = "IF((l_returnflag = 'R' AND l_tax >= 0.035) OR l_tax >= 0.065, 1, 0)"
    return j.selectExpr(
        "l_suppkey", "o_custkey", "l_partkey", "l_extendedprice", fraud, "round(l_discount * 1000, 0)", "round(l_tax * 10, 1)",
        "cast(l_linenumber AS string)", "o_orderpriority", "cast(l_quantity AS int)", "sn", "cn", "IF(l_linestatus = 'F', 'Y', 'N')",
        "CASE WHEN o_orderstatus = 'P' THEN 'N' WHEN o_orderstatus = 'O' THEN 'C' ELSE 'F' END",
    )


@pytest.mark.parametrize("few", [0, 200_000])
def test_tx_rows_with_repeated_and_null_keys(spark, monkeypatch, few):
    monkeypatch.setattr(fixtures, "FEW_ORDERS", few)
    d = tables(spark)
    got, wanted = ([str(tuple(r)) for r in df.collect()] for df in (tx_frame(spark, d), plain_tx(spark, d)))
    assert sorted(got) == sorted(wanted) and len(got) > 8


def test_line_items_are_shuffled_once(spark, monkeypatch):
    """Only orders meet customers by key; the line items move by order alone."""
    monkeypatch.setattr(fixtures, "FEW_ORDERS", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = tx_frame(spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    by = re.findall(r"Exchange hashpartitioning\((\w+)#", p)
    assert sorted(by) == ["c_custkey", "l_orderkey", "o_custkey", "o_orderkey"]


def persisted(spark, monkeypatch) -> list:
    """Columns of the tables that are persisted from now on."""
    frame, kept = type(spark.range(1)), []
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a: (kept.append(self.columns), persist(self, *a))[1])
    return kept


def scans(monkeypatch, run) -> list:
    """The aggregates over the whole view that a query asks for."""
    made = []
    for name in ("entity_profile", "entity_rates"):
        f = getattr(profiles, name)
        monkeypatch.setattr(profiles, name, lambda *a, f=f, **b: (made.append(f(*a, **b)), made[-1])[1])
    run()
    return made


def test_tier_onehot_aggregates_once(spark, monkeypatch):
    kept = persisted(spark, monkeypatch)
    Q.q_tier_onehot(spark, SF0001)
    # the profile is kept before bins, labels and join read it, and only what they read
    assert kept[0] == ["mch_id_trimmed", "merchant_fraud_rate", "merchant_tx_count"]


def test_tiers_keep_the_rate_alone(spark, monkeypatch):
    kept = persisted(spark, monkeypatch)
    Q.q_risk_tier_id(spark, SF0001)
    assert kept[0] == ["part_id", "part_id_fraud_rate"]


def test_risk_bins_from_one_aggregate(spark, monkeypatch):
    assert len(scans(monkeypatch, lambda: Q.q_risk_bins(spark, SF0001))) == 1


def test_rates_and_bins_of_several_keys(spark):
    rows = [("a", 1, 1), ("a", None, 0), (None, 1, 1), ("b", 2, None), (None, None, 0), ("a", 2, 1)]
    df = spark.createDataFrame(rows, "mch_id_trimmed string, issuer_member int, is_fraud int").withColumn("amount", F.lit(1.0))
    keys = ["mch_id_trimmed", "issuer_member"]
    rates = profiles.entity_rates(df, keys, FIXTURE_ROLES)
    bins = {r["entity"]: r["bins"] for r in tiers.risk_bins(rates, "rate", P, by="entity").collect()}
    for i, key in enumerate(keys):
        alone = profiles.entity_profile(df, key, FIXTURE_ROLES, P)
        rate = profiles.measure_names(key, FIXTURE_ROLES)["rate"]
        order = lambda rs: sorted((r[0] is None, r[0] or 0.0) for r in rs)
        assert order(rates.where(F.col("entity") == i).select("rate").collect()) == order(alone.select(rate).collect())
        assert bins[i] == tiers.risk_bins(alone, rate, P).first()["bins"]
    with pytest.raises(ValueError):
        tiers.risk_bins(rates, "rate", P, by="entity", approx=True)


def test_an_id_is_counted_once_as_a_category(spark):
    rows = [(1, "", 1, 2.0), (1, "__empty__", 0, 3.0), (None, None, 1, 4.0), (2, "", 0, 5.0)]
    df = spark.createDataFrame(rows, "part_id long, mch_id_trimmed string, is_fraud int, amount double")
    roles = FIXTURE_ROLES.with_(ids=("part_id", "mch_id_trimmed"), categoricals=())
    cats = ["part_id", "mch_id_trimmed"]
    st = PopulationStats(df, roles, P, cats)
    # the number's own set serves both; a text id keeps a set of its category ("" and its token are one value)
    assert len(set(st.gid.values())) == 3 and st.rows() == 4
    norm = lambda d: sorted(str(tuple(r)) for r in d.collect())
    assert norm(st.counts) == norm(encode.category_counts(df, cats))
    table = encode.frequency_table(st.counts, "part_id")
    n, nbytes = st.size("part_id", table, categorical=True)
    assert (n, nbytes >= joins.measure(table)[1]) == (joins.measure(table)[0], True)


def test_stored_band_has_partitions_by_rows(spark):
    tx = tx_frame(spark, SF0001)
    total = tx.count()
    few, many = (preprocess(tx, FIXTURE_ROLES, Params(rows_per_partition=n)).band for n in (total, 100))
    assert many.rdd.getNumPartitions() == -(-total // 100) > few.rdd.getNumPartitions()
    sizes = [r["n"] for r in many.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 100 and sum(sizes) == few.count()
    # the last bits of deviations follow the order of rows
    shown = [c for c in few.columns if not c.endswith(("_enc", "_vec")) and "std" not in c]
    assert few.select(shown).exceptAll(many.select(shown)).count() == 0


def test_band_is_stored_by_compiled_methods(spark, monkeypatch):
    frame, seen = type(spark.range(1)), []
    store = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **b: (seen.append(int(spark.conf.get(joins.METHOD_KEY))), store(self, *a, **b))[1])
    before = spark.conf.get(joins.METHOD_KEY)
    joins.materialize(spark.range(3), P)
    assert seen == [8000] and spark.conf.get(joins.METHOD_KEY) == before


def stored(monkeypatch) -> list:
    """The tables that ``preprocess`` stores from now on."""
    import riskrules.plans.workflow as W

    seen, store = [], W.materialize
    monkeypatch.setattr(W, "materialize", lambda df, params: (seen.append(df), store(df, params))[1])
    return seen


def test_band_is_stored_without_what_is_derived_from_a_row(spark, monkeypatch):
    seen = stored(monkeypatch)
    tx = tx_frame(spark, SF0001)
    whole = preprocess(tx, FIXTURE_ROLES, P)
    only = preprocess(tx, FIXTURE_ROLES, P, columns=["amount"])
    for df in seen:
        assert not [f.name for f in df.schema.fields if f.name.startswith("amount_range_") or f.name.endswith(("_enc", "_vec"))]
    assert set(only.band.columns) == {*only.inputs, "is_fraud", "amount", "amount_bucket"} and set(tx.columns) < set(whole.band.columns)
    assert (only.inputs, only.slots) == (whole.inputs, whole.slots) and only.band.count() > 0
    assert only.band.exceptAll(whole.band.select(only.band.columns)).count() == 0 and only.band.count() == whole.band.count()


def test_rows_are_dealt_by_the_joins_before_they_are_wide(spark, monkeypatch):
    """Two profiles over the limit: each shuffles the rows once, broadcast ones come after, and nothing deals the wide rows anew."""
    seen = stored(monkeypatch)
    tx = tx_frame(spark, SF0001)
    total = tx.count()
    few = preprocess(tx, FIXTURE_ROLES, Params()).band
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = preprocess(tx, FIXTURE_ROLES, Params(max_broadcast_rows=100, rows_per_partition=100)).band
        p = seen[-1]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    n = -(-total // 100)
    assert "Exchange RoundRobin" not in p and len(re.findall(r"Exchange hashpartitioning\(part_id#\d+L, __salt", p)) == 2
    assert len(re.findall(rf"Exchange hashpartitioning\(issuer_member#\d+L, __salt#\d+, {n}\), REPARTITION_BY_NUM", p)) == 2
    # seen from the top: the merchants' broadcast, the issuers, then the parts and their frequency
    at = [re.search(x, p).start() for x in (r"Join \[mch_id_trimmed", r"Join \[issuer_member#\d+L, __salt", r"Join \[part_id#\d+L, __salt")]
    assert at == sorted(at) and "__value" not in p
    assert many.rdd.getNumPartitions() == n and many.columns == few.columns
    shown = [c for c in few.columns if not c.endswith(("_enc", "_vec")) and "std" not in c]
    assert few.select(shown).exceptAll(many.select(shown)).count() == 0 and few.count() == many.count()


def test_shuffles_of_what_is_checkpointed_are_removed(spark):
    def files() -> set:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}

    before = spark.conf.get(joins.CLEANUP_KEY)
    for put in (joins.checkpoint, lambda df: joins.materialize(df, P)):
        df, old = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), files()
        kept, end = put(df), time.time() + 20
        while files() - old and time.time() < end:
            time.sleep(0.1)
        assert not files() - old and kept.count() == 7
    assert spark.conf.get(joins.CLEANUP_KEY) == before


def test_rows_are_dealt_by_id_before_they_are_aggregated(spark, monkeypatch):
    """No partial row per row: the ids are rebalanced first; a frequent id's partition is split, so its parts are summed after."""
    frame, seen = type(spark.range(1)), []
    store = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **b: (seen.append(self), store(self, *a, **b))[1])
    # one id in most rows, NULL ids, and an id that a measure reads
    df = spark.range(4000).selectExpr(
        "if(id % 10 < 8, 7, if(id % 10 = 8, null, id)) part_id", "if(id % 3 = 0, null, id % 5) issuer_member", "id % 100 + 0.25D amount",
        "if(id % 11 = 0, null, cast(id % 4 = 0 AS int)) is_fraud", "if(id % 2 = 0, 'Y', null) trans_status",
        "'FR' merchant_country_code", "if(id % 6 = 0, 'PE', 'FR') issuer_bin_profile_issuing_cou", "concat('c', id % 3) cat",
    ).repartition(8)
    roles = FIXTURE_ROLES.with_(ids=("part_id", "issuer_member", "trans_status"), categoricals=("cat", "part_id"))
    for own in (True, False):
        st = PopulationStats(df, roles, P.with_(own_label=own), roles.categoricals)
        p = seen[-2]._jdf.queryExecution().optimizedPlan().toString()
        assert "RebalancePartitions [__gid" in p and p.index("Aggregate [__gid") < p.index("RebalancePartitions") and "Expand" not in p
        assert re.search(r"Exchange hashpartitioning\(__gid#\d+, __key_0#\d+L, __key_1#\d+L, __key_2#\d+, \d+\), ENSURE", seen[-2]._jdf.queryExecution().executedPlan().toString())
        shown = lambda d: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in d.collect())
        for key in roles.ids:
            alone = profiles.entity_profile(df, key, roles, P)
            assert shown(st.profile(key).select(alone.columns)) == shown(alone)
        assert shown(st.counts) == shown(encode.category_counts(df, roles.categoricals)) and st.rows() == 4000
