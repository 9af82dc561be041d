"""Rule matching with wildcards and intervals against brute force on a small fixture."""

import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskrules import Params, Roles
from riskrules.functions.rank import global_rank
from riskrules.operators import bands, patterns, rules, ruleset

ROLES = Roles(interval_score="cs")
P = Params(min_support=3, target_precision=0.0, max_rules=4)
FEATS = ["cs", "cat", "n"]
SCHEMA = "is_fraud int, amount double, fraud_score double, cs double, cat string, n int"


def make_rows(seed=11, count=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        rows.append(
            (
                rng.choice([0, 1, 1, None]),
                rng.choice([500.0, 2999.99, 3000.0, 7000.5, 20000.0, 60000.0, 150000.0, None]),
                55.0,
                rng.choice([None, 0.0, 0.1, 0.3, 0.35, 0.5, 0.95, 1.0]),
                rng.choice([None, "x", "y", "o'k"]),
                rng.choice([None, -1, 1, 2]),
            )
        )
    return rows


def bucket_of(amount, t=P.amount_thresholds):
    if amount is None:
        return None
    for i, x in enumerate(t):
        if amount <= x:
            return i
    return len(t)


def matches(row, rule):
    if bucket_of(row["amount"]) != rule["amount_bucket"]:
        return False
    for c in rule["conditions"]:
        v = row[c["feature"]]
        if v is None:
            return False
        if c["op"] == "range":
            if not (c["lo"] <= v < c["hi"]):
                return False
        elif str(v) != c["value"]:
            return False
    return True


@pytest.fixture(scope="module")
def mined(spark):
    data = make_rows()
    df = bands.with_amount_bucket(spark.createDataFrame(data, SCHEMA), ROLES, P)
    flagged = F.col("is_fraud") == 1
    pats = patterns.mine_patterns(df, flagged, FEATS, ROLES, P)
    rl = patterns.rule_conditions(pats, FEATS, ROLES, P).persist()
    ev = rules.evaluate_rules(df, rl, FEATS, ROLES, P).persist()
    rows = [r.asDict() for r in df.collect()]
    return df, rl, ev, rows


def test_wildcards_present(mined):
    _, rl, _, _ = mined
    masks = rules.masks_of(rl)
    assert len(masks) > 1, "fixture should produce several wildcard masks"


def test_rule_eval_equals_brute_force(mined):
    _, _, ev, rows = mined
    out = ev.collect()
    assert out
    for r in out:
        hit = [x for x in rows if matches(x, r)]
        n = len(hit)
        frauds = sum(1 for x in hit if x["is_fraud"] is not None and x["is_fraud"] == 1)
        cap = sum((Decimal(str(x["amount"])) for x in hit if x["is_fraud"] == 1), Decimal(0))
        assert r["num_transactions"] == n, r["rule_string"]
        assert r["num_frauds"] == frauds
        assert abs(r["captured_fraud_amount"] - float(cap)) < 1e-6
        if r["cs"] is None or r["cs"] + 0.05 <= 1.0:
            # a pattern at the top of the score scale gets [v - w, 1.0), which
            # excludes v = 1.0 itself (half-open interval clipped at 1)
            assert r["support"] <= n


def test_wildcard_values_put_no_condition(mined):
    _, rl, _, _ = mined
    for r in rl.collect():
        feats = {c["feature"] for c in r["conditions"]}
        if r["n"] is None or r["n"] == -1:
            assert "n" not in feats
        if r["cat"] is None:
            assert "cat" not in feats
        if r["cs"] is None:
            assert "cs" not in feats


def test_interval_bounds_and_text(mined):
    _, rl, _, _ = mined
    r = rl.where(F.col("cs") == 1.0).first()
    if r is not None:
        c = [c for c in r["conditions"] if c["feature"] == "cs"][0]
        assert (c["lo"], c["hi"]) == (0.95, 1.0)
        assert "event.cs >= 0.950 AND event.cs < 1.000" in r["rule_string"]
    q = rl.where(F.col("cat") == "o'k").first()
    if q is not None:
        assert "event.cat = 'o\\'k'" in q["rule_string"]


def test_precision_gate_and_rank(mined):
    _, _, ev, _ = mined
    kept = rules.keep_precise(ev, P.with_(target_precision=0.5))
    assert all(r["precision"] >= 0.5 for r in kept.collect())
    ranked = rules.rank_rules(kept, FEATS).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    rec = [r["amount_recall"] for r in ranked]
    assert rec == sorted(rec, reverse=True)


def test_hits_and_union_metrics_brute_force(mined):
    df, _, ev, rows = mined
    sel = ruleset.choose(rules.rank_rules(ev, FEATS), P).persist()
    chosen = sel.collect()
    hit = [x for x in rows if any(matches(x, r) for r in chosen)]
    assert ruleset.hits(df, sel, FEATS, ROLES, P).count() == len(hit)
    um = ruleset.union_metrics(df, sel, FEATS, ROLES, P).first()
    add = ruleset.metrics(sel).first()
    assert um["union_transactions"] == len(hit)
    assert um["union_transactions"] <= add["total_transactions"]
    assert um["union_frauds"] <= add["total_frauds"]
    assert add["total_rules"] == len(chosen)
    text = ruleset.combined_rule(sel).first()["combined_rule"]
    assert text.count(" OR ") == len(chosen) - 1


def test_no_rules_gives_empty_metrics(spark):
    df = bands.with_amount_bucket(spark.createDataFrame(make_rows(count=20), SCHEMA), ROLES, P)
    pats = patterns.mine_patterns(df, F.lit(False), FEATS, ROLES, P)
    rl = patterns.rule_conditions(pats, FEATS, ROLES, P)
    ev = rules.evaluate_rules(df, rl, FEATS, ROLES, P)
    sel = ruleset.choose(rules.rank_rules(ev, FEATS), P)
    m = ruleset.metrics(sel).first()
    assert m["total_rules"] == 0 and m["average_precision"] is None
    assert ruleset.hits(df, sel, FEATS, ROLES, P).count() == 0


def test_global_rank_matches_sort(spark):
    rng = random.Random(3)
    data = [(i, rng.random(), rng.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(data, "id int, v double, g int")
    out = global_rank(df, [F.desc("v"), F.asc("id")], partitions=7).collect()
    exp = {row[0]: k + 1 for k, row in enumerate(sorted(data, key=lambda t: (-t[1], t[0])))}
    assert {r["id"]: r["rank"] for r in out} == exp


def test_global_rank_of_many_rows_with_payload(spark):
    """Beyond the range sample, several partitions, written out with a payload."""
    df = spark.range(0, 300_000, 1, 8).select("id", F.rand(5).alias("v"), F.concat(F.lit("p"), F.col("id")).alias("payload"))
    path = tempfile.mkdtemp(prefix="riskrules-rank-")
    df.write.mode("overwrite").parquet(f"{path}/in")
    df = spark.read.parquet(f"{path}/in")
    global_rank(df, [F.asc("v"), F.asc("id")], partitions=8).write.parquet(f"{path}/out")
    out = spark.read.parquet(f"{path}/out")
    s = out.agg(F.countDistinct("rank").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).first()
    assert (s["n"], s["lo"], s["hi"]) == (300_000, 1, 300_000)
    pdf = out.select("rank", "v", "id").toPandas().sort_values("rank")
    assert pdf["v"].is_monotonic_increasing


def test_bins_of_many_rates_equal_percentile(spark):
    """A million rates, most of them in a tiny range."""
    from riskrules.operators.tiers import risk_bins

    value = F.when(F.col("id") % 10 == 0, F.rand(9)).otherwise(0.25 + F.col("id") * 1e-12)
    path = tempfile.mkdtemp(prefix="riskrules-rates-")
    spark.range(0, 1_000_000, 1, 8).select(value.alias("rate")).write.mode("overwrite").parquet(path)
    rates = spark.read.parquet(path)
    a = risk_bins(rates, "rate", P).first()["bins"]
    b = rates.distinct().agg(F.percentile("rate", F.array(*[F.lit(float(p)) for p in P.tier_percentiles])).alias("b")).first()["b"]
    assert len(a) == len(b) == 5 and all(abs(x - y) < 1e-12 for x, y in zip(a, b, strict=True))


def test_percentiles_of_groups_by_definition(spark):
    """Shrinking ranges with few parts and early reading, repeats and extremes."""
    import numpy as np

    from riskrules.functions.order_stats import percentiles

    rng = random.Random(5)
    groups = {
        0: [rng.random() for _ in range(500)], 1: [0.5], 2: [rng.choice([1.0, 2.0, 3.0]) for _ in range(300)],
        3: [1e308, -1e308, 0.0, *(rng.random() * 1e-300 for _ in range(200))], 4: [2.0**-k for k in range(400)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "group long, value double")
    pcts = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    got = percentiles(df, pcts, digits=4, stop=8)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        if g == 3:
            assert got[g][0] == -1e308 and got[g][-1] == 1e308
            continue
        assert np.allclose(got[g], np.quantile(vs, pcts), rtol=1e-12, atol=0)
    assert percentiles(df.limit(0), pcts) == {}


def lattice_by_definition(rows, features, least, flagged):
    from itertools import combinations

    count = {}
    for r in rows:
        if not flagged(r) or bucket_of(r["amount"]) is None:
            continue
        v = {f: None if r[f] is None or r[f] == -1 else (round(r[f] * 10) / 10 if f == "cs" else r[f]) for f in features}
        for size in range(1, len(features) + 1):
            for s in combinations(features, size):
                if all(v[f] is not None for f in s):
                    key = (bucket_of(r["amount"]), *(v[f] if f in s else None for f in features))
                    count[key] = count.get(key, 0) + 1
    return {k: n for k, n in count.items() if n >= least}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_lattice_by_definition(spark, most):
    """Subsets of columns with NULL, -1 and an id that never repeats, with and without broadcasts."""
    rows = make_rows(seed=3, count=500)
    data = [(*r, i) for i, r in enumerate(rows)]
    feats = ["one", *FEATS]
    df = bands.with_amount_bucket(spark.createDataFrame(data, SCHEMA + ", one int"), ROLES, P)
    params = P.with_(min_support=4, max_broadcast_rows=most)
    flag = F.col("is_fraud") == 1
    got = {tuple(r)[:-1]: r["support"] for r in patterns.mine_lattice(df, flag, feats, ROLES, params).collect()}
    dicts = [r.asDict() for r in df.collect()]
    # values halfway between two cells are rounded by Spark's own rule
    grid = {r["cs"]: r["g"] for r in df.select("cs", patterns.on_grid(F.col("cs"), params).alias("g")).distinct().collect()}
    want = lattice_by_definition([{**r, "cs": grid[r["cs"]]} for r in dicts], feats, 4, lambda r: r["is_fraud"] == 1)
    assert got == want and len({tuple(v is None for v in k) for k in got}) > 5
    top = {tuple(r)[:-1] for r in patterns.mine_lattice(df, flag, feats, ROLES, params, maximal=True).collect()}

    def extends(a, b):
        return a != b and a[0] == b[0] and all(y is None or x == y for x, y in zip(a[1:], b[1:], strict=True))

    assert top == {k for k in want if not any(extends(q, k) for q in want)}
    assert patterns.mine_lattice(df, F.lit(False), feats, ROLES, params).count() == 0
    assert patterns.mine_lattice(df, flag, [], ROLES, params).count() == 0


def test_one_join_whatever_the_number_of_masks(spark, mined):
    """Rules meet cells in one join on their filing atom; hit rows in one semi join."""
    df, rl, ev, _ = mined
    masks = rules.mask_counts(rl)
    assert len(masks) > 3
    cells = rules.rule_cells(df, FEATS, ROLES)
    plan = rules.match_rules(cells, rl, FEATS, ROLES, P, masks=masks)._jdf.queryExecution().optimizedPlan().toString()
    # distinct atoms, their counts, the filing and the match: none of them per mask
    assert plan.count("Join ") <= 4 and "Union" not in plan
    best = ruleset.choose(rules.rank_rules(ev, FEATS), P, 5)
    hit = ruleset.hits(df, best, FEATS, ROLES, P)._jdf.queryExecution().optimizedPlan().toString()
    assert hit.count("LeftSemi") == 1 and "ExistenceJoin" not in hit


def test_rules_that_differ_in_their_wildcard_only(spark):
    """('Y', NULL) and (NULL, 'Y') are two rules, measured apart."""
    schema = "is_fraud int, amount double, fraud_score double, a string, b string"
    rows = [(1, 10.0, 55.0, "Y", None)] * 60 + [(0, 10.0, 55.0, None, "Y")] * 100
    df = bands.with_amount_bucket(spark.createDataFrame(rows, schema), Roles(), P)
    pats = patterns.mine_patterns(df, F.lit(True), ["a", "b"], Roles(), P)
    ev = rules.evaluate_rules(df, patterns.rule_conditions(pats, ["a", "b"], Roles(), P), ["a", "b"], Roles(), P)
    got = {(r["a"], r["b"]): (r["num_transactions"], r["num_frauds"], r["precision"]) for r in ev.collect()}
    assert got == {("Y", None): (60, 60, 1.0), (None, "Y"): (100, 0, 0.0)}


def test_amounts_are_not_rounded(spark):
    from riskrules.functions.exprs import money_sum

    def total(*xs):
        return spark.createDataFrame([(x,) for x in xs], "a double").agg(money_sum("a").alias("s")).first()["s"]

    assert total(0.004, 0.004, 1.2345) == 1.2425
    assert total(-0.5, -0.25, 2.0, None) == 1.25
    assert total(None, None) is None
    assert total(1.0, float("nan")) != total(1.0, float("nan"))
    assert total(1.0, float("inf")) == float("inf")
    assert total(*[0.1] * 1000) == 100.0


def test_score_grid_is_the_interval(spark):
    from riskrules.operators.patterns import on_grid

    p = P.with_(score_half_width=0.25)
    df = spark.createDataFrame([(0.1,), (0.3,), (0.6,), (0.8,)], "x double")
    assert [r[0] for r in df.select(on_grid(F.col("x"), p)).collect()] == [0.0, 0.5, 0.5, 1.0]


def test_top_rules_equal_the_first_of_the_ranking(mined):
    _, _, ev, _ = mined
    ranked = [r["rule_string"] for r in rules.rank_rules(ev, FEATS).where("rank <= 4").orderBy("rank").collect()]
    chosen = ruleset.choose(ev, P, 4, features=FEATS).orderBy("rank").collect()
    assert [r["rank"] for r in chosen] == [1, 2, 3, 4] and [r["rule_string"] for r in chosen] == ranked
