"""Schema-checked read and versioned publishing."""

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskrules import Roles
from riskrules.sources.conform import conform
from riskrules.sources.publish import publish, read_published, versions

RAW = "id string, amount string, n double, big long, day string, flag boolean, extra int"
TARGET = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("n", T.IntegerType(), True),
        T.StructField("big", T.IntegerType(), True),
        T.StructField("day", T.DateType(), True),
        T.StructField("flag", T.IntegerType(), True),
        T.StructField("note", T.StringType(), True),
    ]
)
ROWS = [
    ("a", "1.5", 2.0, 7, "2024-02-29", True, 1),
    ("b", "n/a", 2.5, 2**31, "2023-02-29", None, 1),
    (None, None, None, None, None, False, None),
    ("", "NaN", math.nan, -(2**31), None, True, 1),
    ("e", "1e3", -0.0, None, "2024-01-01", False, 1),
    ("e", "1e3", -0.0, None, "2024-01-01", False, 1),
]


def test_conform_splits_rows_and_names_reasons(spark):
    got = conform(spark.createDataFrame(ROWS, RAW), TARGET)
    assert [(f.name, f.dataType) for f in got.rows.schema.fields] == [(f.name, f.dataType) for f in TARGET.fields]
    rows = sorted(tuple(r) for r in got.rows.select("id", "amount", "n", "big", F.col("day").cast("string"), "flag", "note").collect())
    assert rows == [("a", 1.5, 2, 7, "2024-02-29", 1, None)] + 2 * [("e", 1000.0, 0, None, "2024-01-01", 0, None)]
    bad = {json.loads(r["row"])["id"]: {(e["column"], e["reason"]) for e in r["errors"]} for r in got.rejected.collect()}
    assert bad == {
        "b": {("amount", "type"), ("n", "lossy"), ("big", "type"), ("day", "type")},
        None: {("id", "null"), ("amount", "null")},
        "": {("n", "type")},
    }
    report = {(r["column"], r["reason"]): r["n"] for r in got.report.collect()}
    assert report[("n", "type")] == 1 and report[("n", "lossy")] == 1 and sum(report.values()) == 7


def test_conform_keeps_the_row_as_read(spark):
    got = conform(spark.createDataFrame(ROWS, RAW), TARGET).rejected.collect()
    seen = [json.loads(r["row"]) for r in got if json.loads(r["row"])["id"] == "b"]
    assert seen == [{"id": "b", "amount": "n/a", "n": 2.5, "big": 2**31, "day": "2023-02-29", "flag": None, "extra": 1}]


def test_conform_large_integers_and_floats(spark):
    target = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.FloatType())])
    df = spark.createDataFrame([(2**53, 0.1), (2**53 + 1, 0.1)], "x long, y double")
    got = conform(df, target)
    assert [r["x"] for r in got.rows.collect()] == [float(2**53)]
    assert [(e["column"], e["reason"]) for r in got.rejected.collect() for e in r["errors"]] == [("x", "lossy")]


def test_conform_names_all_faults_of_the_table(spark):
    df = spark.createDataFrame([([1], 1)], "amount array<int>, flag int")
    with pytest.raises(ValueError, match="id: missing; amount: no conversion from array<int> to double"):
        conform(df, TARGET)


def test_conform_empty_table_and_odd_names(spark):
    got = conform(spark.createDataFrame([], RAW), TARGET)
    assert got.rows.count() == got.rejected.count() == got.report.count() == 0
    odd = spark.createDataFrame([("x",), ("1",)], "`a.b` string")
    out = conform(odd, T.StructType([T.StructField("a.b", T.LongType())]))
    assert [r[0] for r in out.rows.collect()] == [1] and out.rejected.count() == 1


def test_conform_reads_once_without_shuffle(spark):
    plan = conform(spark.createDataFrame(ROWS, RAW), TARGET).rows._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_roles_check_types(spark):
    df = spark.createDataFrame([("1", 2.0, 55.0)], "is_fraud string, amount double, fraud_score double")
    with pytest.raises(ValueError, match="is_fraud \\(string\\)"):
        Roles().check(df)


def test_publish_twice_and_read_back(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="riskrules-publish-"), "rules")
    assert versions(spark, base).count() == 0
    with pytest.raises(LookupError):
        read_published(spark, base)
    one = spark.createDataFrame([(1, "x"), (2, None)], "rank int, rule string")
    two = spark.createDataFrame([], "rank int, rule string, more double")
    assert (publish(one, base), publish(two, base)) == (1, 2)
    assert read_published(spark, base).columns == ["rank", "rule", "more"] and read_published(spark, base).count() == 0
    assert sorted(map(tuple, read_published(spark, base, 1).collect())) == [(1, "x"), (2, None)]
    assert {r["version"]: r["rows"] for r in versions(spark, base).collect()} == {1: 2, 2: 0}
    with pytest.raises(LookupError):
        read_published(spark, base, 3)


def test_interrupted_publish_leaves_the_old_version(spark, monkeypatch):
    base = os.path.join(tempfile.mkdtemp(prefix="riskrules-publish-"), "rules")
    good = spark.range(100).select(F.col("id").alias("rank"))
    publish(good, base)
    # the write dies in one task after others have written
    dying = spark.range(0, 100, 1, 4).select(
        F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("rank")
    )
    with pytest.raises(Exception, match="lost"):
        publish(dying, base)
    assert read_published(spark, base).count() == 100 and versions(spark, base).count() == 1
    # the rules are written whole but the publisher dies before the manifest is
    from riskrules.sources import publish as module

    real = module.versions
    calls = []

    def once(session, where):
        calls.append(where)
        return real(session, where)

    monkeypatch.setattr(module, "versions", once)
    made = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        module.publish(good.limit(5), base)
    monkeypatch.setattr(type(spark), "createDataFrame", made)
    assert calls and read_published(spark, base).count() == 100
    assert publish(good.limit(5), base) == 2 and read_published(spark, base).count() == 5
