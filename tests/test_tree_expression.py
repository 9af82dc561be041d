"""The tree as an expression against the fitted model, on tables and on a stream."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskrules import Params, Roles
from riskrules.operators import model
from riskrules.operators.encode import fill_sentinel
from riskrules.plans import queries as Q
from riskrules.streaming import score_events

from .conftest import SF001

ROLES = Roles(label="y", amount="amount", score="score", ids=(), categoricals=())


def rows_with_gaps(spark):
    """Numbers with NULL and NaN, flags with NULL, an input name that needs quotes."""
    i = F.col("id")
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    return spark.range(0, 4000, 1, 4).select(
        (((h > 600) & (i % 3 == 0)) | (h > 900)).cast("int").alias("y"),
        F.when(i % 7 == 0, None).when(i % 11 == 0, float("nan")).otherwise(h / 10.0).alias("a.b"),
        F.when(i % 5 != 0, i % 3 == 0).alias("flag"),
        F.when(i % 13 != 0, (h % 50).cast("int")).alias("n"),
    )


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_expression_equals_model(spark, depth):
    df = rows_with_gaps(spark).withColumnRenamed("a.b", "a_b")
    inputs = ["a_b", "flag", "n"]
    # the learner takes no NaN: numbers are filled as the workflow does, flags keep their NULLs
    filled = fill_sentinel(df)
    m = model.train(filled, inputs, ROLES, Params(max_depth=depth, min_instances_per_node=20))
    nodes = model.tree_nodes(spark, m, inputs)
    differ = (F.col("t.prediction") != F.col("prediction")) | (F.col(f"t.{model.PROB}") != F.col(model.PROB))
    # rows with NULL and NaN numbers are scored alike, too
    assert model.score(m, df).withColumn("t", model.tree_column(df, nodes)).where(differ).count() == 0
    both = model.score(m, filled).withColumn("t", model.tree_column(filled, nodes))
    assert both.where(differ).count() == 0
    counts = {r["leaf_id"]: r["count"] for r in both.groupBy("t.leaf_id").count().collect()}
    assert counts == {r["node_id"]: r["rows"] for r in nodes.where("is_leaf").collect()}
    assert depth == 0 or len(counts) > 1


def test_columns_that_need_quotes(spark):
    nodes = spark.createDataFrame(
        [(1, False, "a.b", 50.0, 0.0, 0.1), (2, True, None, None, 0.0, 0.0), (3, True, None, None, 1.0, 0.9)], Q.TREE_COLUMNS
    )
    out = model.score_by_tree(rows_with_gaps(spark), nodes)
    # NULL and NaN go right
    assert out.where("leaf_id = 2").count() == out.where("`a.b` <= 50").count()
    assert out.where("leaf_id = 3").count() == out.where("`a.b` IS NULL OR NOT `a.b` <= 50").count()


def test_categorical_split_is_refused(spark):
    nodes = spark.createDataFrame([(1, False, "n", None, 0.0, 0.1), (2, True, None, None, 0.0, 0.0), (3, True, None, None, 1.0, 0.9)], Q.TREE_COLUMNS)
    with pytest.raises(ValueError, match="splits n by categories"):
        model.tree_column(rows_with_gaps(spark), nodes)


def test_stream_scored_as_the_table(spark):
    rows = Q._tree_rows(spark, SF001).drop("leaf_id", "prediction", model.PROB)
    nodes = spark.createDataFrame(Q.STATED_TREE, Q.TREE_COLUMNS)
    d = tempfile.mkdtemp(prefix="riskrules-score-")
    rows.write.parquet(os.path.join(d, "in"))
    stream = score_events(spark.readStream.schema(rows.schema).parquet(os.path.join(d, "in")), nodes, Q.P)
    q = (
        stream.writeStream.format("memory").queryName("tree_scored").outputMode("append")
        .option("checkpointLocation", os.path.join(d, "ckpt")).start()
    )
    q.processAllAvailable()
    q.stop()
    assert spark.table("tree_scored").count() == score_events(rows, nodes, Q.P).count() == 5561


def test_registered_agreement(spark):
    r = Q.q_tree_agreement(spark, SF001).first()
    assert r["rows"] == 12023 and r["predictions_differ"] == r["probabilities_differ"] == r["flags_differ"] == 0
