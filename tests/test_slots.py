"""Sparse one-hot vectors: values, names in the metadata, importances and splits by slot."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskrules import Params, Roles, preprocess
from riskrules.functions.joins import checkpoint
from riskrules.functions.exprs import category_text
from riskrules.operators import encode, model, slots
from riskrules.operators.encode import category_slots, fill_sentinel
from riskrules.plans import queries as Q
from riskrules.sources.fixtures import FIXTURE_ROLES, tx_frame

from .conftest import SF0001

ROLES = Roles(label="y", amount="amount", score="score", ids=(), categoricals=())
VALUES = [("a",), ("b",), ("b",), ("",), (None,), ("new",)]


def test_vectors_equal_the_dense_columns(spark):
    df = spark.createDataFrame(VALUES, "c string")
    labels = ["b", "__empty__", "a"]
    both = slots.add_slots(df, category_slots("c", labels)).select(
        "c", "c_vec", F.array(*encode.onehot_columns("c", labels)).alias("dense"), slots.active_slot("c_vec").alias("at")
    )
    rows = both.collect()
    assert all(isinstance(r["c_vec"], SparseVector) and list(r["c_vec"].toArray()) == r["dense"] for r in rows)
    assert {r["c"]: r["at"] for r in rows} == {"a": 2, "b": 0, "": 1, None: None, "new": None}
    # zeros are not stored
    assert sorted(len(r["c_vec"].indices) for r in rows) == [0, 0, 1, 1, 1, 1]


def test_one_label_no_label_and_no_rows(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    one = slots.add_slots(df, category_slots("c", ["a"]))
    assert [list(r["c_vec"].toArray()) for r in one.collect()] == [[1.0], [0.0]]
    assert slots.add_slots(df, category_slots("c", [])).columns == ["c"]
    none = slots.add_slots(df.limit(0), category_slots("c", ["a", "b"]))
    assert none.collect() == [] and slots.slot_labels(none, "c_vec") == ["a", "b"]
    assert [(r["slot"], r["label"]) for r in slots.slot_counts(one, ["c_vec"]).collect()] == [(0, "a")]


def test_labels_come_without_a_pass_over_the_rows(spark):
    # the index column's metadata holds the labels, so nothing is evaluated while the plan is built
    df = spark.range(10).select(F.raise_error(F.lit("read")).cast("string").alias("c"))
    out = slots.add_slots(df, category_slots("c", ["x", "y"]))
    assert slots.slot_labels(out, "c_vec") == ["x", "y"]
    with pytest.raises(Exception, match="read"):
        out.select("c_vec").collect()


def test_names_survive_checkpoint_and_fill(spark):
    df = spark.createDataFrame([("a", 1.0), ("b.c d", None)], "c string, n double")
    out = checkpoint(fill_sentinel(slots.add_slots(df, category_slots("c", ["b.c d", "a"]))))
    places = slots.input_slots(out, ["n", "c_vec"])
    assert [(s.name, s.column, s.index, s.label) for s in places] == [
        ("n", "n", None, None), ("c_vec_b.c d", "c_vec", 0, "b.c d"), ("c_vec_a", "c_vec", 1, "a"),
    ]
    # the names are those the assembler gives the model's vector
    attrs = model.assemble(out, ["n", "c_vec"]).schema[model.FEATURES].metadata["ml_attr"]["attrs"]
    assert [a["name"] for a in sorted((a for g in attrs.values() for a in g), key=lambda a: a["idx"])] == [s.name for s in places]


def test_other_vectors_and_arrays_are_no_slots(spark):
    df = model.assemble(spark.range(3).select(F.col("id").cast("double").alias("x")), ["x"]).withColumn("z", F.array("x"))
    assert slots.slot_labels(df, "z") is None and slots.slot_labels(df, "x") is None


@pytest.mark.parametrize("depth", [1, 4])
def test_tree_on_sparse_slots_equals_tree_on_dense_columns(spark, depth):
    labels = [str(i) for i in range(6)]
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    df = spark.range(0, 3000, 1, 4).select(
        "id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("string").alias("c"), (h % 90).cast("double").alias("n"), h.alias("h")
    )
    df = df.withColumn("y", ((F.col("c").isin("2", "5") & (F.col("n") > 30)) | (F.col("h") > 950)).cast("int")).drop("h")
    sparse = slots.add_slots(df, category_slots("c", labels))
    dense = df.select("*", *encode.onehot_columns("c", labels))
    params = Params(max_depth=depth, min_instances_per_node=20)
    names = [f"c_vec_{i}" for i in range(6)]
    places = slots.input_slots(sparse, ["n", "c_vec"])
    a = model.train(sparse, ["n", "c_vec"], ROLES, params)
    b = model.train(dense, ["n", *names], ROLES, params)
    got = [model.score(m, df).select("id", F.struct("prediction", model.PROB).alias("s")) for m, df in ((a, sparse), (b, dense))]
    assert got[0].join(got[1].withColumnRenamed("s", "t"), "id").where("s = t").count() == 3000
    assert a.stages[-1].numNodes == b.stages[-1].numNodes
    # importances by slot, folded on the source column
    ranking = model.feature_ranking(spark, a, places, {"c_vec": "c"}).collect()
    by_source = {s: sum(r["importance"] for r in ranking if r["source"] == s) for s in ("n", "c")}
    assert sum(by_source.values()) == pytest.approx(1.0) and by_source["c"] > 0
    # the tree as an expression reads the slots of the vectors
    nodes = model.tree_nodes(spark, a, places)
    assert nodes.where("slot IS NOT NULL AND column = 'c_vec'").count() > 0
    scored = model.score(a, sparse).withColumn("t", model.tree_column(sparse, nodes))
    assert scored.where(f"t.prediction <> prediction OR t.{model.PROB} <> {model.PROB}").count() == 0


def test_stored_band_has_no_dense_slot_columns(spark):
    prep = preprocess(tx_frame(spark, SF0001), FIXTURE_ROLES, Q.TREE_P)
    vectors = [f.name for f in prep.band.schema.fields if isinstance(f.dataType, VectorUDT)]
    assert set(vectors) == set(Q.VECTORS) and set(vectors) <= set(prep.inputs)
    assert not [f.name for f in prep.band.schema.fields if isinstance(f.dataType, T.NumericType) and f.name.rsplit("_", 1)[0] in vectors]
    assert len(prep.slots) == sum(len(slots.slot_labels(prep.band, c) or [c]) for c in prep.inputs)
    # a row marks one slot of every vector: all values of the population have one
    marked = prep.band.select(*[F.aggregate(vector_to_array(F.col(v)), F.lit(0.0), lambda x, y: x + y).alias(v) for v in vectors])
    assert marked.where(" OR ".join(f"{v} <> 1" for v in vectors)).count() == 0
    # the label of the marked slot is the row's value
    for c in ("card_profile_dep", "bill_count"):
        names = F.array(*[F.lit(x) for x in slots.slot_labels(prep.band, f"{c}_vec")])
        assert prep.band.where(F.get(names, slots.active_slot(f"{c}_vec")) != category_text(c)).count() == 0
