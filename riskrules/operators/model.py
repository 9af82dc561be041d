"""Model steps on Spark ML.

The decision tree is MLlib's distributed learner; split statistics are
aggregated on the executors.  Model inputs are the numeric and boolean
feature columns (raw strings, ids and the label/amount are never inputs) and the
one-hot vectors of ``operators.slots``; importances are reported per slot of the
model's vector, by the names in its metadata, and summed per source column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..roles import Params, Roles, is_numeric
from .bands import BUCKET
from .slots import Slot, slot_labels, slot_value

FEATURES = "features"
LABEL = "__label"
#: Prefix of the number columns that stand for flags in the vector.
FLAG = "__flag_"
PROB = "fraud_probability"


def model_inputs(df: DataFrame, roles: Roles, params: Params, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric, boolean and one-hot vector columns that are not label, amount, ids or source categoricals."""
    skip = {roles.label, roles.amount, BUCKET, *roles.ids, *roles.categoricals, *exclude, *params.extra_excluded_features}
    return [
        f.name
        for f in df.schema.fields
        if f.name not in skip
        and not f.name.startswith("__")
        and (is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType) or slot_labels(df, f.name))
    ]


def _vector_stages(df: DataFrame, inputs: Sequence[str]) -> list[Transformer]:
    """Stages that make the ``features`` vector: NULL numbers become NaN
    (handleInvalid=keep); flags become 0 / 1 and NULL flags the -1 sentinel, since
    the assembler takes no NULL boolean."""
    flags = [c for c in inputs if isinstance(df.schema[c].dataType, T.BooleanType)]
    number = {c: f"{FLAG}{i}" for i, c in enumerate(flags)}
    assembler = VectorAssembler(inputCols=[number.get(c, c) for c in inputs], outputCol=FEATURES, handleInvalid="keep")
    if not flags:
        return [assembler]
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in flags}
    made = ", ".join(f"coalesce(cast({quoted[c]} AS double), -1D) AS {n}" for c, n in number.items())
    return [SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"), assembler]


def _without_flags(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(FLAG)])


def assemble(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """``features`` vector of the inputs; see ``_vector_stages`` for NULLs."""
    out = df
    for stage in _vector_stages(df, inputs):
        out = stage.transform(out)
    return _without_flags(out)


def train(band: DataFrame, inputs: Sequence[str], roles: Roles, params: Params) -> PipelineModel:
    """Gini tree on rows with a label (rows without one are only scored).

    The learner takes no NaN: fill NULL and NaN numbers first (``encode.fill_sentinel``)."""
    data = band.where(F.col(roles.label).isNotNull()).withColumn(LABEL, F.col(roles.label).cast("double"))
    tree = DecisionTreeClassifier(
        labelCol=LABEL,
        featuresCol=FEATURES,
        maxDepth=params.max_depth,
        minInstancesPerNode=params.min_instances_per_node,
        seed=params.seed,
    )
    return Pipeline(stages=[*_vector_stages(data, inputs), tree]).fit(data)


def _slots(inputs: Sequence[str | Slot]) -> list[Slot]:
    return [Slot(x, x) if isinstance(x, str) else x for x in inputs]


def feature_ranking(
    spark: SparkSession, model: PipelineModel, inputs: Sequence[str | Slot], source_of: Mapping[str, str]
) -> DataFrame:
    """``feature, source, importance, rank``: one row per slot of the model's vector.

    Built from the fitted model's importance vector: a table of model metadata,
    as small as the list of slots.  ``inputs`` names the slots in order
    (``slots.input_slots``; for scalar inputs their columns); a slot's source is
    that of its column.
    """
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(
        ((s.name, source_of.get(s.column, s.column), float(v)) for s, v in zip(_slots(inputs), imp, strict=True)),
        key=lambda r: (-r[2], r[0]),
    )
    data = [(n, s, v, i + 1) for i, (n, s, v) in enumerate(rows)]
    schema = "feature string, source string, importance double, rank int"
    return spark.createDataFrame(data, schema)


def tree_nodes(spark: SparkSession, model: PipelineModel, inputs: Sequence[str | Slot]) -> DataFrame:
    """The fitted tree as a table, one row per node (at most 2^(depth+1) - 1).

    ``node_id`` numbers nodes as a heap (root 1, children 2i and 2i + 1);
    internal nodes carry the split (feature, the column and, for a one-hot vector, the
    slot it reads; go left when ``value <= threshold``, or for a one-hot slot when the
    value is one of ``left_values``), every node its prediction, its share of the label 1,
    its impurity and the training rows that reached it.  Model metadata walked on the driver
    through Spark ML's public node API; no data is read.
    """
    slots = _slots(inputs)
    rows = []
    stack = [(model.stages[-1]._java_obj.rootNode(), 1, 0)]
    while stack:
        node, nid, depth = stack.pop()
        count = int(node.impurityStats().count())
        by_label = [float(v) for v in node.impurityStats().stats()]
        share = by_label[1] / sum(by_label) if len(by_label) > 1 and sum(by_label) else 0.0
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            ordered = split.getClass().getSimpleName() == "ContinuousSplit"
            threshold = float(split.threshold()) if ordered else None
            left = None if ordered else sorted(float(v) for v in split.leftCategories())
            at = slots[split.featureIndex()]
            rows.append((nid, depth, False, at.name, at.column, at.index, threshold, left,
                         float(node.prediction()), share, float(node.impurity()), float(node.gain()), count))
            stack.append((node.leftChild(), 2 * nid, depth + 1))
            stack.append((node.rightChild(), 2 * nid + 1, depth + 1))
        else:
            rows.append((nid, depth, True, None, None, None, None, None, float(node.prediction()), share, float(node.impurity()), None, count))
    schema = (
        "node_id long, depth int, is_leaf boolean, feature string, column string, slot int, threshold double, left_values array<double>, "
        "prediction double, share double, impurity double, gain double, rows long"
    )
    return spark.createDataFrame(sorted(rows), schema)


def score(model: PipelineModel, band: DataFrame) -> DataFrame:
    """Adds ``prediction``, ``probability`` and ``fraud_probability`` = P(class 1)."""
    out = _without_flags(model.transform(band))
    return out.withColumn(PROB, vector_to_array(F.col("probability"))[1]).drop(FEATURES, "rawPrediction")


def tree_column(df: DataFrame, nodes: DataFrame) -> Column:
    """The tree as one expression on the columns of ``df``: a struct of ``leaf_id``,
    ``prediction`` and ``fraud_probability``.

    ``nodes`` is a table as ``tree_nodes`` gives it (bounded by the depth; read on the
    driver).  Values go the way Spark ML sends them: NULL and NaN numbers fail every
    ``<=`` and go right, a NULL flag counts as -1.  A node with a ``slot`` reads that slot
    of the vector in ``column``; without these two fields, ``feature`` is the column.  No feature vector and no model object is
    needed, so the rows of a stream or of another application can be scored.
    """
    node = {r["node_id"]: r.asDict() for r in nodes.collect()}

    def value(n: dict) -> Column:
        name = n.get("column") or n["feature"]
        if n.get("slot") is not None:
            return slot_value(name, n["slot"])
        quoted = F.col("`" + name.replace("`", "``") + "`")
        number = quoted.cast("double")
        return F.coalesce(number, F.lit(-1.0)) if isinstance(df.schema[name].dataType, T.BooleanType) else number

    def below(nid: int) -> Column:
        n = node[nid]
        if n["is_leaf"]:
            return F.struct(
                F.lit(nid).cast("long").alias("leaf_id"),
                F.lit(n["prediction"]).alias("prediction"),
                F.lit(n["share"]).alias(PROB),
            )
        if n["threshold"] is not None:
            left = value(n) <= F.lit(n["threshold"])
        elif n.get("left_values") is not None:
            left = value(n).isin(n["left_values"])
        else:
            raise ValueError(f"node {nid} splits {n['feature']} by categories; a threshold or left_values is needed")
        return F.when(left, below(2 * nid)).otherwise(below(2 * nid + 1))

    return below(1)


def score_by_tree(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """``df`` with ``leaf_id``, ``prediction`` and ``fraud_probability`` by ``tree_column``."""
    by = "__tree"
    parts = [F.col(f"{by}.{c}").alias(c) for c in ("leaf_id", "prediction", PROB)]
    return df.withColumn(by, tree_column(df, nodes)).select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], *parts)


def confident(params: Params) -> Column:
    """Rows the tree flags with high confidence."""
    return (F.col("prediction") == F.lit(1.0)) & (F.col(PROB) >= F.lit(float(params.confidence)))
