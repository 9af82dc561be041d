"""One-hot slots kept sparse (E1, E2, M1, M3): one vector column per source.

A stored row holds the place of its value, not a 0/1 column per value.  Spark ML's
encoder makes the vectors; the labels come from counts that are known already, so
they are given as the index column's metadata and no pass over the rows is needed.
The vector column names its slots in its ``ml_attr`` metadata, which the assembler
hands on to the model's vector, so splits and importances are named by it.

NULL and values without a slot give a vector of zeros.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ML_ATTR = "ml_attr"
INDEX = "__slot_"


@dataclass(frozen=True)
class Slot:
    """One place of the model's vector: a scalar column, or a slot of a vector column."""

    name: str
    column: str
    index: int | None = None
    label: str | None = None


def slot_index(value: Column, labels: Sequence[str]) -> Column:
    """Place of a value among the labels; their number for NULL and for other values."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), value)
    return F.when(at > 0, at - 1).otherwise(len(labels)).cast("double")


def add_slot_places(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """``df`` with the place of each row's value, one number column per entry with labels:
    what a stored row holds; ``slots_of_places`` makes the vectors."""
    places = [slot_index(value, labels).alias(f"{INDEX}{i}") for i, (value, labels) in enumerate(_labelled(wanted).values())]
    return df.select("*", *places)


def slots_of_places(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """``df`` with the vector columns in place of the places that ``add_slot_places`` gave it."""
    wanted = _labelled(wanted)
    if not wanted:
        return df
    index = {name: f"{INDEX}{i}" for i, name in enumerate(wanted)}
    coded = df.withColumns(
        {
            index[name]: F.col(index[name]).alias(index[name], metadata={ML_ATTR: {"type": "nominal", "name": index[name], "vals": list(labels)}})
            for name, (_, labels) in wanted.items()
        }
    )
    # the place after the last label is the invalid one, which dropLast leaves as zeros
    encoder = OneHotEncoder(inputCols=list(index.values()), outputCols=list(index), handleInvalid="keep", dropLast=True)
    return encoder.fit(coded).transform(coded).drop(*index.values())


def _labelled(wanted: Mapping[str, tuple[Column, Sequence[str]]]) -> dict[str, tuple[Column, Sequence[str]]]:
    return {name: entry for name, entry in wanted.items() if entry[1]}


def add_slots(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """``df`` with a sparse vector column per entry ``{name: (value, labels in slot
    order)}``; an entry without labels adds no column.  One projection for all."""
    return slots_of_places(add_slot_places(df, wanted), wanted)


def slot_labels(df: DataFrame, column: str) -> list[str] | None:
    """Slot names of a vector column in order, from its metadata; None for other columns."""
    field = df.schema[column]
    if not isinstance(field.dataType, VectorUDT):
        return None
    kinds = field.metadata.get(ML_ATTR, {}).get("attrs", {})
    named = {a["idx"]: a["name"] for attrs in kinds.values() for a in attrs if "name" in a}
    return [named[i] for i in sorted(named)] if named else None


def input_slots(df: DataFrame, inputs: Sequence[str]) -> list[Slot]:
    """The places of the assembled vector of ``inputs``, in order, named as in its metadata."""
    out: list[Slot] = []
    for c in inputs:
        labels = slot_labels(df, c)
        if labels is None:
            out.append(Slot(c, c))
        else:
            out += [Slot(f"{c}_{x}", c, i, x) for i, x in enumerate(labels)]
    return out


def slot_value(column: str, index: int) -> Column:
    """0 or 1: what a vector column holds in a slot."""
    return F.get(vector_to_array(F.col("`" + column.replace("`", "``") + "`")), F.lit(index))


def active_slot(column: str) -> Column:
    """The slot a one-hot vector marks; NULL for a vector of zeros."""
    at = F.array_position(vector_to_array(F.col(column)), F.lit(1.0))
    return F.when(at > 0, at - 1)


def slot_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``source, slot, label, n``: rows that mark each slot.  One aggregate of sparse
    sums; its row per partition is as long as the slots are many."""
    sums = df.agg(*[Summarizer.sum(F.col(c)).alias(c) for c in columns])

    def counted(c: str) -> Column:
        labels = F.array(*[F.lit(x) for x in slot_labels(df, c)])
        return F.transform(
            vector_to_array(F.col(c)),
            lambda n, i: F.struct(F.lit(c).alias("source"), i.alias("slot"), F.get(labels, i).alias("label"), n.cast("long").alias("n")),
        )

    return sums.select(F.inline(F.flatten(F.array(*[counted(c) for c in columns]))))
