"""Schema-checked read (S1, S2): rows that keep a schema, and the others with reasons.

A column whose type differs from the schema's is cast value by value.  A row is
rejected for

* ``null``: NULL (or a column the table lacks is an error, see below) in a field
  that is not nullable,
* ``type``: a value that is no value of the field's type (``"n/a"`` as a number,
  an integer out of range),
* ``lossy``: a number or time that the field's type cannot hold unchanged (1.5 as
  an integer).  A double read as a float keeps its nearest value.

What concerns the whole table raises ``ValueError``, all faults named at once: a
required column that is missing, a type pair without a conversion.  A nullable
column that is missing is NULL; columns outside the schema are left out.  Both
results are lazy projections of the same scan with no shuffle; the texts of
rejected rows are built for those rows only.  An empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..roles import is_numeric

ERRORS = "__errors"
ERROR_TYPE = "array<struct<column: string, reason: string>>"
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Conformed:
    """``rows``: the schema's columns; ``rejected``: ``row`` (JSON of the row as it
    was read) and ``errors``; ``report``: ``column, reason, n``."""

    rows: DataFrame
    rejected: DataFrame
    report: DataFrame


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _convertible(source: T.DataType, target: T.DataType) -> bool:
    if source == target or isinstance(source, T.NullType):
        return True
    atoms = (T.StringType, T.BooleanType, *TIMES)
    if not all(is_numeric(t) or isinstance(t, atoms) for t in (source, target)):
        return False
    if isinstance(source, T.StringType) or isinstance(target, T.StringType):
        return True
    if is_numeric(target):
        return is_numeric(source) or isinstance(source, T.BooleanType)
    return isinstance(source, TIMES) and isinstance(target, TIMES)


def _field(source: T.DataType | None, field: T.StructField) -> tuple[Column, Column]:
    """The typed value of a field, and its error or NULL."""
    if source is None:
        return F.lit(None).cast(field.dataType), F.lit(None).cast("string")
    raw, target = _quoted(field.name), field.dataType
    value = raw if source == target else raw.try_cast(target)
    error = F.when(raw.isNotNull() & value.isNull(), F.lit("type"))
    texts = isinstance(source, T.StringType) or isinstance(target, T.StringType)
    rounded = isinstance(target, T.FloatType) and isinstance(source, (T.DoubleType, T.DecimalType))
    if source != target and not texts and not rounded and not isinstance(source, (T.BooleanType, T.NullType)):
        error = error.when(~value.try_cast(source).eqNullSafe(raw), F.lit("lossy"))
    if not field.nullable:
        error = error.when(raw.isNull(), F.lit("null"))
    return value, error


def check_table(df: DataFrame, schema: T.StructType) -> None:
    """Raise ``ValueError`` with every fault that concerns the whole table."""
    have = {f.name: f.dataType for f in df.schema.fields}
    faults = [f"{f.name}: missing" for f in schema.fields if f.name not in have and not f.nullable]
    faults += [
        f"{f.name}: no conversion from {have[f.name].simpleString()} to {f.dataType.simpleString()}"
        for f in schema.fields
        if f.name in have and not _convertible(have[f.name], f.dataType)
    ]
    if faults:
        raise ValueError("the table does not fit the schema: " + "; ".join(faults))


def conform(df: DataFrame, schema: T.StructType) -> Conformed:
    """Rows of ``df`` that fit ``schema``, the rejected ones, and counts by reason."""
    check_table(df, schema)
    have = {f.name: f.dataType for f in df.schema.fields}
    made = {f.name: _field(have.get(f.name), f) for f in schema.fields}
    errors = F.array(*[F.struct(F.lit(n).alias("column"), e.alias("reason")) for n, (_, e) in made.items()])
    errors = F.filter(errors, lambda e: e["reason"].isNotNull()).cast(ERROR_TYPE)
    names = [f.name for f in schema.fields]
    good = df.where(F.size(errors) == 0).select(*[made[n][0].alias(n) for n in names])
    as_read = F.to_json(F.struct(*[_quoted(c) for c in df.columns]), {"ignoreNullFields": "false"})
    bad = df.where(F.size(errors) > 0).select(as_read.alias("row"), errors.alias("errors"))
    report = bad.select(F.inline("errors")).groupBy("column", "reason").agg(F.count(F.lit(1)).alias("n"))
    return Conformed(good, bad, report)
