"""Versioned publishing of a rules table (S3).

A version is written whole into a folder of its own, read back and counted, and
only then named in the manifest: one row, written by one task and renamed into
the manifest table when its job commits.  Readers go through the manifest, so they
see the old or the new ruleset and never half of one; what an interrupted write
left behind is named nowhere, and the next publisher uses another folder.  Old
versions stay readable.  A table has one publisher at a time: two that pick the
same number are told apart when the second looks again, which raises.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, folder string, rows long, columns string"


def versions(spark: SparkSession, base: str) -> DataFrame:
    """``version, folder, rows, columns`` of every published version; empty if none."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(rules: DataFrame, base: str) -> int:
    """Write ``rules`` as the next version under ``base``; returns its number."""
    spark = rules.sparkSession
    version = (versions(spark, base).agg(F.max("version")).first()[0] or 0) + 1
    folder = f"rules/{version:08d}-{uuid4().hex}"
    rules.write.mode("errorifexists").parquet(f"{base}/{folder}")
    rows = spark.read.schema(rules.schema).parquet(f"{base}/{folder}").count()
    entry = spark.createDataFrame([(version, folder, rows, rules.schema.json())], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    if versions(spark, base).where(F.col("version") == version).count() != 1:
        raise RuntimeError(f"version {version} of {base} was published twice")
    return version


def read_published(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The rules of a version, by default the newest; ``LookupError`` if there is none."""
    named = versions(spark, base)
    if version is not None:
        named = named.where(F.col("version") == version)
    entry = named.orderBy(F.desc("version")).first()
    if entry is None:
        raise LookupError(f"nothing published under {base}" + (f" as version {version}" if version is not None else ""))
    columns = T.StructType.fromJson(json.loads(entry["columns"]))
    return spark.read.schema(columns).parquet(f"{base}/{entry['folder']}")
