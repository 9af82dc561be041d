"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark, pieces.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps, with the columns of ``documents``.  The last one
returns the encoded documents.  ``run`` writes each stage's result as Parquet in
the shared checkpoint folder and gives the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskrules.llm import neardup, pieces, quality, substrings, tiling
from riskrules.llm.queries import tokenizer_file
from riskrules.llm.shared import read, shared_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group at 0.8 on five-word shingles."""
    out = neardup.groups(docs, k=5, num=80, den=100).where("NOT kept").select(F.col("doc_id").alias("__id"))
    return docs.join(out, docs["doc_id"].cast("long") == out["__id"], "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages of documents with smaller ids."""
    kept = substrings.remove_repeats(docs, 50)
    shorter = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", shorter.cast("long")).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text, and the text read back from them."""
    model = tokenizer_file("piece_bpe_32k.model")
    return pieces.round_trip(docs, model, n_best=3)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("benchmark", benchmark_stage),
    ("pieces", pieces_stage),
]

#: Importance resampling, tiling and segmentation have no SQL form; see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
