"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html, langid, neardup, periods, pieces, quality, substrings, tiling, tokens, topk, whiten, winnow
from ..functions.joins import checkpoint_dir
from .shared import read


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


def tokenizer_file(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to rANS blocks and read back."""
    path = f"{checkpoint_dir(spark)}/llm-tokens-{uuid.uuid4().hex}"
    tokenizer = tokenizer_file("byte_bpe_50k.json")
    tokens.write_tokens(read(spark, sf_dir, "documents"), path, tokenizer, end_id=0)
    return tokens.read_tokens(spark, path, tokenizer, end_id=0)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    text = html.extract(read(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best segmentations of every document, and its text read back."""
    model = tokenizer_file("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.decode(pieces.encode(docs, model, n_best=3), model)
    return out.select("doc_id", "n_pieces", "score", "ids", "alternatives", "decoded", F.equal_null(F.coalesce("text", F.lit("")), "decoded").alias("exact"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the benchmark items it holds."""
    return tiling.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each whose id is divisible by 50."""
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; the text model is counted over all documents."""
    return langid.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word passages of earlier documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substrings.remove_repeats(docs, 50, join_all=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on 2-word shingles at 0.8."""
    return neardup.groups(read(spark, sf_dir, "documents"), k=2, num=80, den=100)


def op10_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its importance and whether the sample keeps it."""
    return quality.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 16 greatest components of the distinct ones, whitened."""
    return whiten.whitened(read(spark, sf_dir, "embeddings"), scale=64, most=16)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document, of its edited text and the next one's likeness."""
    return winnow.against_next(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, every tenth with a repeated tail."""
    return periods.digests(periods.find_runs(periods.with_repeated_tails(read(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_token_files, op3_html_extract, op4_sentencepiece, op5_decontaminate, op6_topk_search,
        op7_language_id, op8_substring_dedup, op9_minhash_neardup, op10_quality_resample,
        op11_whitening, op12_fingerprints, op13_periodic_runs,
    )
}
