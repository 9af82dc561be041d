"""Read the transaction table and publish rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Demo schema of the method: 15 typed, nullable columns; an optional
# issuer_bin_profile_issuing_cou column switches on cross-border measures.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("fraud_score", T.DoubleType(), True),
        T.StructField("is_fraud", T.IntegerType(), True),
        T.StructField("amount", T.DoubleType(), True),
        T.StructField("community_fraud_score_amount_d", T.DoubleType(), True),
        T.StructField("mch_id_trimmed", T.StringType(), True),
        T.StructField("issuer_member", T.StringType(), True),
        T.StructField("panalias_hab_cp_bill_count_45d", T.IntegerType(), True),
        T.StructField("panalias_hab_ipaddress_count_4", T.IntegerType(), True),
        T.StructField("ship_address_usage_ind", T.StringType(), True),
        T.StructField("isres_dpt_estimated_fact", T.IntegerType(), True),
        T.StructField("is_correct_bill_dept", T.BooleanType(), True),
        T.StructField("card_profile_dep", T.StringType(), True),
        T.StructField("merchant_country_code", T.StringType(), True),
        T.StructField("trans_status", T.StringType(), True),
        T.StructField("three_ds_mode", T.StringType(), True),
    ]
)


def read_transactions(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Scan a transaction table with an explicit schema (no inference pass).

    Column pruning and filter pushdown reach the Parquet scan because every
    later step is a lazy DataFrame transformation.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_rules(rules: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Publish a rules table; the caller chooses the sink."""
    rules.write.mode(mode).format(fmt).save(path)
