"""Transaction roles mapped on to the TPC-H-like test tables.

One row per ``lineitem`` row.  The label carries a planted signal: fraud
when the community score ``cs`` (= 10 * tax) is high, and by return flag in
the middle band.  ``(l_orderkey, l_linenumber)`` is not unique, so there is
no row key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import Params, Roles

#: Orders up to which Spark plans the joins by itself, one after the other.
FEW_ORDERS = 200_000
TX_TABLES = ("lineitem", "orders", "customer", "supplier", "nation")

FIXTURE_ROLES = Roles(
    interval_score="cs",
    categoricals=("ship_address_usage_ind", "card_profile_dep", "bill_count", "part_id"),
    ids=("mch_id_trimmed", "issuer_member", "part_id"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``tx`` view: lineitem + orders + customer + supplier + two nations.

    The line items are the many rows, so above FEW_ORDERS they are shuffled once, by order:
    customers are joined to the orders first, suppliers are broadcast when their measured
    number allows it, and what is derived from one table is derived before the join.
    """
    fraud = ((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.035)) | (F.col("l_tax") >= 0.065)
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(fraud, 1).otherwise(0).cast("int").alias("is_fraud"),
        F.round(F.col("l_discount") * 1000, 0).alias("fraud_score"),
        F.round(F.col("l_tax") * 10, 1).alias("cs"),
        F.col("l_linenumber").cast("string").alias("ship_address_usage_ind"),
        F.col("l_quantity").cast("int").alias("bill_count"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("trans_status"),
    )
    od = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", "N").when(F.col("o_orderstatus") == "O", "C").otherwise("F").alias("three_ds_mode"),
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # dimensions enriched first (nation is tiny: 25 rows by definition of the schema)
    cust = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("n_name").alias("issuer_bin_profile_issuing_cou"))
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    supp = suppliers.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("merchant_country_code")
    )
    on_order, on_customer, on_supplier = (
        F.col(a) == F.col(b) for a, b in (("l_orderkey", "o_orderkey"), ("o_custkey", "c_custkey"), ("l_suppkey", "s_suppkey"))
    )
    if od.count() <= FEW_ORDERS:
        j = li.join(od, on_order).join(cust, on_customer).join(supp, on_supplier)
    else:
        if suppliers.count() <= Params().max_broadcast_rows:
            supp = F.broadcast(supp)
        # merged whatever Spark estimates: else the plan, and with it the order of rows (the last
        # bits of deviations), depends on which side is ready first
        j = li.join(od.join(cust, on_customer).hint("merge"), on_order).join(supp, on_supplier)
    return j.select(
        F.col("l_suppkey").alias("mch_id_trimmed"),
        F.col("o_custkey").alias("issuer_member"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_extendedprice").alias("amount"),
        "is_fraud",
        "fraud_score",
        "cs",
        "ship_address_usage_ind",
        F.col("o_orderpriority").alias("card_profile_dep"),
        "bill_count",
        "merchant_country_code",
        "issuer_bin_profile_issuing_cou",
        "trans_status",
        "three_ds_mode",
    )


# The same view as DuckDB SQL (the oracle's CTE).
TX_SQL = """
SELECT l_suppkey AS mch_id_trimmed,
       o_custkey AS issuer_member,
       l_partkey AS part_id,
       l_extendedprice AS amount,
       CAST(CASE WHEN (l_returnflag = 'R' AND l_tax >= 0.035) OR l_tax >= 0.065 THEN 1 ELSE 0 END AS INT) AS is_fraud,
       ROUND(l_discount * 1000, 0) AS fraud_score,
       ROUND(l_tax * 10, 1) AS cs,
       CAST(l_linenumber AS VARCHAR) AS ship_address_usage_ind,
       o_orderpriority AS card_profile_dep,
       CAST(l_quantity AS INT) AS bill_count,
       sn.n_name AS merchant_country_code,
       cn.n_name AS issuer_bin_profile_issuing_cou,
       CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS trans_status,
       CASE WHEN o_orderstatus = 'P' THEN 'N' WHEN o_orderstatus = 'O' THEN 'C' ELSE 'F' END AS three_ds_mode
FROM lineitem
JOIN orders   ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
JOIN nation cn ON c_nationkey = cn.n_nationkey
"""
