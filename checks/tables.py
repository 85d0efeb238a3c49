"""The given star schema presented as the raw tables the operators read.

Plain projections, written the same way in ``checks.oracles``.  Payments,
reviews, freight, persons and segments are stand-ins without business meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.numbers import MONEY

DELIVERED = "F"

# The columns of the given tables that the queries read.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table with its known columns; no job is run to infer them."""
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf}/{name}.parquet")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts with their person (three accounts each) and place."""
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.expr("c_custkey div 3").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("n_name").alias("customer_city"),
            F.col("r_name").alias("customer_state"),
        )
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.lit(None).cast("timestamp_ntz").alias("order_delivered_customer_date"),
    )


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("freight_value"),
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("product_category_name")
    )


def category_names(spark: SparkSession, sf: str) -> DataFrame:
    """One name per brand."""
    return (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("product_category_name"))
        .agg(F.min("p_name").alias("product_category_name_english"))
    )


def order_payments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_returnflag").alias("payment_type"),
        F.col("l_linenumber").alias("payment_installments"),
        F.col("l_extendedprice").cast(MONEY).alias("payment_value"),
    )


def order_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_linenumber") % 5 + 1).alias("review_score"),
    )


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered orders as an order fact keyed by account, valued at the order total."""
    return (
        table(spark, sf, "orders")
        .where(F.col("o_orderstatus") == DELIVERED)
        .select(
            F.col("o_custkey").alias("customer_unique_id"),
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.col("o_totalprice").cast(MONEY).alias("gross_order_value"),
            F.length("o_orderpriority").cast("long").alias("items_count"),
            F.substring("o_orderpriority", 1, 1).cast("long").alias("category_diversity"),
            F.lit(None).cast("decimal(5,2)").alias("avg_review_score"),
        )
    )


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Purchase events as an order fact with times inside the day."""
    return (
        table(spark, sf, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("customer_unique_id"),
            F.col("event_id").alias("order_id"),
            F.col("ts").alias("order_purchase_timestamp"),
            F.col("value").cast(MONEY).alias("gross_order_value"),
            F.lit(1).cast("long").alias("items_count"),
            F.lit(1).cast("long").alias("category_diversity"),
        )
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """The market segment as a person's segment, keyed by account."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_unique_id"),
        F.col("c_nationkey").alias("segment"),
        F.col("c_mktsegment").alias("segment_name"),
    )
