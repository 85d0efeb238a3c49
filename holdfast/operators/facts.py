"""Order-grain facts: delivered orders, customer identity, rollups and the order fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.dates import whole_days
from holdfast.functions.numbers import MONEY, SCORE, cents, from_cents, money_sum, whole_mean
from holdfast.operators.joins import skew_join
from holdfast.operators.ranking import mode_row

PERSON = "customer_unique_id"
WHEN = "order_purchase_timestamp"
LOCATION = ["customer_city", "customer_state", "customer_zip_code_prefix"]


def delivered_orders(orders: DataFrame, status: str = "delivered") -> DataFrame:
    """Orders that reached the customer and have a purchase time."""
    return orders.where((F.col("order_status") == status) & F.col(WHEN).isNotNull()).select(
        "order_id", "customer_id", "order_status", WHEN, "order_delivered_customer_date"
    )


def customer_identity_map(customers: DataFrame) -> DataFrame:
    """Distinct pairs of account and person."""
    return customers.select("customer_id", PERSON).distinct()


def primary_location(customers: DataFrame) -> DataFrame:
    """Most frequent location of each person; ties by city, state, then zip prefix."""
    return mode_row(customers, [PERSON], LOCATION)


def orders_of_people(delivered: DataFrame, identity: DataFrame) -> DataFrame:
    """Delivered orders with the person behind the account; a busy account is spread out."""
    return skew_join(delivered, identity, "customer_id", spread=["order_id"])


def customer_master(delivered: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per person with delivered orders: first and last order, count, tenure, location."""
    identity = customer_identity_map(customers).where(F.col(PERSON).isNotNull())
    people = (
        orders_of_people(delivered.select("order_id", "customer_id", WHEN), identity)
        .groupBy(PERSON)
        .agg(
            F.min(WHEN).alias("first_order_ts"),
            F.max(WHEN).alias("last_order_ts"),
            F.countDistinct("order_id").alias("total_delivered_orders"),
        )
        .withColumn("tenure_days", whole_days(F.col("last_order_ts"), F.col("first_order_ts")))
    )
    return people.join(primary_location(customers), PERSON).select(
        PERSON,
        *LOCATION,
        "first_order_ts",
        "last_order_ts",
        "total_delivered_orders",
        "tenure_days",
    )


def order_item_rollup(items: DataFrame) -> DataFrame:
    """Revenue, freight, item count and distinct products per order."""
    return items.groupBy("order_id").agg(
        money_sum(F.col("price"), MONEY).alias("items_revenue"),
        money_sum(F.col("freight_value"), MONEY).alias("freight_value"),
        F.count(F.lit(1)).alias("items_count"),
        F.countDistinct("product_id").alias("distinct_products"),
    )


def order_category_diversity(items: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct known categories per order, over the items that have a product row.

    Repeated (order, product) pairs and repeated product rows go before the join.
    """
    return (
        skew_join(
            items.select("order_id", "product_id").distinct(),
            products.select("product_id", "product_category_name").distinct(),
            "product_id",
            spread=["order_id"],
            counted_on=items,
        )
        .groupBy("order_id")
        .agg(F.countDistinct("product_category_name").alias("category_diversity"))
    )


def order_basket_rollup(items: DataFrame, products: DataFrame) -> DataFrame:
    """``order_item_rollup`` and ``order_category_diversity`` in one pass over the items.

    Items shrink to one row per (order, product) on the map side; that small
    table meets the product categories and is summed up per order.  A product
    listed under several categories repeats its pair, so the sums are taken on
    the row with its first category only.
    """
    pairs = items.groupBy("order_id", "product_id").agg(
        F.sum(cents(F.col("price"))).alias("_price"),
        F.sum(cents(F.col("freight_value"))).alias("_freight"),
        F.count(F.lit(1)).alias("_n"),
    )
    by_category = Window.partitionBy("product_id").orderBy("product_category_name")
    categories = (
        products.where(F.col("product_category_name").isNotNull())
        .select("product_id", "product_category_name")
        .distinct()
        .withColumn("_repeat", F.row_number().over(by_category) > 1)
    )
    named = skew_join(
        pairs, categories, "product_id", "left", spread=["order_id"], counted_on=items
    )
    once = ~F.coalesce(F.col("_repeat"), F.lit(False))
    return named.groupBy("order_id").agg(
        from_cents(F.sum(F.when(once, F.col("_price"))), MONEY).alias("items_revenue"),
        from_cents(F.sum(F.when(once, F.col("_freight"))), MONEY).alias("freight_value"),
        F.sum(F.when(once, F.col("_n"))).alias("items_count"),
        F.count(F.when(once, F.col("product_id"))).alias("distinct_products"),
        F.countDistinct("product_category_name").alias("category_diversity"),
    )


def order_payment_rollup(payments: DataFrame) -> DataFrame:
    """Paid value, distinct payment types and the longest instalment plan per order."""
    return payments.groupBy("order_id").agg(
        money_sum(F.col("payment_value"), MONEY).alias("payment_value"),
        F.countDistinct("payment_type").alias("payment_type_count"),
        F.max("payment_installments").alias("max_installments"),
    )


def order_review_rollup(reviews: DataFrame) -> DataFrame:
    """Mean review score per order, two places."""
    return reviews.groupBy("order_id").agg(
        whole_mean(F.col("review_score"), SCORE).alias("avg_review_score")
    )


def customer_orders(
    delivered: DataFrame,
    identity: DataFrame,
    items: DataFrame,
    products: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
) -> DataFrame:
    """The order fact: one row per delivered order and person.

    Every child table is rolled up to one row per order before it is joined, so
    nothing fans out and all joins share one partitioning by ``order_id``.  What
    an order lacks counts as zero; a missing review stays NULL.
    """
    orders = orders_of_people(
        delivered.select("order_id", "customer_id", WHEN, "order_delivered_customer_date"),
        identity,
    )
    joined = orders
    for rollup in (
        order_basket_rollup(items, products),
        order_payment_rollup(payments),
        order_review_rollup(reviews),
    ):
        joined = joined.join(rollup, "order_id", "left")

    def money(name: str):
        return F.coalesce(F.col(name), F.lit(0).cast(MONEY)).cast(MONEY)

    def number(name: str):
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    return joined.select(
        PERSON,
        "order_id",
        WHEN,
        "order_delivered_customer_date",
        money("items_revenue").alias("items_revenue"),
        money("freight_value").alias("freight_value"),
        (money("items_revenue") + money("freight_value")).cast(MONEY).alias("gross_order_value"),
        number("items_count"),
        number("distinct_products"),
        number("category_diversity"),
        money("payment_value").alias("payment_value"),
        number("payment_type_count"),
        number("max_installments"),
        "avg_review_score",
    )


def orders_enriched(customer_orders: DataFrame, segments: DataFrame) -> DataFrame:
    """The order fact with the person's segment, where there is one."""
    labelled = skew_join(
        customer_orders,
        segments.select(PERSON, "segment", "segment_name"),
        PERSON,
        "left",
        spread=["order_id"],
    )
    rest = [name for name in customer_orders.columns if name != PERSON]
    return labelled.select(PERSON, "segment", "segment_name", *rest)


def orders_calendar(enriched: DataFrame, dim_date: DataFrame, cohort: DataFrame) -> DataFrame:
    """Reporting fact: order value with fiscal year, calendar month and cohort month.

    The calendar has one row per day; Spark broadcasts it when its measured size allows.
    """
    days = dim_date.select(
        F.col("date").alias("_day"), F.col("fiscal_year_label").alias("fiscal_year"), "month"
    )
    first_months = cohort.select(PERSON, "cohort_month").distinct()
    return (
        skew_join(enriched, first_months, PERSON, "left", spread=["order_id"])
        .withColumn("_day", F.col(WHEN).cast("date"))
        .join(days, "_day", "left")
        .select(
            "order_id",
            PERSON,
            WHEN,
            F.col("gross_order_value").alias("order_value"),
            "fiscal_year",
            "month",
            "cohort_month",
        )
    )


def translate_category(products: DataFrame, lookup: DataFrame) -> DataFrame:
    """Products with the English category name; a name without an entry stays as it is.

    The lookup is read once per name.  Spark broadcasts it when its measured
    size is under the session's broadcast limit and shuffles it otherwise.
    """
    names = lookup.groupBy("product_category_name").agg(
        F.min("product_category_name_english").alias("_english")
    )
    return (
        skew_join(products, names, "product_category_name", "left", spread=["product_id"])
        .withColumn(
            "product_category_name_english",
            F.coalesce("_english", "product_category_name"),
        )
        .drop("_english")
        .select(*products.columns, "product_category_name_english")
    )
