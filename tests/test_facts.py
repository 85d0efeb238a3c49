from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from holdfast.operators import calendar, cohorts, facts
from tests.helpers import as_dict, order_fact, when

ORDERS = "order_id string, customer_id string, order_status string, t string"


def raw_orders(spark, rows):
    return spark.createDataFrame(rows, ORDERS).select(
        "order_id",
        "customer_id",
        "order_status",
        F.col("t").cast("timestamp_ntz").alias("order_purchase_timestamp"),
        F.lit(None).cast("timestamp_ntz").alias("order_delivered_customer_date"),
    )


CUSTOMERS = (
    "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
    "customer_city string, customer_state string"
)


@pytest.fixture(scope="module")
def shop(spark):
    orders = raw_orders(
        spark,
        [
            ("o1", "c1", "delivered", "2018-01-01 10:00:00"),
            ("o2", "c2", "delivered", "2018-01-03 09:00:00"),
            ("o3", "c3", "delivered", "2018-02-01 00:00:00"),
            ("o4", "c1", "shipped", "2018-02-02 00:00:00"),
            ("o5", "c1", "delivered", None),
            ("o6", "c9", "delivered", "2018-02-02 00:00:00"),
        ],
    )
    customers = spark.createDataFrame(
        [
            ("c1", "p1", 10, "rio", "RJ"),
            ("c2", "p1", 20, "santos", "SP"),
            ("c2", "p1", 20, "santos", "SP"),
            ("c3", "p2", 30, None, "SP"),
            ("c4", "p3", 40, "rio", "RJ"),
            ("c5", None, 50, "rio", "RJ"),
        ],
        CUSTOMERS,
    )
    items = spark.createDataFrame(
        [
            ("o1", "x", "10.10", "1.00"),
            ("o1", "x", "10.10", "1.00"),
            ("o1", "y", "5.05", "0.50"),
            ("o1", None, "1.00", "0.25"),
            ("o1", "ghost", "2.00", "0.25"),
            ("o2", "z", "7.00", "0.00"),
        ],
        "order_id string, product_id string, price string, freight_value string",
    )
    products = spark.createDataFrame(
        [("x", "toys"), ("x", "games"), ("x", "toys"), ("y", "toys"), ("z", None)],
        "product_id string, product_category_name string",
    )
    payments = spark.createDataFrame(
        [("o1", "card", 3, "20.00"), ("o1", "card", 1, "9.75"), ("o1", "voucher", None, "0.25")],
        "order_id string, payment_type string, payment_installments int, payment_value string",
    )
    reviews = spark.createDataFrame(
        [("o1", 4), ("o1", 5), ("o1", 5), ("o2", None)], "order_id string, review_score int"
    )
    return {
        "orders": orders,
        "customers": customers,
        "items": items,
        "products": products,
        "payments": payments,
        "reviews": reviews,
    }


def test_delivered_orders_need_status_and_time(shop):
    kept = facts.delivered_orders(shop["orders"])
    assert sorted(r["order_id"] for r in kept.collect()) == ["o1", "o2", "o3", "o6"]
    assert facts.delivered_orders(shop["orders"], "shipped").count() == 1


def test_customer_master(shop):
    master = facts.customer_master(facts.delivered_orders(shop["orders"]), shop["customers"])
    got = as_dict(
        master, "customer_unique_id", "customer_city", "total_delivered_orders", "tenure_days"
    )
    assert got == {"p1": ("santos", 2, 1), "p2": (None, 1, 0)}
    first = as_dict(master, "customer_unique_id", "first_order_ts", "last_order_ts")
    assert first["p1"] == (when("2018-01-01 10:00:00"), when("2018-01-03 09:00:00"))


def test_item_rollup_and_category_diversity(shop):
    rolled = facts.order_item_rollup(shop["items"])
    assert as_dict(
        rolled, "order_id", "items_revenue", "freight_value", "items_count", "distinct_products"
    ) == {
        "o1": (D("28.25"), D("3.00"), 5, 3),
        "o2": (D("7.00"), D("0.00"), 1, 1),
    }
    diversity = facts.order_category_diversity(shop["items"], shop["products"])
    assert as_dict(diversity, "order_id", "category_diversity") == {"o1": 2, "o2": 0}


def test_basket_rollup_is_both_rollups_at_once(shop):
    got = facts.order_basket_rollup(shop["items"], shop["products"])
    assert as_dict(
        got,
        "order_id",
        "items_revenue",
        "freight_value",
        "items_count",
        "distinct_products",
        "category_diversity",
    ) == {
        "o1": (D("28.25"), D("3.00"), 5, 3, 2),
        "o2": (D("7.00"), D("0.00"), 1, 1, 0),
    }


def test_payment_and_review_rollups(shop):
    assert as_dict(
        facts.order_payment_rollup(shop["payments"]),
        "order_id",
        "payment_value",
        "payment_type_count",
        "max_installments",
    ) == {"o1": (D("30.00"), 2, 3)}
    assert as_dict(facts.order_review_rollup(shop["reviews"]), "order_id", "avg_review_score") == {
        "o1": D("4.67"),
        "o2": None,
    }


def test_order_fact_fills_what_is_missing(shop):
    fact = facts.customer_orders(
        facts.delivered_orders(shop["orders"]),
        facts.customer_identity_map(shop["customers"]),
        shop["items"],
        shop["products"],
        shop["payments"],
        shop["reviews"],
    )
    assert len(fact.columns) == 14
    got = as_dict(
        fact,
        "order_id",
        "customer_unique_id",
        "gross_order_value",
        "items_count",
        "category_diversity",
        "payment_value",
        "max_installments",
        "avg_review_score",
    )
    assert got == {
        "o1": ("p1", D("31.25"), 5, 2, D("30.00"), 3, D("4.67")),
        "o2": ("p1", D("7.00"), 1, 0, D("0.00"), 0, None),
        "o3": ("p2", D("0.00"), 0, 0, D("0.00"), 0, None),
    }
    assert dict(fact.dtypes)["gross_order_value"] == "decimal(12,2)"


def test_person_with_a_third_of_all_orders(spark):
    many = 600
    orders = [(f"h{i}", "hot", "delivered", f"2018-01-{i % 28 + 1:02d} 00:00:00") for i in range(many)]
    orders += [(f"o{i}", f"c{i}", "delivered", "2018-02-01 00:00:00") for i in range(2 * many)]
    customers = [("hot", "HOT", 1, "rio", "RJ")]
    customers += [(f"c{i}", f"p{i // 2}", 1, "rio", "RJ") for i in range(2 * many)]
    master = facts.customer_master(
        facts.delivered_orders(raw_orders(spark, orders)), spark.createDataFrame(customers, CUSTOMERS)
    )
    got = as_dict(master, "customer_unique_id", "total_delivered_orders", "tenure_days")
    assert got.pop("HOT") == (many, 27)
    assert got == {f"p{i}": (2, 0) for i in range(many)}


def test_product_in_a_third_of_all_items(spark):
    rows = [(f"o{i % 500}", "hot" if i % 3 == 0 else f"x{i % 40}", "1.50", "0.10") for i in range(3000)]
    items = spark.createDataFrame(
        rows, "order_id string, product_id string, price string, freight_value string"
    )
    products = spark.createDataFrame(
        [("hot", "best")] + [(f"x{i}", f"cat{i % 5}") for i in range(40)],
        "product_id string, product_category_name string",
    )
    both = facts.order_item_rollup(items).join(
        facts.order_category_diversity(items, products), "order_id"
    )
    cols = ["order_id", "items_revenue", "freight_value", "items_count", "distinct_products", "category_diversity"]
    basket = facts.order_basket_rollup(items, products)
    assert sorted(basket.select(cols).collect()) == sorted(both.select(cols).collect())


def test_enriched_keeps_people_without_a_segment(spark):
    orders = order_fact(spark, [("a", "1", "2018-01-01", 5), ("b", "2", "2018-01-01", 5), (None, "3", "2018-01-01", 1)])
    segments = spark.createDataFrame(
        [("a", 2, "Champions")], "customer_unique_id string, segment int, segment_name string"
    )
    got = as_dict(facts.orders_enriched(orders, segments), "order_id", "segment", "segment_name")
    assert got == {"1": (2, "Champions"), "2": (None, None), "3": (None, None)}


def test_orders_calendar(spark):
    orders = order_fact(
        spark,
        [("a", "1", "2018-03-31 23:59:59", 5), ("a", "2", "2018-04-01", 6), ("b", "3", "2018-12-31", 7)],
    )
    got = as_dict(
        facts.orders_calendar(orders, calendar.dim_date(orders), cohorts.customer_cohort(orders)),
        "order_id",
        "order_value",
        "fiscal_year",
        "month",
        "cohort_month",
    )
    march, december = when("2018-03-01").date(), when("2018-12-01").date()
    assert got == {
        "1": (D("5.00"), "FY2017/18", 3, march),
        "2": (D("6.00"), "FY2018/19", 4, march),
        "3": (D("7.00"), "FY2018/19", 12, december),
    }


def test_translate_category_keeps_unknown_names(spark):
    products = spark.createDataFrame(
        [("1", "bebes"), ("2", "novo"), ("3", None)], "product_id string, product_category_name string"
    )
    lookup = spark.createDataFrame(
        [("bebes", "baby")], "product_category_name string, product_category_name_english string"
    )
    got = as_dict(
        facts.translate_category(products, lookup), "product_id", "product_category_name_english"
    )
    assert got == {"1": "baby", "2": "novo", "3": None}
