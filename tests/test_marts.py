from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from holdfast.functions.numbers import amount_mean
from holdfast.operators import marts, quality
from tests.helpers import as_dict


@pytest.fixture(scope="module")
def scores(spark):
    rows = [
        ("a", "S", 1, 0.9, 90.0, 9, "HIGH", 100.0),
        ("b", "S", 1, 0.9, 45.5, 8, "HIGH", 50.0),
        ("c", "T", 0, 0.5, 10.25, 4, "MEDIUM", 20.5),
        ("d", "T", 0, 0.1, 1.0, 0, "LOW", 10.0),
        ("e", None, 0, None, None, None, None, 7.0),
    ]
    return spark.createDataFrame(
        rows,
        "customer_unique_id string, segment_name string, churned int, churn_risk double, "
        "value_at_risk double, risk_decile int, priority_band string, monetary double",
    )


def test_target_list(spark):
    scores = spark.createDataFrame(
        [(f"p{i}", "S", r) for i, r in enumerate([0.9, 0.9, 0.9, 0.5, 0.5, 0.1, 0.1])],
        "customer_unique_id string, segment_name string, churn_risk double",
    )
    rfm = spark.createDataFrame(
        [(f"p{i}", m, 1, m, 0) for i, m in enumerate([5.0, 90.0, 50.0, 80.0, 1.0, 70.0, 2.0])] + [("x", 1.0, 1, 1.0, 0)],
        "customer_unique_id string, monetary double, frequency long, avg_order_value double, tenure_days int",
    )
    got = as_dict(
        marts.marketing_target_list(scores, rfm), "customer_unique_id", "priority_band", "recommended_action"
    )
    assert {k: v[0] for k, v in got.items()} == {
        "p0": "MEDIUM PRIORITY",
        "p1": "HIGH PRIORITY",
        "p2": "MEDIUM PRIORITY",
        "p3": "MEDIUM PRIORITY",
        "p4": "LOW PRIORITY",
        "p5": "LOW PRIORITY",
        "p6": "LOW PRIORITY",
    }
    assert got["p1"][1].startswith("Immediate retention offer")
    assert got["p3"][1].startswith("Soft engagement")
    assert got["p2"][1].startswith("Triggered email")
    assert got["p6"][1] == "Low-cost, broad campaigns only."
    top = marts.top_priority_targets(marts.marketing_target_list(scores, rfm))
    assert [r["customer_unique_id"] for r in top.collect()] == ["p1"]


def test_value_at_risk_groups(scores):
    by = as_dict(
        marts.value_at_risk_by(scores), "priority_band", "customers", "total_value_at_risk", "avg_value_at_risk"
    )
    assert by["HIGH"] == (2, D("135.50"), D("67.75"))
    assert by[None] == (1, None, None)
    matrix = as_dict(
        marts.value_at_risk_matrix(scores), "segment_name", "high_value_at_risk", "low_value_at_risk"
    )
    assert matrix == {"S": (D("135.50"), None), "T": (None, D("1.00")), None: (None, None)}
    assert [r["customer_unique_id"] for r in marts.top_value_at_risk(scores, 1).collect()] == ["a"]
    assert as_dict(marts.count_by(scores, "priority_band"), "priority_band", "customers")["LOW"] == 1


def test_dashboard(scores):
    overview = marts.executive_overview(scores).first()
    assert tuple(overview) == (5, D("187.50"), 0.4, D("146.75"))
    shares = as_dict(marts.risk_distribution(scores), "priority_band", "customer_share", "value_share")
    assert shares["HIGH"] == pytest.approx((0.4, 135.5 / 146.75))
    rates = as_dict(marts.churn_by_segment(scores), "segment_name", "churn_rate", "avg_churn_risk")
    assert rates["S"] == pytest.approx((1.0, 0.9))
    spread = as_dict(
        marts.risk_concentration(scores.where("risk_decile IS NOT NULL")), "risk_decile", "cumulative_share"
    )
    assert spread[9] == pytest.approx(90 / 146.75)
    assert spread[0] == pytest.approx(1.0)


def test_dim_customer_keeps_everyone(spark, scores):
    master = spark.createDataFrame(
        [("a", "rio", "RJ", 1, 1, 0), ("z", "rio", "RJ", 1, 2, 0)],
        "customer_unique_id string, customer_city string, customer_state string, "
        "customer_zip_code_prefix int, total_delivered_orders int, tenure_days int",
    ).withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("first_order_ts", "last_order_ts")})
    extra = [
        "frequency", "avg_order_value", "avg_items_per_order", "avg_category_diversity",
        "avg_days_between_orders", "orders_30d", "orders_90d", "spend_30d", "spend_90d",
    ]
    full = scores.withColumns({c: F.lit(1.0) for c in extra})
    segments = scores.select("customer_unique_id", F.lit(3).alias("segment"), "segment_name")
    dim = marts.dim_customer(master, segments, full)
    assert len(dim.columns) == 25
    assert as_dict(dim, "customer_unique_id", "segment", "priority_band") == {
        "a": (3, "HIGH"),
        "z": (None, None),
    }


def test_rules(spark):
    df = spark.createDataFrame(
        [("k1", "x", 1, 5.0), ("k1", "y", 2, None), ("k2", "x", 0, 50.0), ("k2", None, 1, 1.0), (None, "x", 3, 2.0)],
        "key string, city string, n int, v double",
    )
    got = as_dict(
        quality.check(
            df,
            quality.row_count("some rows"),
            quality.row_count("many rows", 100),
            quality.no_nulls("v"),
            quality.within("v", 0, 10),
            quality.unique("key"),
            quality.unique("key", "city"),
            quality.single_valued("key", "key", "city"),
            quality.starts_at("n", "key", 1),
        ),
        "rule",
        "observed",
        "passed",
    )
    assert got == {
        "some rows": (5.0, True),
        "many rows": (5.0, False),
        "null v": (1.0, False),
        "v within 0..10": (1.0, False),
        "duplicate key": (2.0, False),
        "duplicate key, city": (0.0, True),
        "key with several key, city": (1.0, False),
        "key whose n does not start at 1": (2.0, False),
    }


def test_named_checks(spark):
    customers = spark.createDataFrame(
        [("p", "rio", "RJ"), ("p", "rio", "SP"), ("q", "rio", "RJ"), ("q", "rio", None), ("r", "a", "b")],
        "customer_unique_id string, customer_city string, customer_state string",
    )
    assert quality.multi_location_customers(customers).first()[0] == 1
    assert quality.table_rows(customers).first()[0] == 5
    assert as_dict(quality.duplicate_keys(customers, "customer_unique_id"), "customer_unique_id", "n") == {
        "p": 2,
        "q": 2,
    }
    assert quality.null_count(customers, "customer_state", "n").first()["n"] == 1


def test_a_key_without_values_does_not_start_anywhere(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", None)], "key string, n int")
    row = quality.check(df, quality.starts_at("n", "key")).first()
    assert (row["observed"], row["passed"]) == (1.0, False)


def test_mean_of_amounts_is_rounded_once(spark):
    rows = [("x", 0.004999999999), ("x", 0.005000000001), ("y", -0.015), ("y", -0.015), ("z", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(amount_mean(F.col("v")).alias("m")).collect()}
    assert got == {"x": D("0.01"), "y": D("-0.02"), "z": None}
