"""RFM, time windows, cohorts, calendar and segment measures."""

from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from holdfast.functions import dates, numbers
from holdfast.operators import calendar, cohorts, rfm, segments, windows
from tests.helpers import as_dict, order_fact, when


def test_whole_days_cut_towards_zero(spark):
    pairs = [
        ("2018-01-03 09:00:00", "2018-01-01 10:00:00", 1),
        ("2018-01-02 10:00:00", "2018-01-01 10:00:00", 1),
        ("2018-01-02 09:59:59.999999", "2018-01-01 10:00:00", 0),
        ("2018-01-01 10:00:00", "2018-01-03 09:00:00", -1),
        ("2018-01-01", "2018-01-01", 0),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want int").select(
        dates.whole_days(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")).alias("got"),
        "want",
    )
    assert all(row["got"] == row["want"] for row in df.collect())


def test_days_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2018-03-25 12:00:00' a, timestamp_ntz'2018-03-24 12:00:00' b")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        row = df.select(
            dates.whole_days(F.col("a"), F.col("b")).alias("days"),
            dates.elapsed_seconds(F.col("a"), F.col("b")).alias("seconds"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row["days"], row["seconds"]) == (1, D("86400.000000"))


@pytest.mark.parametrize(
    "values,expected",
    [
        (["0.01", "0.02"], "0.02"),
        (["0.01", "0.00"], "0.01"),
        (["-0.01", "0.00"], "-0.01"),
        (["1.00", "1.00", "1.01"], "1.00"),
        ([None, "2.50"], "2.50"),
        ([None], None),
    ],
)
def test_means_round_half_away_from_zero(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.agg(numbers.money_mean(F.col("v"), "decimal(14,2)").alias("m")).first()["m"]
    assert got == (None if expected is None else D(expected))


def test_mean_of_a_large_group_is_rounded_once(spark):
    df = spark.range(20000).select(F.when(F.col("id") == 0, "99.99").otherwise("0.00").alias("v"))
    assert df.agg(numbers.money_mean(F.col("v"), "decimal(14,2)").alias("m")).first()["m"] == D("0.00")


def test_rate_and_guarded_ratio(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 0), (0, 5), (1, None)], "a int, b int")
    got = [
        tuple(r)
        for r in df.select(
            numbers.rate(F.col("a"), F.col("b")), numbers.ratio_or_zero(F.col("a"), F.col("b"))
        ).collect()
    ]
    assert got == [
        (D("0.3333"), 1 / 3),
        (D("0.6667"), 2 / 3),
        (None, 0.0),
        (D("0.0000"), 0.0),
        (None, 0.0),
    ]


ORDERS = [
    ("one", "1", "2018-06-01 12:00:00", "10.00", 2, 1),
    ("two", "2", "2018-01-01 00:00:00", "5.00", 1, 1),
    ("two", "3", "2018-01-02 12:00:00", "5.01", 2, 2),
    ("same", "4", "2018-05-01 08:00:00", "1.00", 1, 1),
    ("same", "5", "2018-05-01 08:00:00", "2.00", 1, 1),
    ("many", "6", "2018-01-01 00:00:00", "1.00", 1, 1),
    ("many", "7", "2018-01-11 00:00:00", "1.00", 1, 1),
    ("many", "8", "2018-01-12 00:00:00", "1.00", 4, 2),
]


def test_rfm(spark):
    got = as_dict(
        rfm.customer_rfm(order_fact(spark, ORDERS)),
        "customer_unique_id",
        "recency_days",
        "frequency",
        "monetary",
        "avg_order_value",
        "avg_items_per_order",
        "tenure_days",
        "avg_days_between_orders",
    )
    assert got == {
        "one": (0, 1, D("10.00"), D("10.00"), D("2.00"), 0, None),
        "two": (150, 2, D("10.01"), D("5.01"), D("1.50"), 1, D("1.50")),
        "same": (31, 2, D("3.00"), D("1.50"), D("1.00"), 0, D("0.00")),
        "many": (140, 3, D("3.00"), D("1.00"), D("2.00"), 11, D("5.50")),
    }


def test_rfm_end_can_be_given_and_frequency_counts_distinct_orders(spark):
    orders = order_fact(spark, [("a", "1", "2018-01-01", 5), ("a", "1", "2018-01-03", 5)])
    row = rfm.customer_rfm(orders, end_ts="2018-02-01 00:00:00").first()
    assert (row["recency_days"], row["frequency"], row["avg_days_between_orders"]) == (29, 1, D("2.00"))


def test_gaps_equal_the_pairwise_form(spark):
    orders = order_fact(spark, ORDERS)
    orders.createOrReplaceTempView("gap_orders")
    pairwise = spark.sql(
        """
        SELECT customer_unique_id, CAST(avg(gap) AS DECIMAL(10,2)) AS days FROM (
          SELECT customer_unique_id, timestampdiff(MICROSECOND,
            lag(order_purchase_timestamp) OVER (PARTITION BY customer_unique_id
              ORDER BY order_purchase_timestamp), order_purchase_timestamp) / 86400000000 AS gap
          FROM gap_orders) WHERE gap IS NOT NULL GROUP BY customer_unique_id"""
    )
    assert as_dict(rfm.interpurchase_gaps(orders), "customer_unique_id", "avg_days_between_orders") == (
        as_dict(pairwise, "customer_unique_id", "days")
    )


def test_window_bounds(spark):
    orders = order_fact(
        spark,
        [
            ("end", "1", "2018-07-01 12:00:00", "1.00"),
            ("in", "2", "2018-06-01 12:00:00", "3.00"),
            ("out", "3", "2018-06-01 11:59:59.999999", "5.00"),
            ("free", "4", "2018-07-01 00:00:00", "0.00"),
        ],
    )
    got = as_dict(
        windows.time_features(orders),
        "customer_unique_id",
        "orders_30d",
        "spend_30d",
        "orders_90d",
        "recent_order_ratio",
        "recent_spend_ratio",
        "avg_order_value_180d",
    )
    assert got == {
        "end": (1, D("1.00"), 1, 1.0, 1.0, 1.0),
        "in": (1, D("3.00"), 1, 1.0, 1.0, 3.0),
        "out": (0, D("0.00"), 1, 1.0, 1.0, 5.0),
        "free": (1, D("0.00"), 1, 1.0, 0.0, 0.0),
    }


def test_window_anchor_per_customer(spark):
    orders = order_fact(
        spark,
        [
            ("a", "1", "2018-01-01", "1.00"),
            ("a", "2", "2018-01-31", "2.00"),
            ("a", "3", "2017-01-01", "5.00"),
            ("b", "4", "2018-12-31", "4.00"),
        ],
    )
    own = windows.time_features(orders, anchor="customer_last")
    got = as_dict(own, "customer_unique_id", "orders_30d", "spend_30d", "lifetime_orders", "recent_order_ratio")
    assert got == {"a": (2, D("3.00"), 3, 2 / 3), "b": (1, D("4.00"), 1, 1.0)}
    with pytest.raises(ValueError):
        windows.time_features(orders, anchor="today")
    with pytest.raises(ValueError):
        windows.time_features(orders, ratio_window=45)


def test_cohorts_cross_years_and_skip_quiet_months(spark):
    orders = order_fact(
        spark,
        [
            ("a", "1", "2017-12-31 23:59:59", 1),
            ("a", "2", "2018-01-01", 1),
            ("a", "3", "2018-01-15", 1),
            ("b", "4", "2017-12-05", 1),
            ("b", "5", "2018-03-05", 1),
            ("c", "6", "2018-01-05", 1),
            (None, "7", "2018-01-05", 1),
        ],
    )
    cohort = cohorts.customer_cohort(orders)
    assert sorted((r["customer_unique_id"], r["month_index"]) for r in cohort.collect()) == [
        ("a", 0), ("a", 1), ("b", 0), ("b", 3), ("c", 0),
    ]
    retention = cohorts.cohort_retention(cohort)
    december, january = date(2017, 12, 1), date(2018, 1, 1)
    rows = {
        (r["cohort_month"], r["month_index"]): (r["cohort_size"], r["retained_customers"], r["retention_rate"])
        for r in retention.collect()
    }
    assert rows == {
        (december, 0): (2, 2, D("1.0000")),
        (december, 1): (2, 1, D("0.5000")),
        (december, 3): (2, 1, D("0.5000")),
        (january, 0): (1, 1, D("1.0000")),
    }
    curve = as_dict(cohorts.retention_curve(retention), "month_index", "cohort_size", "retention_rate")
    assert curve == {0: (3, D("1.0000")), 1: (2, D("0.5000")), 3: (2, D("0.5000"))}
    heat = as_dict(cohorts.cohort_heatmap(retention, range(4)), "cohort_month", "month_1", "month_2")
    assert heat == {december: (D("0.5000"), None), january: (None, None)}
    assert {r["min_month_index"] for r in cohorts.cohort_baseline(retention).collect()} == {0}

    segments_ = spark.createDataFrame(
        [("a", "x"), ("b", "y"), ("c", None)], "customer_unique_id string, segment_name string"
    )
    by = cohorts.cohort_retention_by(cohort, segments_)
    assert sorted((r["segment_name"], r["month_index"], r["cohort_size"]) for r in by.collect()) == [
        ("x", 0, 1), ("x", 1, 1), ("y", 0, 1), ("y", 3, 1),
    ]


def iso(day):
    return day.isocalendar()


def test_calendar_against_python(spark):
    orders = order_fact(spark, [("a", "1", "2015-12-20 13:00:00", 1), ("a", "2", "2020-03-05", 1)])
    days = calendar.dim_date(orders).collect()
    start = date(2015, 12, 20)
    assert [r["date"] for r in days] == [start + timedelta(n) for n in range(len(days))]
    assert days[-1]["date"] == date(2020, 3, 5)
    assert len(days[0]) == 22
    for row in days:
        day = row["date"]
        fiscal = day.year if day.month >= 4 else day.year - 1
        nxt = day + timedelta(1)
        assert (row["week_of_year"], row["iso_year"], row["iso_day_of_week"]) == (
            iso(day).week, iso(day).year, iso(day).weekday,
        )
        assert (row["month_name"], row["day_name"], row["month_name_short"], row["day_name_short"]) == (
            day.strftime("%B"), day.strftime("%A"), day.strftime("%b"), day.strftime("%a"),
        )
        assert row["fiscal_year_start"] == fiscal
        assert row["fiscal_year_label"] == f"FY{fiscal}/{(fiscal + 1) % 100:02d}"
        assert row["fiscal_month"] == (day.month - 4) % 12 + 1
        assert row["fiscal_quarter"] == (row["fiscal_month"] - 1) // 3 + 1
        assert row["is_month_end"] == (nxt.month != day.month)
        assert row["is_month_start"] == (day.day == 1)
        assert (row["quarter_end"] + timedelta(1)).day == 1
        assert row["quarter_start"] <= day <= row["quarter_end"]
        assert row["month_start"] <= day <= row["month_end"]
    bounds = calendar.calendar_bounds(calendar.dim_date(orders)).first()
    assert tuple(bounds) == (len(days), start, date(2020, 3, 5))


def test_calendar_padding_other_fiscal_start_and_empty_input(spark):
    orders = order_fact(spark, [("a", "1", "2018-05-01", 1)])
    row = calendar.dim_date(orders, fiscal_start_month=1, pg_padding=True).first()
    assert (row["month_name"], row["day_name"]) == ("May      ", "Tuesday  ")
    assert (row["fiscal_year_start"], row["fiscal_month"], row["fiscal_quarter"]) == (2018, 5, 2)
    assert calendar.dim_date(orders.where("false")).count() == 0


def enriched(spark):
    rows = [
        ("a", "1", "2018-01-01", "10.00", 1, 1),
        ("a", "2", "2018-01-11", "20.00", 2, 1),
        ("a", "3", "2018-01-21", "30.00", 3, 2),
        ("b", "4", "2018-01-31", "5.00", 1, 1),
        ("c", "5", "2018-01-31", "7.00", 1, 1),
    ]
    return (
        order_fact(spark, rows)
        .withColumn("segment_name", F.when(F.col("customer_unique_id") != "c", F.lit("S")))
        .withColumn("avg_review_score", F.when(F.col("order_id") == "1", F.lit(D("4.50"))))
    )


@pytest.mark.parametrize(
    "weighting,orders_per,spend_per,recency",
    [("order", "2.50", "46.25", "11.00"), ("customer", "2.00", "32.50", "6.00")],
)
def test_segment_kpis(spark, weighting, orders_per, spend_per, recency):
    kpis = segments.segment_kpis(enriched(spark), "2018-02-01", weighting).collect()
    assert len(kpis) == 1
    row = kpis[0]
    assert (row["customers"], row["orders"], row["revenue"]) == (2, 4, D("65.00"))
    assert (row["avg_order_value"], row["avg_items_per_order"]) == (D("16.25"), D("1.75"))
    assert row["avg_review_score"] == D("4.50")
    assert row["avg_orders_per_customer"] == D(orders_per)
    assert row["avg_spend_per_customer"] == D(spend_per)
    assert row["median_recency_days"] == D(recency)


def test_dataset_end_type(spark):
    orders = order_fact(spark, ORDERS)
    row = orders.select(rfm.dataset_end(orders).alias("e")).first()
    assert row["e"] == when("2018-06-01 12:00:00")


def test_own_last_window_and_dealt_join_agree(spark, monkeypatch):
    """One person holds two thirds of the orders; some orders are nobody's."""
    rows = [(f"p{k % 3 and 1}" if k % 3 else f"q{k}", f"o{k}", f"2018-{1 + k % 6:02d}-{1 + k % 28:02d}", k % 7) for k in range(90)]
    orders = order_fact(spark, rows + [(None, "x", "2018-01-01", 5)])
    dealt = windows.time_features(orders, anchor="customer_last")
    names = sorted(c for c in dealt.columns if c != "customer_unique_id")
    assert "_share" in dealt._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(windows, "heavy_keys", lambda *_: ([], False))
    plain = windows.time_features(orders, anchor="customer_last")
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert as_dict(dealt, "customer_unique_id", *names) == as_dict(plain, "customer_unique_id", *names)
    assert None not in as_dict(plain, "customer_unique_id", *names)
