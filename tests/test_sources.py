from decimal import Decimal as D

import pytest

from holdfast.__main__ import main
from holdfast.operators.facts import customer_identity_map, customer_orders, delivered_orders
from holdfast.operators.ranking import top_n
from holdfast.operators.windows import time_features
from holdfast.plans.refresh import load_raw, refresh, verify
from holdfast.session import scratch_root
from holdfast.sources.contracts import RAW, schema_of
from holdfast.sources.csv import read_csv, read_raw
from holdfast.sources.store import CatalogStore, PathStore, register_view
from tests.helpers import when


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_review_text_with_quotes_and_line_breaks(spark, tmp_path):
    text = (
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,"said ""fine""","two\nlines, one cell",2018-01-01 00:00:00,2018-01-02 03:04:05\n'
        "r2,o2,1,,,2018-01-01 00:00:00,\n"
    )
    rows = read_csv(spark, "order_reviews", write(tmp_path / "r.csv", text)).collect()
    assert len(rows) == 2
    assert rows[0]["review_comment_title"] == 'said "fine"'
    assert rows[0]["review_comment_message"] == "two\nlines, one cell"
    assert rows[0]["review_answer_timestamp"] == when("2018-01-02 03:04:05")
    assert rows[1]["review_comment_message"] is None
    assert rows[1]["review_answer_timestamp"] is None


def test_byte_order_mark_and_header_names(spark, tmp_path):
    head = "\ufeffproduct_category_name,product_category_name_english\n"
    path = write(tmp_path / "t.csv", head + "bebes,baby\n")
    assert [tuple(r) for r in read_csv(spark, "category_translation", path).collect()] == [("bebes", "baby")]


def test_columns_go_by_header_name(spark, tmp_path):
    swapped = "product_category_name_english,product_category_name\nbaby,bebes\n"
    path = write(tmp_path / "s.csv", swapped)
    assert [tuple(r) for r in read_csv(spark, "category_translation", path).collect()] == [("bebes", "baby")]
    for head in ("product_category_name", "product_category_name,other", swapped.split()[0] + ",extra"):
        with pytest.raises(ValueError, match="header"):
            read_csv(spark, "category_translation", write(tmp_path / "w.csv", head + "\nx,y,z\n"))


def test_files_of_a_folder_share_one_header(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.csv", "product_category_name,product_category_name_english\nbebes,baby\n")
    write(folder / "b.csv", "product_category_name_english,product_category_name\nbaby,bebes\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, "category_translation", str(folder)).collect()


def test_types_are_fixed_and_misfits_fail(spark, tmp_path):
    head = ",".join(f.name for f in schema_of("order_items").fields) + "\n"
    path = write(tmp_path / "i.csv", head + "o1,1,p1,s1,2018-01-01 00:00:00,10.10,1.5\n")
    row = read_csv(spark, "order_items", path).first()
    assert (row["price"], row["freight_value"], row["order_item_id"]) == (D("10.10"), D("1.50"), 1)
    bad = write(tmp_path / "bad.csv", head + "o1,1,p1,s1,2018-01-01 00:00:00,cheap,1.5\n")
    with pytest.raises(Exception, match="MALFORMED|cheap"):
        read_csv(spark, "order_items", bad).collect()


def test_read_raw_finds_files_by_pattern(spark, tmp_path):
    for table in RAW:
        head = ",".join(f.name for f in schema_of(table).fields) + "\n"
        write(tmp_path / f"shop_{table}_dump.csv", head)
    raw = read_raw(spark, str(tmp_path), "shop_{table}_dump.csv")
    assert sorted(raw) == sorted(RAW)
    assert all(df.count() == 0 and df.schema == schema_of(t) for t, df in raw.items())


def test_replace_is_full_and_counted(spark, tmp_path):
    store = PathStore(spark, str(tmp_path))
    store.replace(spark.range(10), "raw", "t")
    stored, rows = store.replace(spark.range(3), "raw", "t")
    assert (rows, stored.count()) == (3, 3)


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    store = PathStore(spark, str(tmp_path))
    store.replace(spark.range(10), "raw", "t")
    with pytest.raises(Exception, match="(?i)divi"):
        store.replace(spark.range(5).selectExpr("1 div (id - 3) AS id"), "raw", "t")
    assert store.read("raw", "t").count() == 10 and store.has("raw", "t") and not store.has("raw", "u")
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) in (["t"], ["t", "t__next"])


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_view_is_lazy_and_named(spark):
    register_view(spark.range(4), "four_rows")
    assert spark.sql("SELECT count(*) FROM four_rows").first()[0] == 4


@pytest.fixture(scope="module")
def raw(spark):
    """A shop of 120 people over two years, in the raw contracts."""
    people = 120
    orders, customers, items, payments, reviews = [], [], [], [], []
    for p in range(people):
        for k in range(1 + (p * 7) % 6):
            order, account = f"o{p}-{k}", f"c{p}-{k}"
            day = (p * 13 + k * 61) % 700
            at = f"{2017 + day // 365}-{day % 365 // 31 + 1:02d}-{day % 28 + 1:02d} {p % 24:02d}:00:00"
            status = "canceled" if (p + k) % 11 == 0 else "delivered"
            orders.append((order, account, status, at))
            customers.append((account, f"p{p}", 1000 + p % 9, f"city{p % 5}", "SP"))
            for i in range(1 + (p + k) % 3):
                price = round(5 + p * 1.37 + k * 3.11 + i + p * p * 0.013, 2)
                items.append((order, i + 1, f"x{(p + i) % 30}", f"{price}", "2.50"))
            payments.append((order, 1, "card", 1 + p % 4, f"{10 + p}.00"))
            if p % 4:
                reviews.append((f"r{order}", order, 1 + p % 5))
    products = [(f"x{i}", None if i == 0 else f"cat{i % 7}") for i in range(30)]

    def table(name, rows, cols):
        have = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
        return have.selectExpr(
            *[
                f"CAST({f.name if f.name in cols else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
                for f in schema_of(name).fields
            ]
        )

    def text(rows):
        return [tuple(None if v is None else str(v) for v in row) for row in rows]

    return {
        "orders": table(
            "orders", text(orders), ["order_id", "customer_id", "order_status", "order_purchase_timestamp"]
        ),
        "customers": table("customers", text(customers), [f.name for f in schema_of("customers").fields]),
        "order_items": table(
            "order_items", text(items), ["order_id", "order_item_id", "product_id", "price", "freight_value"]
        ),
        "order_payments": table(
            "order_payments", text(payments), [f.name for f in schema_of("order_payments").fields]
        ),
        "products": table("products", text(products), ["product_id", "product_category_name"]),
        "order_reviews": table(
            "order_reviews", text(reviews), ["review_id", "order_id", "review_score"]
        ),
        "category_translation": table(
            "category_translation",
            [(f"cat{i}", f"english{i}") for i in range(5)],
            [f.name for f in schema_of("category_translation").fields],
        ),
    }


def test_refresh_builds_every_table(spark, raw, tmp_path):
    store = PathStore(spark, str(tmp_path))
    loaded = load_raw(raw, store)
    assert loaded["orders"] == raw["orders"].count()
    counts = refresh(store, as_of="2019-06-01")
    people = counts["customer_rfm"]
    assert people == store.read("analytics", "customer_master").count()
    for table in (
        "customer_time_features",
        "customer_segments",
        "customer_churn_scores",
        "marketing_target_list",
        "dim_customer",
    ):
        assert counts[table] == people, table
    assert counts["customer_orders_enriched"] == counts["customer_orders"]
    assert counts["segment_actions"] == 5
    assert counts["segment_profile"] == 5
    assert counts["orders_calendar"] == counts["customer_orders"]
    assert counts["products_translated"] == raw["products"].count()
    assert counts["executive_overview"] == 1 and counts["order_value_by_segment"] <= 5
    assert {
        "retention_curve", "cohort_heatmap", "segment_retention_curve", "risk_distribution",
        "churn_by_segment", "value_at_risk_matrix", "risk_concentration",
    } <= set(counts)
    assert all(store.has("analytics", t) and not store.has("analytics", f"{t}__next") for t in counts)
    report = verify(store).collect()
    assert report and all(r["passed"] for r in report), report
    scores = store.read("analytics", "customer_churn_scores")
    assert scores.where("value_at_risk > monetary OR churn_risk IS NULL").count() == 0
    assert {r[0] for r in scores.select("risk_decile").distinct().collect()} == set(range(10))
    retention = store.read("analytics", "cohort_retention")
    assert retention.where("month_index = 0 AND retention_rate <> 1").count() == 0


def test_tables_and_view_answer_sql(spark, raw):
    """Catalog tables take plain SQL: a view over the raw layer, top lists, filtered counts."""
    store = CatalogStore(spark)
    load_raw(raw, store)
    view = store.create_view(
        "analytics",
        "v_delivered",
        "SELECT order_id, customer_id, order_purchase_timestamp FROM raw.orders "
        "WHERE order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL",
    )
    assert view.count() == delivered_orders(store.read("raw", "orders")).count()
    orders = customer_orders(
        delivered_orders(store.read("raw", "orders")),
        customer_identity_map(store.read("raw", "customers")),
        *[store.read("raw", t) for t in ("order_items", "products", "order_payments", "order_reviews")],
    )
    stored, rows = store.replace(orders, "analytics", "customer_orders", "customer_unique_id")
    store.replace(time_features(stored), "analytics", "customer_time_features")
    active = spark.sql(
        "SELECT count(*) FILTER (WHERE orders_180d > 0) AS active, sum(lifetime_orders) AS orders "
        "FROM analytics.customer_time_features"
    ).first()
    assert 0 < active["active"] <= 120
    assert active["orders"] == rows
    top = spark.sql(
        "SELECT order_id FROM analytics.customer_orders ORDER BY gross_order_value DESC, order_id LIMIT 5"
    )
    picked = top_n(stored, [("gross_order_value", "desc"), ("order_id", "asc")], 5)
    assert [r[0] for r in top.collect()] == [r["order_id"] for r in picked.collect()]
    spark.sql("DROP VIEW analytics.v_delivered")
    for table in raw:
        spark.sql(f"DROP TABLE raw.{table}")
    for table in ("customer_orders", "customer_time_features"):
        spark.sql(f"DROP TABLE analytics.{table}")


def test_command_line(spark, raw, tmp_path, capsys):
    for table, df in raw.items():
        df.write.option("header", True).csv(str(tmp_path / "in" / f"{table}.csv"))
    warehouse = str(tmp_path / "out")
    assert main(["load", str(tmp_path / "in"), warehouse]) == 0
    assert f"orders: {raw['orders'].count()}" in capsys.readouterr().out
    assert main(["refresh", warehouse, "--as-of", "2019-06-01"]) == 0
    assert "weighted avg" in capsys.readouterr().out
    assert main(["verify", warehouse]) == 0


def test_tied_bands_leave_the_analytics_layer(spark, raw, tmp_path):
    """One price for everybody: value bins tie, the refresh fails before it replaces anything."""
    store = PathStore(spark, str(tmp_path))
    flat = raw["order_items"].selectExpr(
        *[f"CAST(1 AS decimal(12,2)) AS {c}" if c == "price" else c for c in raw["order_items"].columns]
    )
    one_each = flat.where("order_item_id = 1 AND order_id LIKE '%-0'")
    load_raw({**raw, "order_items": one_each}, store)
    store.replace(spark.range(7), "analytics", "customer_orders")
    with pytest.raises(ValueError, match="not unique"):
        refresh(store, as_of="2019-06-01")
    assert store.read("analytics", "customer_orders").count() == 7


def test_command_line_asks_for_one_place(capsys):
    for argv in (["verify"], ["verify", "somewhere", "--catalog"]):
        with pytest.raises(SystemExit):
            main(argv)
    capsys.readouterr()


def test_bucketed_tables_join_without_a_shuffle(spark, raw):
    store = CatalogStore(spark, buckets=4)
    left, rows = store.replace(
        raw["customers"].selectExpr("customer_id", "customer_unique_id"), "analytics", "bucketed_map", "customer_id"
    )
    right, _ = store.replace(
        raw["orders"].selectExpr("customer_id", "order_id"), "analytics", "bucketed_orders", "customer_id"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "customer_id")
        assert joined.count() == rows
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE analytics.bucketed_map")
        spark.sql("DROP TABLE analytics.bucketed_orders")
    assert "Exchange" not in plan
