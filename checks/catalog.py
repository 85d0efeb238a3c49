"""One registered query per operator, over the given tables.

Models and other operators that take a score or a label are also run here on
columns computed from the tables, so that plain SQL can check their results.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables as T
from holdfast.operators import (
    calendar,
    churn,
    cohorts,
    facts,
    impute,
    logistic,
    marts,
    quality,
    ranking,
    rfm,
    segments,
    windows,
)
from holdfast.operators.facts import PERSON
from holdfast.session import scratch_root
from holdfast.sources.csv import read_csv
from holdfast.sources.snapshots import SnapshotStore
from holdfast.sources.store import CatalogStore, PathStore, register_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2002-01-01"
EVENT_WINDOWS = (3, 7, 14)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _delivered(spark, sf):
    return facts.delivered_orders(T.orders(spark, sf), T.DELIVERED)


def _fact(spark, sf):
    return facts.customer_orders(
        _delivered(spark, sf),
        facts.customer_identity_map(T.customers(spark, sf)),
        T.order_items(spark, sf),
        T.products(spark, sf),
        T.order_payments(spark, sf),
        T.order_reviews(spark, sf),
    )


def _rfm(spark, sf):
    return rfm.customer_rfm(T.order_log(spark, sf))


def _scored(spark, sf):
    """RFM with a score and label computed from recency, and its value at risk."""
    people = churn.label_churn(_rfm(spark, sf)).join(
        T.segments(spark, sf).select(PERSON, "segment_name"), PERSON, "left"
    )
    recency = F.col("recency_days").cast("double")
    return churn.value_at_risk(people.withColumn("churn_risk", recency / (recency + F.lit(365.0))))


def _score_table(spark, sf):
    """The score table with recent activity, decile and priority."""
    recent = windows.time_features(T.order_log(spark, sf)).select(
        PERSON, "orders_30d", "orders_90d", "spend_30d", "spend_90d"
    )
    banded = churn.priority_band(churn.risk_decile(_scored(spark, sf)))
    return churn.churn_scores(banded.join(recent, PERSON))


# --- sources and sinks ---------------------------------------------------------------


@query
def csv_scan(spark, sf):
    """Accounts written as CSV and read back through the fixed contract."""
    path = f"{scratch_root(spark)}/customers-csv-{uuid4()}"
    rows = T.customers(spark, sf).select(
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
    )
    rows.write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, "customers", path)


@query
def csv_free_text(spark, sf):
    """Reviews with quotes, commas and line breaks in their text, read back record by record."""
    path = f"{scratch_root(spark)}/reviews-csv-{uuid4()}"
    line = T.table(spark, sf, "lineitem")
    message = F.concat(
        F.lit('part "'), F.col("l_partkey").cast("string"), F.lit('",\n"'), "l_returnflag", F.lit("\n\n"), "l_linestatus"
    )
    none = F.lit(None).cast("string")
    line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        (F.col("l_linenumber") % 5 + 1).cast("int").alias("review_score"),
        none.alias("review_comment_title"),
        message.alias("review_comment_message"),
        none.alias("review_creation_date"),
        none.alias("review_answer_timestamp"),
    ).write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "").csv(path)
    return read_csv(spark, "order_reviews", path).select("review_id", "order_id", "review_score", "review_comment_message")


@query
def replace_table(spark, sf):
    """A table replaced twice holds the second content, with the rows counted on the way."""
    store = PathStore(spark, f"{scratch_root(spark)}/replaced-{uuid4()}")
    items = T.order_items(spark, sf).select("order_id", "price")
    store.replace(items.select("order_id", (F.col("price") + 1).alias("price")), "raw", "replaced_items")
    stored, rows = store.replace(items, "raw", "replaced_items")
    return stored.agg(F.sum("price").cast("decimal(28,2)").alias("price_total")).withColumn(
        "rows_written", F.lit(rows).cast("long")
    )


@query
def snapshot_tables(spark, sf):
    """What a reader sees of two tables after a refresh that stopped between them."""
    store = SnapshotStore(spark, f"{scratch_root(spark)}/snapshots-{uuid4()}")
    items, orders = T.order_items(spark, sf), _delivered(spark, sf)
    tables = {"items": items.select("order_id", "price"), "orders": orders.select("order_id")}
    for name, df in tables.items():
        store.stage(df, "analytics", name)
    store.publish("analytics", tables)
    pinned = store.snapshot("analytics")
    store.stage(tables["items"].limit(0), "analytics", "items")  # never published
    store.replace(tables["orders"].limit(0), "analytics", "orders")
    sums = pinned.read("items").agg(F.sum("price").cast("decimal(28,2)").alias("price_total"))
    counts = [
        F.lit(at.read(name).count()).alias(f"{moment}_{name}")
        for moment, at in (("pinned", pinned), ("newest", store.snapshot("analytics")))
        for name in tables
    ]
    return sums.select("price_total", *[c.cast("long").alias(n) for c, n in zip(
        counts, ("pinned_items", "pinned_orders", "newest_items", "newest_orders"), strict=True)])


@query
def view_scan(spark, sf):
    """Delivered orders through a session view."""
    register_view(_delivered(spark, sf), "delivered_orders_view")
    return spark.sql("SELECT customer_id, count(*) AS orders FROM delivered_orders_view GROUP BY customer_id")


@query
def layer_table(spark, sf):
    """Accounts per person from a managed, bucketed table of a layer that is created for it."""
    store = CatalogStore(spark, buckets=4)
    name = f"layer_accounts_{uuid4().hex}"  # folders of earlier sessions may still be there
    stored, _ = store.replace(T.customers(spark, sf), "raw", name, PERSON)
    return stored.groupBy(PERSON).agg(F.count(F.lit(1)).alias("accounts"))


# --- order facts ---------------------------------------------------------------------


@query
def delivered_orders(spark, sf):
    return _delivered(spark, sf)


@query
def customer_identity_map(spark, sf):
    return facts.customer_identity_map(T.customers(spark, sf))


@query
def primary_location(spark, sf):
    return facts.primary_location(T.customers(spark, sf))


@query
def customer_master(spark, sf):
    return facts.customer_master(_delivered(spark, sf), T.customers(spark, sf))


@query
def order_item_rollup(spark, sf):
    return facts.order_item_rollup(T.order_items(spark, sf))


@query
def order_category_diversity(spark, sf):
    return facts.order_category_diversity(T.order_items(spark, sf), T.products(spark, sf))


@query
def order_basket_rollup(spark, sf):
    return facts.order_basket_rollup(T.order_items(spark, sf), T.products(spark, sf))


@query
def order_payment_rollup(spark, sf):
    return facts.order_payment_rollup(T.order_payments(spark, sf))


@query
def order_review_rollup(spark, sf):
    return facts.order_review_rollup(T.order_reviews(spark, sf))


@query
def customer_orders(spark, sf):
    return _fact(spark, sf)


@query
def orders_enriched(spark, sf):
    return facts.orders_enriched(T.order_log(spark, sf), T.segments(spark, sf))


@query
def orders_calendar(spark, sf):
    log = T.order_log(spark, sf)
    return facts.orders_calendar(log, calendar.dim_date(log), cohorts.customer_cohort(log))


@query
def translate_category(spark, sf):
    return facts.translate_category(T.products(spark, sf), T.category_names(spark, sf))


# --- recency, frequency, monetary ----------------------------------------------------


@query
def interpurchase_gaps(spark, sf):
    return rfm.interpurchase_gaps(T.event_log(spark, sf))


@query
def interpurchase_gaps_orders(spark, sf):
    return rfm.interpurchase_gaps(T.order_log(spark, sf))


@query
def customer_rfm(spark, sf):
    """Order fact built from all raw tables, then RFM per person."""
    return rfm.customer_rfm(_fact(spark, sf))


@query
def customer_rfm_accounts(spark, sf):
    return _rfm(spark, sf)


@query
def customer_rfm_events(spark, sf):
    return rfm.customer_rfm(T.event_log(spark, sf))


# --- time windows --------------------------------------------------------------------


@query
def time_features(spark, sf):
    return windows.time_features(T.order_log(spark, sf))


@query
def time_features_events(spark, sf):
    return windows.time_features(T.event_log(spark, sf), EVENT_WINDOWS)


@query
def time_features_customer_last(spark, sf):
    return windows.time_features(T.order_log(spark, sf), anchor="customer_last")


# --- cohorts -------------------------------------------------------------------------


def _cohort(spark, sf):
    return cohorts.customer_cohort(T.order_log(spark, sf))


def _retention(spark, sf):
    return cohorts.cohort_retention(_cohort(spark, sf))


def _segment_retention(spark, sf):
    return cohorts.cohort_retention_by(_cohort(spark, sf), T.segments(spark, sf))


@query
def customer_cohort(spark, sf):
    return _cohort(spark, sf)


@query
def customer_cohort_events(spark, sf):
    return cohorts.customer_cohort(T.event_log(spark, sf))


@query
def cohort_retention(spark, sf):
    return _retention(spark, sf)


@query
def cohort_retention_by_segment(spark, sf):
    return _segment_retention(spark, sf)


@query
def retention_curve(spark, sf):
    return cohorts.retention_curve(_retention(spark, sf))


@query
def segment_retention_curve(spark, sf):
    return cohorts.retention_curve(_segment_retention(spark, sf), ["segment_name"])


@query
def cohort_heatmap(spark, sf):
    """The heatmap's cells, one row per cohort and month, unobserved ones included."""
    return cohorts.heatmap_cells(cohorts.cohort_heatmap(_retention(spark, sf)))


@query
def cohort_baseline(spark, sf):
    return cohorts.cohort_baseline(_retention(spark, sf))


@query
def cohort_peek(spark, sf):
    order = [("cohort_month", "asc"), ("month_index", "asc")]
    return ranking.top_n(_retention(spark, sf), order, 50)


# --- calendar ------------------------------------------------------------------------


@query
def dim_date(spark, sf):
    return calendar.dim_date(T.order_log(spark, sf))


@query
def dim_date_padded(spark, sf):
    return calendar.dim_date(T.event_log(spark, sf), fiscal_start_month=10, pg_padding=True)


@query
def calendar_bounds(spark, sf):
    return calendar.calendar_bounds(calendar.dim_date(T.order_log(spark, sf)))


# --- ranks, tiles, quantiles ---------------------------------------------------------


@query
def global_ntile(spark, sf):
    items = T.order_items(spark, sf).groupBy("product_id").agg(F.sum("price").alias("revenue"))
    return ranking.global_ntile(items, [("revenue", "desc")], "product_id", 7, "tile").select(
        "product_id", "tile"
    )


@query
def global_ntile_tied(spark, sf):
    """Whole-table tiles over a column with a few values, told apart by the order key."""
    rows = T.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ranking.global_ntile(rows, [("o_orderpriority", "desc")], "o_orderkey", 10, "tile")


@query
def quantile_bins(spark, sf):
    rows = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.quantile_bins(rows, "o_totalprice", 10, "bin").select("o_orderkey", "bin")


@query
def quantile_bins_tied(spark, sf):
    """Bins over a column with repeated values; equal edges merge."""
    rows = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ranking.quantile_bins(rows, "l_quantity", 25, "bin", duplicates="drop")


@query
def median_fill(spark, sf):
    """Account balances below zero count as missing and take the median of the rest."""
    rows = T.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance")
    )
    return impute.fill_medians(rows, ["balance"])


# --- segments ------------------------------------------------------------------------


@query
def prepare_rfm_features(spark, sf):
    features = segments.prepare_rfm_features(_rfm(spark, sf))
    return features.withColumns(
        {name: F.round(name, 9) for name in features.columns if name.endswith("_log")}
    )


@query
def standardize(spark, sf):
    scaled = segments.standardize(segments.prepare_rfm_features(_rfm(spark, sf)))
    return scaled.select(
        PERSON, *[F.round(f"{name}_z", 6).alias(f"{name}_z") for name in segments.FEATURES]
    )


def _profile(spark, sf):
    """Profile by market segment, as if it were a cluster number."""
    people = segments.prepare_rfm_features(_rfm(spark, sf))
    labelled = people.join(T.segments(spark, sf).select(PERSON, "segment_name"), PERSON)
    return labelled, segments.profile_segments(labelled, "segment_name")


@query
def profile_segments(spark, sf):
    profile = _profile(spark, sf)[1]
    return profile.withColumns({name: F.round(name, 6) for name in segments.METRICS})


@query
def name_segments(spark, sf):
    """Names by rank over 25 groups (the nations), so that several rules apply."""
    people = segments.prepare_rfm_features(_rfm(spark, sf))
    labelled = people.join(T.segments(spark, sf).select(PERSON, "segment"), PERSON)
    named = segments.name_segments(segments.profile_segments(labelled))
    return named.select("segment", "customers", "segment_name")


@query
def assign_segments(spark, sf):
    people = segments.prepare_rfm_features(_rfm(spark, sf))
    labelled = people.join(T.segments(spark, sf).select(PERSON, "segment"), PERSON)
    named = segments.name_segments(segments.profile_segments(labelled))
    return segments.assign_segments(labelled, named)


@query
def segment_actions(spark, sf):
    """Each group's name by rank with the playbook entry for it."""
    return name_segments(spark, sf).join(segments.segment_actions(spark), "segment_name", "left")


def _enriched(spark, sf):
    reviewed = T.order_log(spark, sf).drop("avg_review_score").join(
        facts.order_review_rollup(T.order_reviews(spark, sf)), "order_id", "left"
    )
    return facts.orders_enriched(reviewed, T.segments(spark, sf))


@query
def segment_kpis(spark, sf):
    return segments.segment_kpis(_enriched(spark, sf), AS_OF)


@query
def segment_kpis_by_customer(spark, sf):
    return segments.segment_kpis(_enriched(spark, sf), AS_OF, "customer")


@query
def segment_kpis_ranked(spark, sf):
    """All segments and measures, ordered by revenue."""
    kpis = segments.segment_kpis(_enriched(spark, sf), AS_OF)
    return kpis.orderBy(*ranking.sort_columns([("revenue", "desc"), ("segment_name", "asc")]))


@query
def choose_k(spark, sf):
    scaled = segments.standardize(segments.prepare_rfm_features(_rfm(spark, sf)))
    scores = segments.choose_k(scaled, [f"{name}_z" for name in segments.FEATURES])
    return spark.createDataFrame([(k, round(s, 6)) for k, s in scores], "k int, silhouette double")


@query
def kmeans_segments(spark, sf):
    """Segments from K-Means itself, one row per person."""
    return segments.segment_customers(_rfm(spark, sf))[0]


@query
def kmeans_profile(spark, sf):
    profile = segments.segment_customers(_rfm(spark, sf))[1]
    # to six places; means of few rows often end in a 5 at the seventh, which goes up
    return profile.withColumns(
        {name: F.floor(F.col(name) * 1e6 + 0.501) / 1e6 for name in (*segments.METRICS, "share")}
    )


@query
def kmeans_fixed_point(spark, sf):
    """Per person: whether their segment's mean is the nearest of all segment means."""
    scaled = segments.standardize(segments.prepare_rfm_features(_rfm(spark, sf)))
    features = [f"{name}_z" for name in segments.FEATURES]
    labelled = segments.label_segments(segments.fit_kmeans(scaled, features), scaled).persist()
    means = labelled.groupBy("segment").agg(*[F.avg(name).alias(name) for name in features]).collect()
    labelled = labelled.select(PERSON, "segment", *features)

    def distance(mean):
        return sum((F.col(name) - F.lit(mean[name])) ** 2 for name in features)

    nearest = F.least(*[distance(m) for m in means], F.lit(float("inf")), F.lit(float("inf")))
    own = F.coalesce(*[F.when(F.col("segment") == m["segment"], distance(m)) for m in means])
    # Lloyd's steps end within this distance of a fixed point
    return labelled.select(PERSON, (own <= nearest + F.lit(0.05)).alias("is_nearest"))


@query
def kmeans_sizes(spark, sf):
    """Number of segments, people in them, and the share of people over all segments."""
    profile = segments.segment_customers(_rfm(spark, sf))[1]
    return profile.agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("customers").alias("customers"),
        F.round(F.sum("share"), 9).alias("share"),
    )


@query
def choose_k_range(spark, sf):
    """Each cluster count with whether its silhouette is a possible and a positive one."""
    return choose_k(spark, sf).select("k", F.col("silhouette").between(0.0, 1.0).alias("is_valid"))


# --- churn ---------------------------------------------------------------------------


def _frame(spark, sf):
    log = T.order_log(spark, sf)
    return churn.training_frame(
        rfm.customer_rfm(log), T.segments(spark, sf), windows.time_features(log)
    )


def _trainable(spark, sf):
    return churn.label_churn(churn.impute_training(_frame(spark, sf)))


@query
def training_frame(spark, sf):
    return _frame(spark, sf)


@query
def impute_training(spark, sf):
    return churn.impute_training(_frame(spark, sf)).select(
        PERSON, *churn.LIFETIME, *churn.RECENT, "segment_name"
    )


@query
def encode_features(spark, sf):
    frame = _trainable(spark, sf)
    encoded = churn.encode_features(frame, frame)
    return encoded.withColumns({c: F.round(c, 6) for c in encoded.columns if c.endswith("_z")})


@query
def label_churn(spark, sf):
    return churn.label_churn(_rfm(spark, sf)).select(PERSON, "recency_days", "churned")


@query
def class_balance(spark, sf):
    return churn.class_balance(churn.label_churn(_rfm(spark, sf)))


@query
def stratified_split(spark, sf):
    """Each person's class and side."""
    train, held_out = churn.stratified_split(churn.label_churn(_rfm(spark, sf)))
    return train.select(PERSON, "churned", F.lit("train").alias("side")).unionAll(
        held_out.select(PERSON, "churned", F.lit("test").alias("side"))
    )


@query
def roc_auc(spark, sf):
    """AUC of order value as a score for urgent orders; scores repeat."""
    rows = T.table(spark, sf, "orders").select(
        (F.floor(F.col("o_totalprice") / 1000)).alias("score"),
        F.col("o_orderpriority").startswith("1").cast("int").alias("urgent"),
    )
    auc = churn.roc_auc(rows, "score", "urgent")
    return spark.createDataFrame([(round(auc, 9),)], "roc_auc double")


@query
def classification_report(spark, sf):
    rows = T.table(spark, sf, "orders").select(
        (F.col("o_totalprice") / 500000.0).alias("score"),
        F.col("o_orderpriority").startswith("1").cast("int").alias("urgent"),
    )
    report = churn.classification_report(rows, "score", "urgent")
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1_score")})


@query
def risk_decile(spark, sf):
    return churn.risk_decile(_scored(spark, sf)).select(PERSON, "risk_decile")


@query
def decile_lift(spark, sf):
    return churn.decile_lift(churn.risk_decile(_scored(spark, sf)))


@query
def priority_band(spark, sf):
    return churn.priority_band(_scored(spark, sf)).select(
        PERSON, "risk_band", "value_band", "priority_band"
    )


@query
def value_at_risk(spark, sf):
    return _scored(spark, sf).select(PERSON, "monetary", "churn_risk", "value_at_risk")


@query
def churn_scores(spark, sf):
    return _score_table(spark, sf)


@query
def churn_model_scores(spark, sf):
    """Scores of the fitted model for every person."""
    scored, _, _ = churn.score_churn(_trainable(spark, sf))
    return scored.select(PERSON, "churned", F.round("churn_risk", 6).alias("churn_risk"))


@query
def churn_model_report(spark, sf):
    """Hold-out report of the fitted model, its AUC, and the AUC without recent activity."""
    _, auc, report, auc_without = churn.evaluate_churn(_trainable(spark, sf))
    rounded = {c: F.round(c, 9) for c in ("precision", "recall", "f1_score")}
    aucs = {"roc_auc": F.lit(round(auc, 9)), "roc_auc_without_recent": F.lit(round(auc_without, 9))}
    return report.withColumns(rounded | aucs)


@query
def churn_calibration(spark, sf):
    """Weighted churn and modelled churn per segment of the training rows."""
    train, _ = churn.stratified_split(_trainable(spark, sf))
    scored = churn.score_newton(churn.fit_churn_newton(train), churn.balanced_weights(train))
    sums = logistic.calibration(scored, "segment_name", "churned", "_weight", "churn_risk")
    return sums.withColumns({c: F.round(c, 5) for c in ("expected", "modelled")})


@query
def churn_scores_valid(spark, sf):
    """Each person's class, and whether the model gave them one probability inside (0, 1)."""
    scored, _, _ = churn.score_churn(_trainable(spark, sf))
    risk = F.col("churn_risk")
    return scored.select(PERSON, "churned", ((risk > 0) & (risk < 1)).alias("is_valid"))


@query
def churn_gradient(spark, sf):
    """Whether the penalised gradient of the fitted model is zero, per coefficient."""
    train, _ = churn.stratified_split(_trainable(spark, sf))
    model = churn.fit_churn(train)
    weighted = churn.balanced_weights(train)
    last = model.stages[-1]
    width = last.coefficients.size
    scored = model.transform(weighted).select(
        vector_to_array("_features").alias("x"), vector_to_array("_probability")[1].alias("p"),
        F.col("churned").cast("double").alias("y"), F.col("_weight").alias("w"),
    )
    slope = F.col("w") * (F.col("p") - F.col("y"))
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(slope * F.col("x")[i]).alias(f"g{i}") for i in range(width)],
        F.sum(slope).alias(f"g{width}"),
    ).first()
    rows = [
        (i, bool(abs(sums[f"g{i}"] + (float(last.coefficients[i]) if i < width else 0.0)) / sums["n"] < 1e-3))
        for i in range(width + 1)
    ]
    return spark.createDataFrame(rows, "coefficient int, is_zero boolean")


@query
def churn_report_sums(spark, sf):
    """Hold-out rows and classes of the model report, and whether its figures are shares."""
    report = churn_model_report(spark, sf)
    figures = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "f1_score", "roc_auc")]
    return report.select(
        F.col("class").alias("line"),
        F.when(F.col("class").isin("0", "1"), F.lit(None)).otherwise(F.col("support")).cast("long").alias("held_out"),
        (figures[0] & figures[1] & figures[2] & figures[3]).alias("is_valid"),
    )


# --- lists, dimensions, dashboards ---------------------------------------------------


def _targets(spark, sf):
    return marts.marketing_target_list(_scored(spark, sf), _rfm(spark, sf))


@query
def marketing_target_list(spark, sf):
    return _targets(spark, sf)


@query
def priority_distribution(spark, sf):
    return marts.count_by(_targets(spark, sf), "priority_band")


@query
def top_priority_targets(spark, sf):
    return marts.top_priority_targets(_targets(spark, sf))


@query
def dim_customer(spark, sf):
    accounts = T.customers(spark, sf).withColumn(PERSON, F.col("customer_id"))
    master = facts.customer_master(_delivered(spark, sf), accounts)
    return marts.dim_customer(master, T.segments(spark, sf), _score_table(spark, sf))


@query
def value_at_risk_by_band(spark, sf):
    return marts.value_at_risk_by(_score_table(spark, sf))


@query
def value_at_risk_by_segment_and_band(spark, sf):
    return marts.value_at_risk_by(_score_table(spark, sf), ["segment_name", "priority_band"])


@query
def value_at_risk_matrix(spark, sf):
    return marts.value_at_risk_matrix(_score_table(spark, sf))


@query
def top_value_at_risk(spark, sf):
    return marts.top_value_at_risk(_score_table(spark, sf))


@query
def executive_overview(spark, sf):
    overview = marts.executive_overview(_score_table(spark, sf))
    return overview.withColumn("churn_rate", F.round("churn_rate", 9))


@query
def risk_distribution(spark, sf):
    shares = marts.risk_distribution(_score_table(spark, sf))
    return shares.withColumns({c: F.round(c, 9) for c in ("customer_share", "value_share")})


@query
def churn_by_segment(spark, sf):
    rates = marts.churn_by_segment(_scored(spark, sf))
    return rates.withColumns({c: F.round(c, 9) for c in ("churn_rate", "avg_churn_risk")})


@query
def order_value_by_segment(spark, sf):
    return marts.order_value_by_segment(_enriched(spark, sf))


@query
def risk_concentration(spark, sf):
    shares = marts.risk_concentration(_score_table(spark, sf))
    return shares.withColumns({c: F.round(c, 9) for c in ("value_share", "cumulative_share")})


# --- data quality --------------------------------------------------------------------


@query
def multi_location_customers(spark, sf):
    return quality.multi_location_customers(T.customers(spark, sf))


@query
def table_row_count(spark, sf):
    return quality.table_rows(_delivered(spark, sf))


@query
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(T.order_items(spark, sf), "order_id", "order_item_id")


@query
def null_purchase_times(spark, sf):
    return quality.null_count(T.orders(spark, sf))


@query
def recency_range(spark, sf):
    return quality.value_range(_rfm(spark, sf))


@query
def repeat_customers(spark, sf):
    return quality.repeat_customers(_rfm(spark, sf))


@query
def window_spend_means(spark, sf):
    return quality.window_spend_means(windows.time_features(T.order_log(spark, sf)))


@query
def window_activity(spark, sf):
    return quality.window_activity(windows.time_features(T.order_log(spark, sf)))


@query
def quality_check(spark, sf):
    """Plain and keyed rules over the line items; some of them fail on purpose."""
    return quality.check(
        T.order_items(spark, sf),
        quality.row_count("items"),
        quality.no_nulls("product_id"),
        quality.within("freight_value", 1, 40),
        quality.unique("order_id", "order_item_id"),
        quality.single_valued("order_id", "product_id", "seller_id"),
        quality.starts_at("order_item_id", "order_id", 1),
    )


