from collections import Counter

import pytest
from pyspark.sql import functions as F

from holdfast.operators import joins
from holdfast.operators.joins import heavy_keys, hot_keys, skew_join


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows: a third on key 7, a tenth without a key, the rest on 300 keys."""
    return (
        spark.range(3000)
        .select(
            F.col("id").alias("row"),
            F.when(F.col("id") % 3 == 0, F.lit(7))
            .when(F.col("id") % 10 == 1, F.lit(None).cast("int"))
            .otherwise((F.col("id") % 300 + 1000).cast("int"))
            .alias("key"),
        )
    )


@pytest.fixture(scope="module")
def names(spark):
    keys = [(7, "hot"), (7, "hot too"), (None, "nobody"), (99999, "unused")]
    return spark.createDataFrame(
        keys + [(k, f"name {k}") for k in range(1000, 1200)], "key int, name string"
    )


def bag(df):
    return Counter(tuple(row[c] for c in ("row", "key", "name")) for row in df.collect())


def test_hot_keys_are_few_and_their_shares_bounded(skewed):
    hot = {row["key"]: row["_shares"] for row in hot_keys(skewed, "key", 50).collect()}
    assert set(hot) == {7}
    assert 15 <= hot[7] <= 50
    assert hot_keys(skewed, "key", 2).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast_limit", ["10m", "-1"])
def test_same_rows_as_a_plain_join(spark, skewed, names, how, broadcast_limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_limit)
    try:
        mine = skew_join(skewed, names, "key", how, spread=["row"])
        assert bag(mine) == bag(skewed.join(names, "key", how))
        assert mine.columns == ["key", "row", "name"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_rows_spread_over_tasks(spark, skewed, names):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = names.where("name <> 'hot too'")

        def largest(df):
            sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            return max(row["count"] for row in sizes)

        plain = largest(skewed.join(one, "key", "left"))
        spread = largest(skew_join(skewed, one, "key", "left", spread=["row"]))
        assert plain >= 1000
        assert spread < 700
    finally:
        for conf in (
            "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.coalescePartitions.enabled",
        ):
            spark.conf.unset(conf)


def test_counted_on_another_table_changes_nothing(skewed, names):
    twice = skewed.unionAll(skewed)
    mine = skew_join(skewed, names, "key", "left", spread=["row"], counted_on=twice)
    assert bag(mine) == bag(skewed.join(names, "key", "left"))


def test_empty_sides_and_bad_type(skewed, names):
    assert skew_join(skewed.where("false"), names, "key").count() == 0
    assert skew_join(skewed, names.where("false"), "key", "left").count() == 3000
    with pytest.raises(ValueError):
        skew_join(skewed, names, "key", "full")


def test_sketches_find_the_same_hot_keys(spark, skewed, monkeypatch):
    for n in (3, 8, 50, 200):
        exact = sorted((r["key"], r["_shares"]) for r in hot_keys(skewed, "key", n).collect())
        assert heavy_keys(skewed, "key", n)[0] == exact
    text = skewed.select(F.concat(F.lit("k"), "key").alias("key"), "row")
    assert [k for k, _ in heavy_keys(text, "key", 50)[0]] == ["k7"]
    assert heavy_keys(skewed.where("false"), "key", 8) == ([], False)
    assert heavy_keys(skewed.where("key is null"), "key", 8) == ([], True)
    # as many keys as a sketch holds, many times over, and a few just over a share
    many = spark.range(60_000).select(F.when(F.col("id") % 6 == 0, F.col("id") % 4).otherwise(F.col("id") + 10).alias("key"))
    exact = sorted((r["key"], r["_shares"]) for r in hot_keys(many, "key", 14).collect())
    assert exact and heavy_keys(many, "key", 14)[0] == exact
    monkeypatch.setattr(joins, "MOST_SHARES", 2)
    assert heavy_keys(skewed, "key", 49)[0] == []  # a third is under a half


def test_no_grouping_by_key_and_a_plain_join_without_hot_keys(spark, skewed, names):
    even = skewed.where("key > 1000")
    plan = skew_join(even, names, "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "_share" not in plan and "Aggregate" not in plan
    plan = skew_join(skewed, names, "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "_share" in plan and "Aggregate" not in plan


def test_answers_are_remembered(spark, skewed):
    heavy_keys(skewed, "key", 77)
    size = len(joins._FOUND)
    heavy_keys(skewed, "key", 77)
    assert len(joins._FOUND) == size <= joins.REMEMBERED
