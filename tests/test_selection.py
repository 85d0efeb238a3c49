"""Ranks by histograms against Spark's own sort, for every type and with tiny bins."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import ranking, selection
from holdfast.operators.ranking import sort_columns

INF, NAN = float("inf"), float("nan")
TYPES = {
    "double": [0.5, -0.0, 0.0, 1e300, -1e300, INF, -INF, NAN, 3.25, 3.25, None, 5e-324],
    "float": [0.5, 1.5, -2.5, INF, NAN, None, 0.5],
    "bigint": [2**63 - 1, -(2**63), 0, 1, 1, None, 2**53 + 1, 2**53],
    "int": [3, 3, 3, -7, None, 12],
    "decimal(20,2)": ["1.10", "-5.00", "999999999999999999.99", "1.11", None, "1.10"],
    "date": ["2020-01-01", "1970-01-01", "2020-01-02", None, "0001-01-01", "9999-12-31"],
    "timestamp_ntz": ["2020-03-29 02:30:00", "2020-03-29 02:30:00.000001", "1900-01-01 00:00:00", None],
    "string": ["", "a", "a\0", "a\0b", "ab", "ä", "日本", "same prefix one", "same prefix two", "\U0001f600", "z" * 40, "z" * 41, None],
}


def key_of(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


@pytest.mark.parametrize("kind", sorted(TYPES))
@pytest.mark.parametrize("way", ["asc", "desc"])
def test_every_rank_of_every_type(spark, monkeypatch, kind, way):
    monkeypatch.setattr(selection, "FEW_ROWS", 1)
    monkeypatch.setattr(selection, "BINS", 3)
    rng = random.Random(kind)
    rows = [(rng.choice(TYPES[kind]), k) for k in range(40)]
    plain = "string" if kind not in ("double", "float", "bigint", "int") else kind
    df = spark.createDataFrame(rows, f"v {plain}, id int").select(F.col("v").cast(kind).alias("v"), "id").cache()
    order = [("v", way), ("id", "asc")]
    expected = [tuple(r) for r in df.orderBy(*sort_columns(order)).collect()]
    wanted = [0, 1, 7, 13, 20, 26, 33, 38, 39]
    count, found, again = selection.rows_at(df, order, lambda n: [*wanted, n, -1])
    assert count == 40 and not again
    assert {r: key_of(v) for r, v in found.items()} == {r: key_of(expected[r]) for r in wanted}
    df.unpersist()


def test_a_value_of_a_third_of_the_table_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW_ROWS", 10)
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 50).alias("v"), "id")
    expected = [tuple(r) for r in df.orderBy("v", "id").collect()]
    _, found, again = selection.rows_at(df, [("v", "asc"), ("id", "asc")], lambda n: range(0, n, 1000))
    assert found == {r: expected[r] for r in range(0, 9000, 1000)} and not again
    double = df.unionAll(df)
    assert selection.rows_at(double, [("v", "asc"), ("id", "asc")], lambda n: [100])[2]
    assert selection.rows_at(df.limit(0), [("v", "asc")], lambda n: [0]) == (0, {}, False)


def test_no_sort_no_shuffle_of_rows_no_cache(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), "id")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    tiles = ranking.global_ntile(df, [("v", "desc")], "id", 10, "tile")
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_types_without_an_order_are_refused():
    with pytest.raises(TypeError, match="map"):
        selection.comparable(None, "map<int,int>")
