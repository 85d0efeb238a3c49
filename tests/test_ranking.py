import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.operators import ranking
from holdfast.operators.ranking import (
    exact_median,
    global_ntile,
    mode_row,
    quantile_bins,
    quantile_edges,
    rows_at_ranks,
    tile_starts,
    top_n,
)
from tests.helpers import as_dict

FEW = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def ntile(count, n):
    base, extra = divmod(count, n)
    sizes = [base + (t < extra) for t in range(n)]
    return [t + 1 for t, size in enumerate(sizes) for _ in range(size)]


@pytest.mark.parametrize("count,n", [(0, 3), (1, 3), (2, 3), (3, 3), (10, 3), (11, 3), (9, 10), (100, 7)])
def test_tile_starts(count, n):
    tiles = ntile(count, n)
    assert [s for s in tile_starts(count, n) if s < count] == [
        i for i in range(1, count) if tiles[i] != tiles[i - 1]
    ]


@FEW
@given(
    scores=st.lists(st.one_of(st.none(), st.integers(0, 4), st.floats(-2, 2)), min_size=1, max_size=60),
    n=st.integers(1, 8),
    way=st.sampled_from(["asc", "desc"]),
)
def test_global_ntile_against_brute_force(spark, scores, n, way):
    rows = [(i, None if s is None else float(s)) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "key int, score double")
    got = as_dict(global_ntile(df, [("score", way)], "key", n, "tile"), "key", "tile")
    nulls = [r for r in rows if r[1] is None]
    valued = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1] if way == "asc" else -r[1], r[0]))
    ordered = nulls + valued if way == "desc" else valued + nulls
    assert got == {key: tile for (key, _), tile in zip(ordered, ntile(len(rows), n), strict=True)}


def test_global_ntile_equals_the_built_in_on_tied_text_keys(spark):
    df = spark.range(5000).select(
        F.concat(F.lit("k"), F.col("id")).alias("key"),
        F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise((F.col("id") % 17).cast("double")).alias("score"),
    )
    mine = global_ntile(df, [("score", "desc")], "key", 7, "tile")
    df.createOrReplaceTempView("scored_keys")
    theirs = df.sparkSession.sql(
        "SELECT key, ntile(7) OVER (ORDER BY score DESC, key) AS tile FROM scored_keys"
    )
    assert as_dict(mine, "key", "tile") == as_dict(theirs, "key", "tile")


def test_global_ntile_on_nothing(spark):
    df = spark.createDataFrame([], "key int, score double")
    assert global_ntile(df, [("score", "desc")], "key", 3, "tile").collect() == []


@FEW
@given(
    values=st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 3)), min_size=2, max_size=80),
    q=st.integers(2, 10),
)
def test_quantile_edges_against_numpy(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    edges = quantile_edges(df, "v", [(k, q) for k in range(q + 1)])
    expected = np.quantile(values, [k / q for k in range(q + 1)])
    assert edges == pytest.approx(list(expected), rel=1e-9, abs=1e-9)


@FEW
@given(values=st.lists(st.integers(-10**6, 10**6), min_size=10, max_size=80, unique=True))
def test_quantile_bins_against_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = as_dict(quantile_bins(df, "v", 4, "bin"), "v", "bin")
    expected = pd.qcut(pd.Series(values), 4, labels=False)
    assert got == dict(zip(values, expected.tolist(), strict=True))


def test_value_on_an_edge_goes_down_and_null_gets_no_bin(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 2, 3, 4, None]], "v int")
    got = {row["v"]: row["bin"] for row in quantile_bins(df, "v", 2, "bin").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, None: None}


def test_equal_edges_raise_or_merge(spark):
    df = spark.createDataFrame([(v,) for v in [0] * 8 + [1, 2]], "v int")
    with pytest.raises(ValueError, match="not unique"):
        quantile_bins(df, "v", 4, "bin")
    merged = quantile_bins(df, "v", 4, "bin", duplicates="drop")
    expected = pd.qcut(pd.Series([0] * 8 + [1, 2]), 4, labels=False, duplicates="drop")
    assert sorted(r["bin"] for r in merged.collect()) == sorted(expected)
    with pytest.raises(ValueError, match="duplicates"):
        quantile_bins(df, "v", 4, "bin", duplicates="ignore")


def test_bins_of_a_column_without_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert [r["bin"] for r in quantile_bins(df, "v", 3, "bin").collect()] == [None]


def test_rows_at_ranks_counts_equal_rows_together(spark):
    df = spark.createDataFrame([(v,) for v in ["b"] * 50 + ["a"] * 3 + ["c"]], "v string")
    count, rows = rows_at_ranks(df, [("v", "asc")], lambda n: [0, 2, 3, n - 2, n - 1, n, -1])
    assert count == 54
    assert {rank: row["v"] for rank, row in rows.items()} == {0: "a", 2: "a", 3: "b", 52: "b", 53: "c"}


def test_rows_at_ranks_leaves_nothing_cached(spark):
    df = spark.createDataFrame([(v,) for v in range(20)], "v int")
    rows_at_ranks(df, [("v", "asc")], lambda n: [3])
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_median_of_even_odd_and_no_values(spark):
    odd = spark.createDataFrame([(v,) for v in [5.0, 1.0, 3.0, None]], "v double")
    even = spark.createDataFrame([(v,) for v in [5.0, 1.0, 3.0, 4.0]], "v double")
    assert exact_median(odd, "v") == 3.0
    assert exact_median(even, "v") == 3.5
    assert exact_median(odd.where("v < 0"), "v") is None


def test_mode_row_ties_and_nulls(spark):
    rows = [
        (1, "x", "s", 9), (1, "x", "s", 9), (1, "a", "s", 1),
        (2, "b", "t", 5), (2, "a", "z", 5),
        (3, "a", "t", 8), (3, "a", "t", 2),
        (4, None, "t", 1), (4, "z", "t", 1),
        (5, None, None, None),
    ]
    df = spark.createDataFrame(rows, "key int, city string, state string, zip int")
    got = as_dict(mode_row(df, ["key"], ["city", "state", "zip"]), "key", "city", "state", "zip")
    assert got == {
        1: ("x", "s", 9),
        2: ("a", "z", 5),
        3: ("a", "t", 2),
        4: ("z", "t", 1),
        5: (None, None, None),
    }


def test_top_n_puts_missing_values_first_when_descending(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, 5.0)], "key int, v double")
    picked = top_n(df, [("v", "desc"), ("key", "asc")], 3)
    assert [r["key"] for r in picked.collect()] == [2, 3, 4]
    picked = top_n(df, [("v", "asc"), ("key", "asc")], 4)
    assert [r["key"] for r in picked.collect()] == [1, 3, 4, 2]
    picked = top_n(df, [("v", "desc")], 9, F.col("key") == 1)
    assert [r["key"] for r in picked.collect()] == [1]


def test_boundary_literals_keep_date_and_text_types(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2020-01-01 00:00:00.000001' + make_dt_interval(id % 5) AS t, "
        "date'2020-01-01' + CAST(id AS INT) AS d, decode(unhex(hex(id)), 'UTF-8') AS s, id FROM range(40)"
    )
    for column in ("t", "d", "s"):
        tiles = global_ntile(df, [(column, "desc")], "id", 4, "tile")
        counts = {r["tile"]: r["count"] for r in tiles.groupBy("tile").count().collect()}
        assert counts == {1: 10, 2: 10, 3: 10, 4: 10}
    assert not math.isnan(ranking.exact_median(df, "id"))


def test_a_key_that_repeats_at_a_cut_is_an_error(spark):
    df = spark.createDataFrame([(1, 1)] * 10, "score int, key int")
    with pytest.raises(ValueError, match="tell the rows apart"):
        global_ntile(df, [("score", "asc")], "key", 3, "tile")
    keyed = spark.createDataFrame([(1, k) for k in range(10)], "score int, key int")
    tiles = global_ntile(keyed, [("score", "asc")], "key", 3, "tile").groupBy("tile").count().collect()
    assert {r["tile"]: r["count"] for r in tiles} == {1: 4, 2: 3, 3: 3}


def test_nan_has_no_bin_and_no_say_in_the_edges(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    got = {str(r["v"]): r["bin"] for r in quantile_bins(df, "v", 3, "bin").collect()}
    assert got == {"1.0": 0, "2.0": 1, "3.0": 2, "nan": None, "None": None}


def test_zoned_times_are_cut_at_the_same_instant(spark):
    df = spark.sql("SELECT timestamp'2020-03-29 00:00:00' + make_dt_interval(0, id) AS t, id FROM range(40)")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        tiles = global_ntile(df, [("t", "asc")], "id", 4, "tile")
        assert {r["tile"]: r["count"] for r in tiles.groupBy("tile").count().collect()} == dict.fromkeys((1, 2, 3, 4), 10)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ranges_are_narrowed_more_than_once(spark, monkeypatch):
    """With a coarse sketch and a low limit every step has to narrow again."""
    monkeypatch.setattr(ranking, "GRID", 16)
    monkeypatch.setattr(ranking, "FEW_VALUES", 10)
    values = [float((k * 7919) % 5003) for k in range(5003)] + [1234.0] * 3000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    points = [(0, 10), (1, 10), (1, 3), (1, 2), (9, 10), (10, 10)]
    edges = quantile_edges(df, "v", points)
    assert edges == pytest.approx(list(np.quantile(values, [a / b for a, b in points])))


def test_medians_of_several_columns_at_once(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, None, None), (9, 1.0, None)], "a int, b double, c double")
    assert ranking.exact_medians(df, ["a", "b", "c"]) == {"a": 2.0, "b": 3.0, "c": None}
