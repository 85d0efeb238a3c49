"""K-Means by sums: seeds, steps, silhouettes and their edges against plain numpy."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import clustering, cohorts, segments

COLS = ["a", "b"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "customer_unique_id string, a double, b double")


def blobs(n=40, seed=3):
    rng = random.Random(seed)
    centres = [(-2.0, 0.0), (0.0, 3.0), (2.5, -1.0)]
    return [(f"p{k}_{c}", x + rng.gauss(0, 0.2), y + rng.gauss(0, 0.2)) for c, (x, y) in enumerate(centres) for k in range(n)]


def grid(rows):
    return {key: tuple(math.floor((v or 0.0) * 1e6 + 0.5) for v in values) for key, *values in rows}


def plain_seeds(rows, k, seed):
    points, found = grid(rows), []
    for turn in range(k):
        def speed(key):
            h = int(hashlib.md5(f"{seed}:{turn}:{key}".encode()).hexdigest()[:13], 16)
            far = min((sum((a - b) ** 2 for a, b in zip(points[key], c)) for c in found), default=1.0)
            return (far / -math.log((h + 0.5) / 2**52), key)

        best = max(points, key=speed)
        if speed(best)[0] <= 0:
            break
        found.append(points[best])
    return found


def test_seeds_are_the_winners_of_the_race(spark):
    rows = blobs()
    points = frame(spark, rows).select("customer_unique_id", *[clustering.on_grid(c).alias(c) for c in COLS])
    found = clustering.seeds(points, COLS, 5, 42, "customer_unique_id")
    assert found == plain_seeds(rows, 5, 42)
    assert clustering.seeds(points, COLS, 3, 42, "customer_unique_id") == found[:3]


def test_steps_end_at_cluster_means_and_do_not_depend_on_partitions(spark):
    rows = blobs()
    fits = [
        clustering.fit(frame(spark, rows).repartition(n), COLS, [3], 1, "customer_unique_id")[0][3] for n in (1, 3, 90)
    ]
    assert fits[0] == fits[1] == fits[2]
    points = grid(rows)
    groups = {}
    for key, p in points.items():
        groups.setdefault(key.split("_")[1], []).append(p)
    means = sorted(tuple(np.mean(g, axis=0)) for g in groups.values())
    for mine, theirs in zip(sorted(fits[0].values), means, strict=True):
        assert mine == pytest.approx(theirs, rel=1e-9)


def test_silhouettes_equal_those_over_all_pairs(spark):
    rows = blobs(12) + [("far", 50.0, 50.0)]
    made, scores = clustering.fit(frame(spark, rows), COLS, [2, 3, 4], 42, "customer_unique_id", scores=True)
    x = np.array([p for p in grid(rows).values()]) / 1e6
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    for k, centres in made.items():
        label = ((x[:, None] * 1e6 - np.array(centres.values)[None]) ** 2).sum(-1).argmin(1)
        total = 0.0
        for i in range(len(x)):
            mine = label == label[i]
            if mine.sum() > 1:
                a = apart[i][mine].sum() / (mine.sum() - 1)
                b = min(apart[i][label == j].mean() for j in set(label) - {label[i]})
                total += (b - a) / max(a, b)
        assert scores[k] == pytest.approx(total / len(x), abs=1e-9)


def test_edges(spark):
    made, scores = clustering.fit(frame(spark, []), COLS, [2], 42, "customer_unique_id", scores=True)
    assert made[2].values == () and scores == {}
    assert clustering.nearest(frame(spark, [("x", 1.0, 1.0)]), made[2]).first()["segment"] is None
    same = [(f"p{k}", 1.0, 1.0) for k in range(9)]
    made, scores = clustering.fit(frame(spark, same), COLS, [2], 42, "customer_unique_id", scores=True)
    assert len(made[2].values) == 1 and scores == {2: 0.0}
    gaps = frame(spark, [("x", None, 0.0), ("y", 0.0, 9.0), ("z", 0.1, None)])
    made, _ = clustering.fit(gaps, COLS, [2], 42, "customer_unique_id")
    labels = {r["customer_unique_id"]: r["segment"] for r in clustering.nearest(gaps, made[2]).collect()}
    assert labels["x"] == labels["z"] != labels["y"]


def test_equally_near_centres_take_the_lower_number(spark):
    centres = clustering.Centres(("a", "b"), ((-1e6, 0.0), (1e6, 0.0), (-1e6, 0.0)))
    row = clustering.nearest(frame(spark, [("x", 0.0, 0.0)]), centres).first()
    assert row["segment"] == 0


def test_segments_do_not_keep_a_cache(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = [(f"c{k}", k % 90, 1 + k % 4, "10.00", "5.00", "1.00", "1.00", k % 50, None) for k in range(60)]
    df = spark.createDataFrame(
        rows,
        "customer_unique_id string, recency_days int, frequency long, monetary string, avg_order_value string, "
        "avg_items_per_order string, avg_category_diversity string, tenure_days int, avg_days_between_orders string",
    )
    assigned, profile = segments.segment_customers(df)
    assert assigned.count() == 60 and profile.agg(F.sum("customers")).first()[0] == 60
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_heatmap_cells_keep_unobserved_months(spark):
    kept = spark.createDataFrame(
        [("2020-01-01", 0, "1.0"), ("2020-01-01", 2, "0.5"), ("2020-02-01", 0, "1.0")], "m string, month_index int, r string"
    ).select(F.to_date("m").alias("cohort_month"), "month_index", F.col("r").cast("decimal(10,4)").alias("retention_rate"))
    cells = cohorts.heatmap_cells(cohorts.cohort_heatmap(kept)).collect()
    assert sorted((str(r[0]), r[1], None if r[2] is None else float(r[2])) for r in cells) == [
        ("2020-01-01", 0, 1.0), ("2020-01-01", 2, 0.5), ("2020-02-01", 0, 1.0), ("2020-02-01", 2, None)
    ]
    assert cohorts.heatmap_cells(cohorts.cohort_heatmap(kept.limit(0))).count() == 0


def test_steps_have_tasks_by_rows_not_by_partitions(spark):
    group = "clustering-tasks"
    df = frame(spark, blobs()).repartition(60).cache()
    df.count()
    spark.sparkContext.setJobGroup(group, "tasks of a fit")
    try:
        made, scores = clustering.fit(df, COLS, [2, 3], 42, "customer_unique_id", scores=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        df.unpersist()
    assert len(made[3].values) == 3 and scores[3] > scores[2]
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    tasks = [tracker.getStageInfo(s).numCompletedTasks for s in stages]
    assert sum(n for n in tasks if n >= 60) <= 120, tasks  # the rows are laid out once
