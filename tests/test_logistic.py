"""Newton's logistic regression against its optimality conditions and the library's solver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import churn, logistic
from holdfast.operators.facts import PERSON


def rows(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(int)
    w = rng.uniform(0.5, 2.0, n)
    data = [(int(b), float(c), float(p), float(q)) for b, c, (p, q) in zip(y, w, x)]
    return spark.createDataFrame(data, "y int, w double, a double, b double"), x, y, w


@pytest.mark.parametrize("strength", [1.0, 0.01, 100.0])
def test_gradient_is_zero_at_the_fit(spark, strength):
    df, x, y, w = rows(spark)
    model = logistic.fit(df, ["a", "b"], "y", "w", strength)
    beta = np.array([*model.coefficients, model.intercept])
    full = np.column_stack([x, np.ones(len(x))])
    p = 1 / (1 + np.exp(-full @ beta))
    gradient = full.T @ (w * (p - y)) + np.append(beta[:2] / strength, 0)
    assert np.abs(gradient).max() < 1e-6 and model.last_step < logistic.TOLERANCE
    risk = [r["p"] for r in df.select(logistic.probability(model).alias("p")).collect()]
    assert risk == pytest.approx(p.tolist(), abs=1e-12)


def test_fit_does_not_depend_on_partitions(spark):
    df, *_ = rows(spark)
    one, many = (logistic.fit(df.repartition(n), ["a", "b"], "y", "w") for n in (1, 80))
    assert one.coefficients == pytest.approx(many.coefficients, abs=1e-10)


def test_separable_rows_and_one_class(spark):
    data = [(int(k >= 10), 1.0, float(k - 9.5) * 50) for k in range(20)]
    df = spark.createDataFrame(data, "y int, w double, a double")
    model = logistic.fit(df, ["a"], "y", "w")
    assert 0 < model.coefficients[0] < 10 and model.last_step < 1e-6
    alone = logistic.fit(df.where("y = 1"), ["a"], "y", "w")
    risk = [r[0] for r in df.select(logistic.probability(alone)).collect()]
    assert all(0.9 < p <= 1 for p in risk)


def people(spark, n=300):
    rng = np.random.default_rng(4)
    data = []
    for k in range(n):
        v = [float(x) for x in rng.normal(size=len(churn.LIFETIME) + len(churn.RECENT))]
        late = v[0] + 2 * v[-1] + rng.normal() > 0
        data.append((f"p{k}", ["A", "B", "C"][k % 3], int(late), *v))
    names = ", ".join(f"{c} double" for c in (*churn.LIFETIME, *churn.RECENT))
    extra = ", recency_days int"
    return spark.createDataFrame([(*d, 1) for d in data], f"{PERSON} string, segment_name string, churned int, {names}{extra}")


def test_newton_reaches_the_optimum_of_the_library(spark):
    df = people(spark)
    mine = churn.score_newton(churn.fit_churn_newton(df), df)
    theirs = churn.score_customers(churn.fit_churn(df), df, "other")
    both = mine.select(PERSON, "churn_risk").join(theirs.select(PERSON, "other"), PERSON)
    assert both.agg(F.max(F.abs(F.col("churn_risk") - F.col("other")))).first()[0] < 1e-3


def test_calibration_identity(spark):
    df = people(spark)
    model = churn.fit_churn_newton(df)
    scored = churn.score_newton(model, churn.balanced_weights(df))
    found = {r["segment_name"]: r["modelled"] - r["expected"] for r in logistic.calibration(
        scored, "segment_name", "churned", "_weight", "churn_risk").collect()}
    assert sum(found.values()) == pytest.approx(0, abs=1e-6)
    flags = dict(zip(model.encoder.stages[3].labels, model.logit.coefficients[-3:], strict=True))
    for name, gap in found.items():
        assert gap == pytest.approx(-flags[name], abs=1e-6)


def test_auc_without_recent_activity(spark):
    df = people(spark)
    found = churn.evaluate_churn(df)
    assert 0.5 < found.auc_without < found.auc
    assert churn.score_churn(df)[1] == found.auc
    unseen = df.withColumn("segment_name", F.lit("other"))
    risk = churn.score_newton(churn.fit_churn_newton(df), unseen)
    assert risk.where("churn_risk > 0 and churn_risk < 1").count() == 300
