"""L2 logistic regression by Newton steps from partition-summed gradients and Hessians.

Each task adds up the loss, the gradient and the Hessian of its rows in numpy; their sums, a
few hundred numbers whatever the table, are solved on the driver.  The problem is convex, so a
handful of passes ends at the optimum itself (the last step is under ``TOLERANCE``), which any
other solver must reach too.  A step that would raise the loss is halved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10
MOST_STEPS = 50
BATCH_ROWS = 8192
# With at most so many tasks their sums go to the driver as they are.
DIRECT_PARTITIONS = 64


@dataclass(frozen=True)
class Logit:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    last_step: float  # the largest change of the last Newton step


def sums(
    rows: DataFrame, features: Sequence[str], label: str, weight: str, beta: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log loss, its gradient and Hessian at ``beta`` (the intercept last)."""
    width = len(features) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                x = np.stack([*columns[2:], np.ones(part.num_rows)], axis=1)
                y, w = columns[0], columns[1]
                z = x @ beta
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                total[0] += (w * (np.logaddexp(0.0, z) - y * z)).sum()
                total[1 : 1 + width] += x.T @ (w * (p - y))
                total[1 + width :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"]
        )

    plain = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate((label, weight, *features))])
    parts = plain.mapInArrow(run, "place bigint, value double")
    if rows.rdd.getNumPartitions() > DIRECT_PARTITIONS:
        parts = parts.groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(1 + width + width * width)
    for row in parts.collect():
        total[row["place"]] += row["value"]
    return float(total[0]), total[1 : 1 + width], total[1 + width :].reshape(width, width)


def fit(
    rows: DataFrame, features: Sequence[str], label: str, weight: str, strength: float = 1.0, steps: int = MOST_STEPS
) -> Logit:
    """Minimises the summed loss plus half the squared coefficients over ``strength``.

    The intercept is free.  ``rows`` is read once per step, so callers keep it.
    """
    width = len(features) + 1
    penalty = np.append(np.full(width - 1, 1.0 / strength), 0.0)
    beta, step, least = np.zeros(width), np.zeros(width), np.inf
    for _ in range(steps):
        loss, gradient, hessian = sums(rows, features, label, weight, beta)
        loss += 0.5 * float((penalty * beta**2).sum())
        if loss > least + 1e-9 * abs(least):
            step = step / 2
            beta = beta - step
            continue
        least = loss
        step = np.linalg.lstsq(hessian + np.diag(penalty), -(gradient + penalty * beta), rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < TOLERANCE:
            break
    return Logit(tuple(features), tuple(beta[:-1].tolist()), float(beta[-1]), float(np.abs(step).max()))


def probability(model: Logit) -> Column:
    """The modelled probability as a plain expression over the feature columns."""
    score = reduce(
        add, [F.lit(b) * F.col(name).cast("double") for b, name in zip(model.coefficients, model.features, strict=True)], F.lit(model.intercept)
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def calibration(scored: DataFrame, by: str, label: str, weight: str, risk: str) -> DataFrame:
    """Weighted labels and probabilities per group of the training rows.

    At the optimum the totals of all rows are equal, and those of a group that has a flag
    among the features differ by the group's coefficient over the strength.
    """
    w = F.col(weight)
    return scored.groupBy(by).agg(
        F.sum(w * F.col(label)).alias("expected"), F.sum(w * F.col(risk)).alias("modelled")
    )
