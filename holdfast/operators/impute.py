"""Preparation shared by the two models: missing values and the layout of training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import lenient_double
from holdfast.operators.ranking import exact_medians

# Tasks of an iterative fit, unless the caller names another number.
FIT_PARTITIONS = 16


def laid_out(df: DataFrame, key: str, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """Rows dealt by a hash of ``key`` over a fixed number of partitions, each sorted by it.

    Solvers draw their starting points by partition, so a layout that depends only on
    the rows makes the same rows and seed give the same fit.  The number is an
    argument, never taken from the size of the data.
    """
    return df.repartition(partitions, key).sortWithinPartitions(key)


def as_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as double; what does not read as a number, and NaN, becomes NULL."""
    numbers = {name: lenient_double(F.col(name)) for name in cols}
    return df.withColumns({name: F.nullif(col, F.lit(float("nan"))) for name, col in numbers.items()})


def fill_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs replaced by the column's exact median.

    One pass counts the gaps; the medians of the columns that have some are read together.
    A column without any value stays NULL.
    """
    gaps = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in cols]).first()
    medians = exact_medians(df, [name for name in cols if gaps[name]])
    known = {name: value for name, value in medians.items() if value is not None}
    return df.na.fill(known) if known else df
