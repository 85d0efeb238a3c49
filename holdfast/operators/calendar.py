"""Date dimension with ISO and fiscal attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import dates as D
from holdfast.operators.facts import WHEN


def dim_date(
    df: DataFrame, ts: str = WHEN, fiscal_start_month: int = 4, pg_padding: bool = False
) -> DataFrame:
    """One row per day from the first to the last timestamp of ``df``.

    ``pg_padding`` pads full month and day names with blanks to nine characters.
    """
    bounds = df.agg(
        F.min(ts).cast("date").alias("_first"), F.max(ts).cast("date").alias("_last")
    )
    days = bounds.where(F.col("_first").isNotNull()).select(
        F.explode(F.sequence("_first", "_last")).alias("date")
    )
    day = F.col("date")
    columns = {
        "date": day,
        "year": F.year(day),
        "month": F.month(day),
        "month_name_short": F.date_format(day, D.MONTH_SHORT),
        "month_name": D.full_name(day, D.MONTH_FULL, pg_padding),
        "month_start": F.trunc(day, "MM"),
        "month_end": F.last_day(day),
        "quarter": F.quarter(day),
        "quarter_start": D.quarter_start(day),
        "quarter_end": D.quarter_end(day),
        "iso_day_of_week": F.extract(F.lit("DAYOFWEEK_ISO"), day),
        "day_name_short": F.date_format(day, D.DAY_SHORT),
        "day_name": D.full_name(day, D.DAY_FULL, pg_padding),
        "day_of_month": F.dayofmonth(day),
        "week_of_year": F.weekofyear(day),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), day),
        "fiscal_year_start": D.fiscal_year_start(day, fiscal_start_month),
        "fiscal_year_label": D.fiscal_label(day, fiscal_start_month),
        "fiscal_month": D.fiscal_month(day, fiscal_start_month),
        "fiscal_quarter": D.fiscal_quarter(day, fiscal_start_month),
        "is_month_start": F.dayofmonth(day) == 1,
        "is_month_end": day == F.last_day(day),
    }
    return days.select(*[column.alias(name) for name, column in columns.items()])


def calendar_bounds(calendar: DataFrame) -> DataFrame:
    """Number of days, first and last day of a date dimension."""
    return calendar.agg(
        F.count(F.lit(1)).alias("total_dates"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )
