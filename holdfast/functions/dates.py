"""Date and time expressions.

Purchase times carry no zone (``timestamp_ntz``).  Differences are taken as
intervals, which never look at the session zone, so a daylight-saving session
zone cannot move a day boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar text formats, and the blank-padded width of full names.
MONTH_SHORT, MONTH_FULL = "MMM", "MMMM"
DAY_SHORT, DAY_FULL = "EEE", "EEEE"
PADDED_WIDTH = 9


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed days cut towards zero: 47 hours is 1 day, whatever the dates say."""
    return F.extract(F.lit("DAY"), later - earlier).cast("int")


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    """Elapsed seconds, exact to the microsecond."""
    return (later - earlier).cast("interval second").cast("decimal(18,6)")


def days_before(ts: Column, days: int) -> Column:
    return ts - F.expr(f"INTERVAL '{int(days)}' DAY")


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def months_between_starts(month: Column, base: Column) -> Column:
    """Calendar months from ``base`` to ``month``; December to January is 1."""
    return (F.year(month) - F.year(base)) * 12 + (F.month(month) - F.month(base))


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "QUARTER")


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(quarter_start(day), 2))


def full_name(day: Column, pattern: str, padded: bool) -> Column:
    name = F.date_format(day, pattern)
    return F.rpad(name, PADDED_WIDTH, " ") if padded else name


def fiscal_month(day: Column, first_month: int = 4) -> Column:
    """1 in the month the fiscal year starts, 12 in the month before it."""
    return (F.month(day) + (12 - first_month)) % 12 + 1


def fiscal_year_start(day: Column, first_month: int = 4) -> Column:
    """Calendar year in which the day's fiscal year began."""
    return F.year(F.add_months(day, 1 - first_month))


def fiscal_quarter(day: Column, first_month: int = 4) -> Column:
    return F.ceil(fiscal_month(day, first_month) / 3).cast("int")


def fiscal_label(day: Column, first_month: int = 4) -> Column:
    """``FY2017/18`` for a fiscal year that spans 2017 and 2018."""
    begin = fiscal_year_start(day, first_month)
    return F.concat(
        F.lit("FY"), begin.cast("string"), F.lit("/"), F.right((begin + 1).cast("string"), F.lit(2))
    )
