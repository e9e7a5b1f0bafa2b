"""Times and period keys. The session's time zone should be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text (with Z or an offset) as a timestamp; null if it cannot be read."""
    return F.try_to_timestamp(text)


def iso_week_key(ts: Column) -> Column:
    """YYYY-Www by the ISO year, which differs from the calendar year around New Year."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def period_to_date(period: Column) -> Column:
    """First day of a period: the Monday of YYYY-Www, the day of YYYY-MM-DD; null for anything else."""
    year, week = F.regexp_extract(period, r"^(\d{4})-W(\d{2})$", 1), F.regexp_extract(period, r"^(\d{4})-W(\d{2})$", 2)
    monday = F.date_add(F.trunc(F.make_date(year.cast("int"), F.lit(1), F.lit(4)), "week"), (week.cast("int") - 1) * 7)
    day = F.when(period.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(period, "yyyy-MM-dd"))
    return F.when(period.rlike(r"^\d{4}-W\d{2}$"), monday).otherwise(day)


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end as a double; negative if end comes first."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMMM yyyy")


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "MMMM dd, yyyy")


def inclusive_end(exclusive_end: Column) -> Column:
    return F.date_sub(exclusive_end, 1)
