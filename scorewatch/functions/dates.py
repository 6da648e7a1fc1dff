"""Dates, periods, ages and elapsed time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def week_start(date: Column) -> Column:
    return F.to_date(F.date_trunc("week", date))


def month_start(date: Column) -> Column:
    return F.to_date(F.date_trunc("month", date))


def week_number(date: Column) -> Column:
    """Week of the year counted from its first Monday; days before it are week 0."""
    return F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / F.lit(7.0)).cast("int")


def period_end(start: Column, period: Column) -> Column:
    return F.when(period == "Week", F.date_add(start, 6)).when(period == "Month", F.last_day(start))


def split_by_windows(
    date: Column, windows: Sequence[tuple[str, str | None, str | None]], otherwise: str
) -> Column:
    """Name of the first `(name, from, to)` window holding the date, ends included."""
    chain = None
    for name, start, end in windows:
        test = F.lit(True)
        if start is not None:
            test = test & (date >= F.lit(start).cast("date"))
        if end is not None:
            test = test & (date <= F.lit(end).cast("date"))
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(F.lit(otherwise))


def application_time(
    loan_type: Column, started: Column, accepted: Column, scored: Column | None = None
) -> Column:
    """Start of the application for Flex-up loans, acceptance of terms for the others."""
    time = F.when(loan_type == "Flex-up", started).otherwise(accepted)
    return time if scored is None else F.coalesce(time, scored)


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Minutes between two instants, four decimals."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(micros / F.lit(60_000_000.0), 4)


def local_date(instant: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def months_started(start: Column, end: Column) -> Column:
    """Month boundaries crossed between two dates."""
    def index(d: Column) -> Column:
        return F.year(d) * 12 + F.month(d)

    return index(end) - index(start)


def full_years(birth: Column, on: Column) -> Column:
    """Age in completed years."""
    had_birthday = (F.month(birth) * 100 + F.day(birth)) <= (F.month(on) * 100 + F.day(on))
    return F.year(on) - F.year(birth) - F.when(had_birthday, 0).otherwise(1)
