"""Trading calendar look-ups. The calendar is a table ``session_date``; today is a parameter."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_DAY = date(2000, 1, 1)


def _nth_from_last(sessions: DataFrame, n: int, name: str) -> DataFrame:
    latest = sessions.orderBy(F.col("session_date").desc()).limit(n)
    short = F.raise_error(F.concat(F.lit(f"fewer than {n} sessions: "), F.count("*").cast("string"))).cast("date")
    return latest.agg(F.when(F.count("*") >= n, F.min("session_date")).otherwise(short).alias(name))


def nth_last_session(calendar: DataFrame, n: int, today: date) -> DataFrame:
    """The n-th last session up to today."""
    known = calendar.filter(F.col("session_date").between(F.lit(FIRST_DAY), F.lit(today)))
    return _nth_from_last(known, n, "session_date")


def session_before_days(calendar: DataFrame, n: int, today: date) -> DataFrame:
    """The n-th last session among those of the last 2n calendar days; fewer than n is an error."""
    recent = calendar.filter(F.col("session_date").between(F.lit(today - timedelta(days=2 * n)), F.lit(today)))
    return _nth_from_last(recent, n, "session_date")


def news_window(calendar: DataFrame, n: int, today: date) -> tuple[DataFrame, DataFrame]:
    """First and last day of the listing's request window, one row each: the session 2n back and the last one."""
    return session_before_days(calendar, 2 * n, today), session_before_days(calendar, 1, today)


def series_window(calendar: DataFrame, n: int, today: date) -> DataFrame:
    """First day of the sentiment series' request window, which ends now."""
    return session_before_days(calendar, n, today)


def within_sessions(df: DataFrame, day: Column, first: DataFrame, last: DataFrame) -> DataFrame:
    """Rows whose day lies between two one-row look-ups, which Spark runs first as scalar subqueries."""
    return df.filter(day.between(first.scalar(), last.scalar()))
