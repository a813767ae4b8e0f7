"""Time columns. Instants are TIMESTAMP under a UTC session; Eastern wall-clock time is derived only where needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "US/Eastern"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def eastern(t: Column | str) -> Column:
    """Eastern wall-clock time of an instant, daylight saving included."""
    return F.from_utc_timestamp(_col(t), EASTERN)


def parse_utc(text: Column | str) -> Column:
    """ISO time text, a trailing Z optional, read as UTC; bad text is an error."""
    return F.to_timestamp(F.rtrim(_col(text), F.lit("Z")))


def parse_utc_strict(text: Column | str) -> Column:
    """Exactly ``YYYY-MM-DDTHH:MM:SSZ``; anything else is an error."""
    return F.to_timestamp(_col(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_eastern(t: Column | str) -> Column:
    """ISO text of the Eastern time with its offset, such as 2024-01-02T09:30:00-05:00."""
    instant = _col(t)
    wall = eastern(instant)
    minutes = ((F.unix_seconds(wall) - F.unix_seconds(instant)) / 60).cast("int")
    size = F.abs(minutes)
    offset = F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def floor_minute(t: Column | str) -> Column:
    return F.date_trunc("minute", _col(t))


def upper_symbol(symbol: Column | str) -> Column:
    return F.upper(_col(symbol))


def in_range(t: Column | str, start, end) -> Column:
    """Both bounds included, as in the request parameters of bars and news."""
    value = _col(t)
    return (value >= F.lit(start).cast("timestamp")) & (value <= F.lit(end).cast("timestamp"))
