"""Date column helpers; the reference date is always an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats in the order they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")
#: Event time formats in the order they are tried.
EVENT_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyyMMdd_HHmmss",
)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def parse_first(text, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Timestamp of the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(_c(text)), F.lit(f)) for f in formats])


def parse_event_time(text) -> Column:
    """The event formats, then seconds since 1970."""
    return F.coalesce(parse_first(text, EVENT_FORMATS), F.timestamp_seconds(_c(text).try_cast("double")))


def month_key(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def quarter_key(d) -> Column:
    return F.concat(F.lit("Q"), F.quarter(_c(d)), F.lit(" "), F.year(_c(d)))


def iso_week_key(d) -> Column:
    day = F.to_date(_c(d))
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def sunday_week(d) -> Column:
    """Week of the year with Sunday first, 0 before the first Sunday."""
    day = F.to_date(_c(d))
    return F.floor((F.dayofyear(day) + 6 - (F.dayofweek(day) - 1)) / 7).cast("int")


def days_until(d, as_of: str) -> Column:
    return F.greatest(F.datediff(F.to_date(_c(d)), F.lit(as_of).cast("date")), F.lit(0))


def age_in_months(born, as_of: str) -> Column:
    """Calendar months between; the day of the month is not looked at."""
    day, ref = F.to_date(_c(born)), F.lit(as_of).cast("date")
    return (F.year(ref) - F.year(day)) * 12 + F.month(ref) - F.month(day)


def off_hours(ts, start: int = 22, end: int = 6) -> Column:
    hour = F.hour(_c(ts))
    return (hour < end) | (hour >= start)


def duration_seconds(text) -> Column:
    """``5m`` or ``1h`` to seconds; 0 for anything else."""
    c = _c(text)
    value = F.regexp_extract(c, r"^(\d+)([smhd])", 1).try_cast("long")
    unit = F.regexp_extract(c, r"^(\d+)([smhd])", 2)
    scale = F.create_map(*[F.lit(x) for kv in (("s", 1), ("m", 60), ("h", 3600), ("d", 86400)) for x in kv])
    return F.coalesce(value * scale[unit], F.lit(0)).cast("long")
