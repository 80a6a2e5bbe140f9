"""Time helpers on timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_FIRST = r"^\d{1,2}/\d{1,2}/\d{4}$"


def parse_time(text: Column) -> Column:
    """ISO text or ``M/d/yyyy`` (with or without leading zeros) to a timestamp without zone; else null.

    No text ends the job: day-first dates and other impossible ones are null as well.
    """
    month, day, year = (F.element_at(F.split(text, "/"), i).try_cast("int") for i in (1, 2, 3))
    zero, second = F.lit(0), F.lit(0).cast("decimal(16,6)")
    month_first = F.try_make_timestamp_ntz(year, month, day, zero, zero, second)
    return F.when(text.rlike(MONTH_FIRST), month_first).otherwise(text.try_cast("timestamp_ntz"))


def unreadable(text: Column) -> Column:
    """Text that states a time which :func:`parse_time` cannot read; null and blank text state none."""
    return text.isNotNull() & (F.trim(text) != "") & parse_time(text).isNull()


def at(text: str) -> Column:
    """A fixed time; it folds to a literal, so comparisons with it reach the scan."""
    return parse_time(F.lit(text))


def minute_number(ts: Column) -> Column:
    """Minutes since 1970 on the clock the timestamp was written in.

    Built from date, hour and minute, so a timestamp without zone is never moved through a session zone
    and the numbers rise with the timestamps.
    """
    day = F.unix_date(F.to_date(ts)).cast("long")
    return day * 1440 + F.hour(ts) * 60 + F.minute(ts)
