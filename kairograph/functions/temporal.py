"""Valid time: open and as-of predicates, recency score, formats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def utc(moment: dt.datetime | str) -> Column:
    """A literal timestamp; naive times are UTC."""
    if isinstance(moment, str):
        moment = dt.datetime.fromisoformat(moment)
    if moment.tzinfo is not None:
        moment = moment.astimezone(dt.UTC).replace(tzinfo=None)
    return F.lit(moment.isoformat(" ") + "+00:00").cast("timestamp")


def parse_time(text: Column) -> Column:
    """ISO text with Z, an offset, or a date alone; empty or unreadable text is null."""
    return F.nullif(text, F.lit("")).try_cast("timestamp")


def is_open() -> Column:
    """Never closed: a close in the future closes too."""
    return F.col("valid_until").isNull()


def valid_at(moment: Column) -> Column:
    """Half-open: from valid_from on, before valid_until."""
    return (F.col("valid_from") <= moment) & (F.col("valid_until").isNull() | (F.col("valid_until") > moment))


def age_days(now: Column) -> Column:
    """Elapsed whole days, floored, so -1 for any moment of the day ahead."""
    return F.floor((F.unix_micros(now) - F.unix_micros("valid_from")) / F.lit(float(DAY_MICROS)))


def score(now: Column) -> Column:
    """0 if closed before now, else 1 / (1 + age / 365). Null without valid_from, and at an age of -365 days."""
    fresh = F.try_divide(F.lit(1.0), 1 + age_days(now) / F.lit(365.0))
    return F.when(F.col("valid_until") < now, 0.0).otherwise(fresh)


def iso(moment: Column) -> Column:
    """ISO text, with microseconds only where there are any."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(moment) % 1_000_000 == 0, whole).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def display_date(moment: Column) -> Column:
    return F.substring(iso(moment), 1, 10)
