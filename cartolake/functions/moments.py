"""Times of day, decay, opening hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def daypart(ts: Column) -> Column:
    """The hours at which parts of the day begin."""
    h = F.hour(ts)
    return F.when(h.between(5, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 21), "evening").otherwise("night")


def daytype(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday")


def decay(weight: Column, ts: Column, now: str, days: float = 45.0) -> Column:
    """weight * exp(-age / days); times after `now` don't gain."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000.0)
    return weight * F.exp(-age / days)


def floor_to(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def minutes_of(clock: Column) -> Column:
    """'9:30 am' or '17:00' in minutes; null if it can't be read."""
    h, m, half = (F.regexp_extract(F.lower(clock), r"^\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*$", k) for k in (1, 2, 3))
    hour = F.when(half == "pm", h.try_cast("int") % 12 + 12).when(half == "am", h.try_cast("int") % 12).otherwise(h.try_cast("int"))
    return hour * 60 + F.coalesce(m.try_cast("int"), F.lit(0))


def open_at(hours: Column, minute: Column) -> Column:
    """'9:00 am - 5 pm' at a minute of the day, ranges past midnight included; 'open 24 hours' always, 'closed' never, unreadable counts as open."""
    text = F.lower(F.trim(hours))
    a, b = minutes_of(F.split_part(text, F.lit("-"), F.lit(1))), minutes_of(F.split_part(text, F.lit("-"), F.lit(2)))
    inside = F.when(a <= b, (minute >= a) & (minute < b)).otherwise((minute >= a) | (minute < b))
    return F.when(text.isNull() | F.contains(text, F.lit("24 hours")), True).when(text == "closed", False).otherwise(F.coalesce(inside, F.lit(True)))
