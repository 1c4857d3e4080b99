"""Small readings of values: bounded numbers, windows and ranges of time, keys and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows of a reader's page (fixed values), in hours; today counts from midnight.
WINDOWS = {"today": None, "last_24h": 24, "last_48h": 48, "last_1w": 168}
#: Most days of a range (fixed value).
MOST_DAYS = 90
#: Bounds of durations in milliseconds (fixed values).
DURATIONS = [(100, "lt_100ms"), (1_000, "lt_1s"), (5_000, "lt_5s"), (30_000, "lt_30s")]


def bounded_number(value: Column, fallback: int, least: int, most: int) -> Column:
    """A text as a whole number, rounded down, within bounds; ``fallback`` for null, blank and what is no number."""
    t = F.trim(value)
    n = F.when(t.rlike(r"^-?[0-9]{1,15}([.][0-9]{1,9})?$"), F.floor(t.try_cast("double")).cast("bigint"))
    return F.when(n.isNull(), F.lit(fallback).cast("bigint")).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), n)).cast("bigint"))


def in_window(at: Column, now: Column, window: str) -> Column:
    hours = WINDOWS[window]
    hit = at >= F.date_trunc("day", now) if hours is None else F.unix_micros(now) - F.unix_micros(at) <= hours * 3_600_000_000
    return F.coalesce(hit, F.lit(False))


def has_tag(tags: Column, chosen: list[str]) -> Column:
    """Whether one of the tags is chosen; without a choice all are."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, chosen))), F.lit(False)) if chosen else F.lit(True)


def clamped_range(since: Column, until: Column, now: Column) -> Column:
    """struct(date_from, date_to, days): not after now, at most MOST_DAYS, a day where it would be empty; without an end
    until now, without a beginning a week."""
    day = F.expr("INTERVAL 1 DAY")
    to = F.least(F.coalesce(until, now), now)
    begin = F.greatest(F.coalesce(since, F.coalesce(until, now) - F.expr("INTERVAL 7 DAY")), to - F.expr(f"INTERVAL {MOST_DAYS} DAY"))
    begin = F.when(begin <= to, begin).otherwise(to - day)
    days = F.greatest(F.lit(1), F.ceil((F.unix_micros(to) - F.unix_micros(begin)) / 86_400_000_000)).cast("bigint")
    return F.struct(begin.alias("date_from"), to.alias("date_to"), days.alias("days"))


def digest_key(user: Column, day: Column) -> Column:
    return F.concat(F.lit("DAILY_DIGEST:"), user.cast("string"), F.lit(":"), F.date_format(day, "yyyy-MM-dd"))


def duration_bucket(ms: Column) -> Column:
    out = F.lit("gte_30s")
    for most, name in reversed(DURATIONS):
        out = F.when(ms < most, name).otherwise(out)
    return out
