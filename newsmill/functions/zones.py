"""Zone-offset intervals in local time, for joining wall times to offsets."""

from __future__ import annotations

import datetime as dt
import functools
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UTC = dt.timezone.utc
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=_UTC)
_WEEK = 7 * 86_400
#: Years whose intervals are kept.  Before them zones have their local mean time; after them rules don't change any more, so
#: that a later year has the intervals of the year with the same calendar among the last 28.
FIRST_YEAR, LAST_YEAR = 1840, 2128

#: Offsets in minutes of zone letters (fixed values), where no country says otherwise.
ZONE_LETTERS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "BST": 60, "IST": 330, "JST": 540, "KST": 540,
    "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720,
    "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150,
    "BRT": -180, "BRST": -120, "ART": -180, "SAST": 120, "PKT": 300,
}

#: The same letters where a country means another offset by them (fixed values).
ZONE_LETTERS_BY_COUNTRY = {
    ("IST", "IE"): 60, ("IST", "IL"): 120, ("BST", "BD"): 360, ("CST", "CN"): 480, ("CST", "TW"): 480,
    ("CST", "CU"): -300, ("CDT", "CU"): -240, ("EST", "AU"): 600, ("EDT", "AU"): 660, ("CST", "AU"): 570,
    ("CDT", "AU"): 630, ("WST", "AU"): 480, ("AST", "SA"): 180, ("PST", "PH"): 480,
}


def _secs(t: dt.datetime) -> int:
    return int((t - _EPOCH).total_seconds())


def _offset(zone: ZoneInfo, s: int) -> int:
    return int((_EPOCH + dt.timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())


@functools.lru_cache(maxsize=None)
def zone_intervals(name: str, first_year: int, last_year: int) -> list[tuple[int, int, int]]:
    """(utc_from, utc_to, offset) in seconds, in order, over the years named; changes of the clock are found by
    bisection between moments a week apart that differ in offset."""
    zone = ZoneInfo(name)
    lo, hi = (_secs(dt.datetime(y, 1, 1, tzinfo=_UTC)) for y in (first_year, last_year + 1))
    out, start, off = [], lo, _offset(zone, lo)
    for at in range(lo, hi, _WEEK):
        end = min(at + _WEEK, hi)
        if _offset(zone, end) == off:
            continue
        a, b = at, end
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if _offset(zone, mid) == off else (a, mid)
        out.append((start, b, off))
        start, off = b, _offset(zone, b)
    out.append((start, hi, off))
    return out


def zone_names(spark: SparkSession) -> DataFrame:
    """(zone): the names of the tz database."""
    return spark.createDataFrame([(n,) for n in sorted(available_timezones())], "zone string")


def like_years(year: Column) -> tuple[Column, Column]:
    """The year of zone_table() that stands for ``year``, and the seconds between the two years' beginnings."""
    jan = lambda y: F.unix_date(F.make_date(y, F.lit(1), F.lit(1)))
    years = list(range(LAST_YEAR - 27, LAST_YEAR + 1))
    # By weekday of 1 January (0 to 6) and leap years apart: one of the last 28 years for each of the 14 calendars.
    calendars = {(dt.date(y, 1, 1).weekday(), y % 4 == 0): y for y in years}
    table = F.array(*[F.lit(calendars[i % 7, i >= 7]) for i in range(14)])
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    late = F.when(year > LAST_YEAR, F.get(table, F.weekday(F.make_date(year, F.lit(1), F.lit(1))) + F.when(leap, 7).otherwise(0)))
    like = F.when(year > LAST_YEAR, late).otherwise(F.greatest(year, F.lit(FIRST_YEAR)))
    return like, F.when(year > LAST_YEAR, (jan(year) - jan(late)).cast("bigint") * 86_400).otherwise(F.lit(0))


def zone_table(spark: SparkSession, zones: list[str], first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """One row per zone and local year (the intervals exploded to the years they touch), with the intervals in
    order of time.  Bounds are *local* seconds: where clocks go back two intervals overlap, where they go forward
    a gap is left; the first interval has no beginning.  Rows: at most the names of the tz database (about 600) times the
    years, whatever the data."""
    known, rows = available_timezones(), []
    starts = [_secs(dt.datetime(y, 1, 1, tzinfo=_UTC)) for y in range(first_year, last_year + 2)]
    for name in sorted(set(zones) & known):
        local = [(f + o, t + o, o) for f, t, o in zone_intervals(name, first_year, last_year + 1)]
        local[0] = (-(1 << 60), *local[0][1:])
        at = 0
        for y, a, b in zip(range(first_year, last_year + 1), starts, starts[1:]):
            while at < len(local) and local[at][1] <= a - 2 * 86_400:
                at += 1
            near = []
            for x in local[at:]:
                if x[0] >= b + 2 * 86_400:
                    break
                near.append(x)
            rows.append((name, y, near))
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("local_from", "local_to", "offset")])
    return spark.createDataFrame(
        rows, T.StructType([T.StructField("zone", T.StringType()), T.StructField("local_year", T.IntegerType()), T.StructField("spans", T.ArrayType(span))])
    )
