import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsmill.functions.zones import zone_intervals
from newsmill.operators.timestamps import instants

CASES = [  # value, zone, country, order, expected UTC (None: no instant)
    ("2023-03-13T04:01:37", "Europe/Madrid", "ES", "DMY", "2023-03-13 03:01:37"),
    ("2023-03-16T23:19:27.126Z", "America/New_York", "US", "MDY", "2023-03-16 23:19:27.126"),
    ("1679041372", "Europe/Budapest", "HU", "YMD", "2023-03-17 08:22:52"),
    ("1678136679102", "America/Chicago", "US", "MDY", "2023-03-06 21:04:39.102"),
    ("03/11/2023 19:52", "America/New_York", "US", "MDY", "2023-03-12 00:52"),
    ("03/11/2023 19:52", "Europe/London", "GB", "DMY", "2023-11-03 19:52"),
    ("  Mon, 13 Mar 2023 10:29:25 CDT\n", "America/Chicago", "US", "MDY", "2023-03-13 15:29:25"),
    ("Tue, 13 Mar 2023 10:29:25 IST", "Europe/Dublin", "IE", "DMY", "2023-03-13 09:29:25"),  # wrong weekday, Irish letters
    ("Mon, 13 Mar 2023 10:29:25 IST", "Asia/Kolkata", "IN", "DMY", "2023-03-13 04:59:25"),
    ("2023. március 25. 15:42", "Europe/Budapest", "HU", "YMD", "2023-03-25 14:42"),
    ("15 de março de 2023, 22:21", "America/Sao_Paulo", "BR", "DMY", "2023-03-16 01:21"),
    ("25 mars 2023 à 20h34", "Europe/Paris", "FR", "DMY", "2023-03-25 19:34"),
    ("11. März 2023, 15:05 Uhr", "Europe/Berlin", "DE", "DMY", "2023-03-11 14:05"),
    ("March 22, 2023, 5:39 p.m.", "Asia/Tokyo", "JP", "YMD", "2023-03-22 08:39"),
    ("2023-080T11:45:06Z", "America/Sao_Paulo", "BR", "DMY", "2023-03-21 11:45:06"),
    ("20230325T020255Z", "America/New_York", "US", "MDY", "2023-03-25 02:02:55"),
    ("2022-10-30T02:48:44[Europe/Budapest]", "Europe/London", "GB", "DMY", "2022-10-30 00:48:44"),  # twice: the first
    ("2022-03-27 02:34", "Europe/Madrid", "ES", "DMY", "2022-03-27 01:34"),  # skipped: the offset before
    ("2023-03-05", "Asia/Tokyo", "JP", "YMD", "2023-03-04 15:00"),
    ("16 Mar 23 13:36 +0000", "Europe/Dublin", "IE", "DMY", "2023-03-16 13:36"),
    ("2023-03-10 18:42:20 GMT+2", "America/New_York", "US", "MDY", "2023-03-10 16:42:20"),
    ("1985-06-01 10:00:00", "Europe/Paris", "FR", "DMY", "1985-06-01 08:00"),
    ("2050-06-01 10:00:00", "Europe/Paris", "FR", "DMY", "2050-06-01 08:00"),
    ("2050-01-01 10:00:00", "Europe/Paris", "FR", "DMY", "2050-01-01 09:00"),
    ("2190-07-01 10:00:00", "Europe/Paris", "FR", "DMY", "2190-07-01 08:00"),
    ("2191-10-30 02:30:00", "Europe/Paris", "FR", "DMY", "2191-10-30 00:30"),  # twice, by the rule of the last Sunday
    ("1850-01-01 00:00:00", "Europe/Paris", "FR", "DMY", "1849-12-31 23:50:39"),  # local mean time
    ("1899-12-30T00:00:00Z", "Europe/Paris", "FR", "DMY", "1899-12-30 00:00"),
    ("2023-03-10T18:42:20.1234567890123456789Z", "Europe/Paris", "FR", "DMY", "2023-03-10 18:42:20.123"),
    ("Mon, 13 Mar 2023 10:29:25 +0100 (" + "a long comment " * 20 + ")", "Europe/Paris", "FR", "DMY", "2023-03-13 09:29:25"),
    ("31 Sep 2023 08:15:00 GMT", "Europe/London", "GB", "DMY", None),
    ("2023-13-05 09:00", "Europe/London", "GB", "DMY", None),
    ("25:61", "Europe/London", "GB", "DMY", None),
    ("yesterday", "Europe/London", "GB", "DMY", None),
    ("", "Europe/London", "GB", "DMY", None),
    (None, "Europe/London", "GB", "DMY", None),
    ("2023-03-13T04:01:37", None, None, None, None),  # no zone known
    ("2023-03-13T04:01:37 " + "x" * 10_000, "Europe/London", "GB", "DMY", None),
]


def _tables(spark, cases):
    rows = [(i, f"s{i}", v, "clash") for i, (v, *_) in enumerate(cases)]
    items = spark.createDataFrame(rows, "item_id long, source_id string, pub_date string, zone string")
    pages = spark.createDataFrame([], "extraction_id long, source_id string, published_at string")
    src = spark.createDataFrame([(f"s{i}", z, k, o) for i, (_, z, k, o, _) in enumerate(cases)], "source_id string, time_zone string, country_code string, date_order string")
    return items, pages, src


def test_cases(spark):
    got = {r.record_id: r.utc_ms for r in instants(*_tables(spark, CASES)).collect()}
    for i, (value, *_, expected) in enumerate(CASES):
        want = None if expected is None else int(dt.datetime.fromisoformat(expected + "+00:00").timestamp() * 1000)
        assert got.get(i) == want, value


def test_empty_and_repeated(spark):
    items, pages, src = _tables(spark, CASES[:2])
    assert instants(items.limit(0), pages, src).count() == 0
    assert instants(items.union(items), pages, src.union(src)).count() == 4


@pytest.mark.parametrize("zone", ["Europe/Budapest", "America/Sao_Paulo", "Asia/Tokyo"])
def test_intervals_cover(zone):
    spans = zone_intervals(zone, 2000, 2024)
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:]))
