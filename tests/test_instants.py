from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from brocal.operators.instants import instants, to_normalise, zones

IN = datetime(2026, 4, 19, 12, 0, 0)
UTC = timezone.utc


def us(y, m, d, h=0, n=0, s=0, f=0, tz=UTC):
    return int((datetime(y, m, d, h, n, s, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) + f


CASES = [
    ("2026-04-05T01:55:43Z", None, us(2026, 4, 5, 1, 55, 43)), (" 2026-04-05 01:55:43.1234567899Z ", None, us(2026, 4, 5, 1, 55, 43, 123456)),
    ("2026-04-07 22:00:48+0530", "Europe/Madrid", us(2026, 4, 7, 16, 30, 48)), ("2026-04-07T22:00:48-04:00", None, us(2026, 4, 8, 2, 0, 48)),
    ("2026-01-10T22:26:52", "Europe/Madrid", us(2026, 1, 10, 21, 26, 52)), ("2026-01-10T22:26:52", None, us(2026, 1, 10, 22, 26, 52)), ("2026-01-10T22:26:52", "Nowhere/Land", None),
    # twice: the earlier instant; skipped: the offset before the change
    ("2025-10-26T02:30:00", "Europe/Madrid", us(2025, 10, 26, 0, 30)), ("2026-03-29T02:30:00", "Europe/Madrid", us(2026, 3, 29, 1, 30)),
    ("2026-01-24T21:19:35[Europe/Madrid]", "Asia/Kolkata", us(2026, 1, 24, 20, 19, 35)), ("2026-03-04 01:27:37 CET", None, us(2026, 3, 4, 0, 27, 37)), ("2026-05-23 03:05:42 CEST", None, us(2026, 5, 23, 1, 5, 42)),
    ("02/20/2026 11:10 PM", None, us(2026, 2, 20, 23, 10)), ("02/20/2026 12:10 AM", None, us(2026, 2, 20, 0, 10)), ("13/45/2026 07:10 PM", None, None), ("02/20/2026 13:10 PM", None, None),
    ("25-04-2026 03:22", "Europe/Madrid", us(2026, 4, 25, 1, 22)), ("31-02-2026 10:00", None, None), ("29-02-2024 10:00", None, us(2024, 2, 29, 10)), ("29-02-2026 10:00", None, None),
    ("8 dic 2025 00:54", None, us(2025, 12, 8, 0, 54)), ("21 ene 2026 22:31  ", "America/Los_Angeles", us(2026, 1, 22, 6, 31)), ("Tue, 17 Mar 2026 02:34:38 +0100", None, us(2026, 3, 17, 1, 34, 38)),
    ("20260222T195419Z", None, us(2026, 2, 22, 19, 54, 19)), ("1771171380", None, 1771171380000000), ("1759138761473", None, 1759138761473000), ("1762093800020032", None, 1762093800020032), ("1778874237.26", None, 1778874237260000),
    ("1771171380123456789", None, 1771171380123456), ("12", None, None), ("99999999999999999999", None, None), ("hace 3 horas", None, us(2026, 4, 19, 9)), ("Hace 120 días", None, us(2025, 12, 20, 12)),
    ("hace un rato", None, None), ("pendiente", None, None), ("", None, None), (None, None, None), ("0000-00-00 00:00:00", None, None), ("2026-13-01T00:00:00Z", None, None), ("2026-01-01T24:00:00Z", None, None), ("2026-01-01T00:00:60Z", None, None),
    ("2026-01-01T00:00:00+19:00", None, None), ("x" * 100_000, None, None),
    # the longest of each notation, and separators of our own inside
    ("2024-03-01T10:00:00.123456789-03:00[America/Argentina/Buenos_Aires]", None, us(2024, 3, 1, 13, 0, 0, 123456)), ("2024-03-01T10:00:00.123456789012 [America/Argentina/ComodRivadavia]", None, us(2024, 3, 1, 13, 0, 0, 123456)),
    ("20240301T100000.123456789012-0300[America/Argentina/Buenos_Aires]", None, us(2024, 3, 1, 13, 0, 0, 123456)), ("03/01/2024" + " " * 60 + "10:00:00.123456789012 p.m. [America/Argentina/Buenos_Aires]", None, us(2024, 3, 2, 1, 0, 0, 123456)),
    ("01-03-2024" + " " * 60 + "10:00:00.123456789012-03:00[America/Argentina/Buenos_Aires]", None, us(2024, 3, 1, 13, 0, 0, 123456)), ("miércoles," + " " * 40 + "1 de septiembre de 2024, " + " " * 40 + "10:00:00,123456789012 [America/Argentina/Buenos_Aires]", None, us(2024, 9, 1, 13, 0, 0, 123456)),
    ("-1234567890123456789.123456789012", None, None), ("hace" + " " * 50 + "999999 segundos", None, us(2026, 4, 19, 12) - 999_999_000_000), ("2026\x1f01", None, None), ("\x1f" * 20, None, None), ("8" + " " * 200_000 + "x", None, None),
]


def test_every_notation(spark):
    df = spark.createDataFrame([(i, t, z, IN, "own") for i, (t, z, _) in enumerate(CASES)], "i int, t string, z string, a timestamp_ntz, __p string")
    got = {r["i"]: (r["epoch_us"], r["__p"]) for r in instants(df, "t", "z", "a").collect()}
    assert {i: c[2] for i, c in enumerate(CASES)} == {i: v for i, (v, _) in got.items()}
    assert all(own == "own" for _, own in got.values())


@pytest.mark.parametrize("zone", ["Europe/Madrid", "America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_against_zoneinfo(spark, zone):
    hours = [datetime(2025, 9, 1) + timedelta(hours=7 * i, minutes=13) for i in range(1200)]
    df = spark.createDataFrame([(h.strftime("%d-%m-%Y %H:%M"), zone) for h in hours], "t string, z string")
    got = {r["t"]: r["epoch_us"] for r in instants(df, "t", "z", None).collect()}
    for h in hours:
        # fold=0: the earlier of two, and the offset before a gap
        assert got[h.strftime("%d-%m-%Y %H:%M")] == us(h.year, h.month, h.day, h.hour, h.minute, tz=ZoneInfo(zone)), h


def test_relative_and_counts_need_an_arrival(spark):
    df = spark.createDataFrame([("hace 3 horas", None), ("1771171380", None)], "t string, a timestamp")
    assert [r["epoch_us"] for r in instants(df, "t", None, "a").collect()] == [None, None]


def test_canonical_form_needs_no_work_and_zones_are_known_to_java(spark):
    df = spark.createDataFrame([("2026-04-05T01:55:43.123456Z",), ("2026-04-05T01:55:43Z",), (None,)], "t string")
    assert [r[0] for r in df.select(to_normalise(df, "t")).collect()] == [False, True, False]
    known = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    assert set(zones()) <= known
    assert instants(df.limit(0), "t", None, None).count() == 0
