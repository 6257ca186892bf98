"""Timestamps against the standard library's time zones."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from dossier.operators.timestamps import BINDING, normalise_timestamps

SCHEMA = "row int, raw string, time_zone string, locale string, source_key string, seen_us long, offset string, state int"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(moment):
    return (moment - EPOCH) // timedelta(microseconds=1)


def local(zone, *parts):
    """The earlier instant of a local time, or None if it was skipped."""
    moment = datetime(*parts, tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    return us(moment) if moment.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == datetime(*parts) else None


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, raw, tz, loc, f"{tz}{loc}", None, "clash", 1) for i, (raw, tz, loc) in enumerate(rows)], SCHEMA)
    return {r["row"]: r for r in normalise_timestamps(table, **options).collect()}


NY, LON, BER, SYD, KOL = "America/New_York", "Europe/London", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata"

CASES = [
    ("2024-07-03 05:11:20", NY, "en-US", local(NY, 2024, 7, 3, 5, 11, 20)), ("2024-07-03", KOL, "en-IN", local(KOL, 2024, 7, 3)), ("20240703", NY, "en-US", local(NY, 2024, 7, 3)),
    ("20240703051120", LON, "en-GB", local(LON, 2024, 7, 3, 5, 11, 20)), ("20240703T051120Z", LON, "en-GB", us(datetime(2024, 7, 3, 5, 11, 20, tzinfo=timezone.utc))),
    ("1720000000", NY, "en-US", 1720000000 * 10**6), ("1720000000123", NY, "en-US", 1720000000123000), ("1720000000123456", NY, "en-US", 1720000000123456),
    ("2024-01-15T10:00:00.5+05:30", NY, "en-US", us(datetime(2024, 1, 15, 4, 30, 0, 500000, tzinfo=timezone.utc))), ("2024-01-15T10:00-03", NY, "en-US", us(datetime(2024, 1, 15, 13, tzinfo=timezone.utc))),
    ("2025-07-25T12:34:18,442Z", LON, "en-GB", us(datetime(2025, 7, 25, 12, 34, 18, 442000, tzinfo=timezone.utc))), ("2024-03-21T01:10:03-07:00[America/Los_Angeles]", NY, "en-US", us(datetime(2024, 3, 21, 8, 10, 3, tzinfo=timezone.utc))),
    ("Sun, 21 May 2023 03:21:37 CDT", "America/Chicago", "en-US", us(datetime(2023, 5, 21, 8, 21, 37, tzinfo=timezone.utc))), ("Sunday, 07-Dec-25 00:23:58 GMT", KOL, "en-IN", us(datetime(2025, 12, 7, 0, 23, 58, tzinfo=timezone.utc))),
    ("8 June 2026, 01:00 BST", LON, "en-GB", us(datetime(2026, 6, 8, 0, tzinfo=timezone.utc))), ("25 September 2024, 22:23 IST", KOL, "en-IN", us(datetime(2024, 9, 25, 16, 53, tzinfo=timezone.utc))),
    ("January 5, 2024 11:45 PM EST", NY, "en-US", us(datetime(2024, 1, 6, 4, 45, tzinfo=timezone.utc))), ("Dec 15, 2025 12:32 am", NY, "en-US", local(NY, 2025, 12, 15, 0, 32)),
    ("13 de septiembre de 2024, 03:11", "Europe/Madrid", "es-ES", local("Europe/Madrid", 2024, 9, 13, 3, 11)), ("31. März 2025, 04:39 Uhr CEST", BER, "de-DE", us(datetime(2025, 3, 31, 2, 39, tzinfo=timezone.utc))),
    ("26 décembre 2025 à 13h18", "Europe/Paris", "fr-FR", local("Europe/Paris", 2025, 12, 26, 13, 18)), ("2026年4月10日 16:21", LON, "en-GB", local(LON, 2026, 4, 10, 16, 21)),
    ("04/18/2024 2:23 p.m.", NY, "en-US", local(NY, 2024, 4, 18, 14, 23)), ("03/04/2024 10:00", LON, "en-GB", local(LON, 2024, 4, 3, 10)), ("03/04/2024 10:00", NY, "en-US", local(NY, 2024, 3, 4, 10)),
    ("17.3.2023", BER, "de-DE", local(BER, 2023, 3, 17)), ("  2024-07-03\n", NY, "en-US", local(NY, 2024, 7, 3)), ("2024/03/06  08:18:06", NY, "en-US", local(NY, 2024, 3, 6, 8, 18, 6)),
    ("2024-11-03T01:21:01", NY, "en-US", local(NY, 2024, 11, 3, 1, 21, 1)), ("02-04-2023 02:30", SYD, "en-AU", local(SYD, 2023, 4, 2, 2, 30)), ("2024-02-29", LON, "en-GB", local(LON, 2024, 2, 29)),
    ("2023-03-12T02:18:45", NY, "en-US", None), ("29/03/2026 02:02", "Europe/Madrid", "es-ES", None), ("13/04/2024 10:00", NY, "en-US", None), ("04/13/2024 10:00", LON, "en-GB", None),
    ("2024-06-31T10:13:00Z", NY, "en-US", None), ("2023-02-29", NY, "en-US", None), ("2026-04-15 25:49:00", NY, "en-US", None), ("2025-13-13 10:54", NY, "en-US", None), ("0000-00-00 00:00:00", NY, "en-US", None),
    ("13:05 PM", NY, "en-US", None), ("Q3 2025", NY, "en-US", None), ("May 2024", NY, "en-US", None), ("2024-05", NY, "en-US", None), ("09:30", NY, "en-US", None), ("yesterday", NY, "en-US", None), ("123456789", NY, "en-US", None),
    ("2024-07-03 10:00 XYZ", NY, "en-US", None), ("", NY, "en-US", None), (" ", NY, "en-US", None), (None, NY, "en-US", None), ("2024-07-03 13:00 PM", NY, "en-US", None), ("9" * 5000, NY, "en-US", None), ("2024-07-03", None, None, None),
    ("2024-07-03T00:00:00Z", None, None, us(datetime(2024, 7, 3, tzinfo=timezone.utc))),
]


def test_rules(spark):
    got = run(spark, [c[:3] for c in CASES], **BINDING)
    wrong = [(c, got[i]["published_us"]) for i, c in enumerate(CASES) if got[i]["published_us"] != c[3]]
    assert not wrong and len(got) == len(CASES)


def test_all_hours_of_clock_changes(spark):
    rows = []
    for zone, days in ((NY, ((2024, 3, 10), (2024, 11, 3))), (LON, ((2025, 3, 30), (2025, 10, 26))), (SYD, ((2024, 4, 7), (2024, 10, 6))), ("America/Sao_Paulo", ((2024, 2, 18),))):
        rows += [(zone, (*d, h, m)) for d in days for h in range(24) for m in (0, 30, 59)]
    got = run(spark, [("%04d-%02d-%02d %02d:%02d" % p, z, "en-GB") for z, p in rows], **BINDING)
    assert [got[i]["published_us"] for i in range(len(rows))] == [local(z, *p) for z, p in rows]


def test_mixture_learns_the_order(spark):
    """Without a locale, unambiguous values of a source decide about its ambiguous ones."""
    rows = [(f"{d:02d}/{m:02d}/2024", LON, None) for d in range(13, 28) for m in range(1, 5)] + [("03/04/2024", LON, None), ("05/05/2024", LON, None)]
    mixed = [("03/04/2024", BER, None), ("25/04/2024", BER, None), ("04/25/2024", BER, None)]
    got = run(spark, rows + mixed, prior_weight=4.0)
    assert got[60]["state"] == "chosen" and got[60]["published_us"] == local(LON, 2024, 4, 3)
    assert got[61]["state"] == "exact"
    assert got[62]["state"] == "ambiguous" and got[62]["published_us"] is None and got[62]["posterior"] < 0.95
    assert got[63]["state"] == got[64]["state"] == "exact"


def test_empty(spark):
    assert run(spark, []) == {}
