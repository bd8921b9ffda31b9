"""Instants of mixed texts, against values worked out by hand and zoneinfo."""

import random
from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from carteggio.operators.timestamps import normalise

EMAILS = "id long, source_file_id long, sent_at string, imported_at timestamp, sent_us_note string"
US = 1_000_000


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * US


def local(zone, *a, fold=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * US


CASES = [
    ("2019-11-02T12:41:18+01:00", utc(2019, 11, 2, 11, 41, 18)),
    ("2019-11-02T12:41:18.123456789Z", utc(2019, 11, 2, 12, 41, 18) + 123456),
    ("2020-06-25 19:34:53,897", local("Europe/Rome", 2020, 6, 25, 19, 34, 53) + 897000),
    ("Sun, 31 Mar 2019 05:47:21 +0200 (ora legale)", utc(2019, 3, 31, 3, 47, 21)),
    ("Fri, 07 Aug 2020 18:34:52 EDT", utc(2020, 8, 7, 22, 34, 52)),
    ("Mon, 6 Oct 2025 16:55:01 +0545", utc(2025, 10, 6, 11, 10, 1)),
    ("2020-02-12T07:28:18-05", utc(2020, 2, 12, 12, 28, 18)),
    ("20200413T202626+0200", utc(2020, 4, 13, 18, 26, 26)),
    ("2019-09-25T15:36:40[America/New_York]", local("America/New_York", 2019, 9, 25, 15, 36, 40)),
    ("2020-06-29 10:26:04 Asia/Kolkata", local("Asia/Kolkata", 2020, 6, 29, 10, 26, 4)),
    ("7/30/2019 5:35 PM", local("Europe/Rome", 2019, 7, 30, 17, 35)),
    ("12/31/2019 12:05 AM", local("Europe/Rome", 2019, 12, 31, 0, 5)),
    ("26/12/19 01:43", local("Europe/Rome", 2019, 12, 26, 1, 43)),
    ("27.08.2019 06.13", local("Europe/Rome", 2019, 8, 27, 6, 13)),
    ("gio 18 giu 2020, 05:44", local("Europe/Rome", 2020, 6, 18, 5, 44)),
    ("31. März 2020 um 20:00", local("Europe/Rome", 2020, 3, 31, 20, 0)),
    ("3 marzo 2019 ore 13:04", local("Europe/Rome", 2019, 3, 3, 13, 4)),
    ("Aug 10, 2019 8:48:28 pm", local("Europe/Rome", 2019, 8, 10, 20, 48, 28)),
    ("Mon Oct  7 09:28:15 2019", local("Europe/Rome", 2019, 10, 7, 9, 28, 15)),
    ("1567788021", 1567788021 * US),
    ("1585794397.788", 1585794397788000),
    ("1606398744677", 1606398744677000),
    ("1576537535153465", 1576537535153465),
    ("2020-10-25T02:30:00", local("Europe/Rome", 2020, 10, 25, 2, 30)),  # occurs twice: the earlier instant
    ("2020-03-29T02:30:00", utc(2020, 3, 29, 1, 30)),  # skipped: the offset before the change
    ("  2020-01-01 10:00 UTC ", utc(2020, 1, 1, 10)),
    *[(x, None) for x in (None, "", "  ", "n/d", "ieri alle 10", "T10:00:00Z", "2023-02-29T08:15:00+01:00", "32/13/2023 25:61",
                          "0000-00-00 00:00:00", "2023-01-01", "2023-01-01 24:00:00", "x" * 50_000, "13/13/2020 5:00 PM", "2020", "~~~~~~~~~")],
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(1, "Europe/Rome", "a"), (2, None, "b"), (3, "Mars/Olympus", "c")], "id long, zone_name string, path string")


def test_forms(spark, sources):
    df = spark.createDataFrame([(i, 1, t, datetime(2026, 1, 1), "kept") for i, (t, _) in enumerate(CASES)], EMAILS)
    got = {r["id"]: r for r in normalise(df, sources).collect()}
    assert len(got) == len(CASES)
    assert [(t, got[i]["sent_us"]) for i, (t, _) in enumerate(CASES)] == CASES
    assert got[0]["sent_us_note"] == "kept"


def mail(zone, at, delay):
    """(local text, ingestion) of a message sent at an instant."""
    return at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), (at + timedelta(hours=delay)).replace(tzinfo=None)


def test_missing_zones_are_estimated(spark, sources):
    # source 2 lies in Kolkata; source 3 moves from Rome to New York, both with daylight time; 4 declares nothing and states offsets
    rng, rows, want = random.Random(4), [], {}
    for i in range(3000):
        at = datetime(2019, 1, 1, tzinfo=UTC) + timedelta(minutes=rng.randrange(2 * 365 * 24 * 60))
        source = 2 + i % 3
        zone = "Asia/Kolkata" if source == 2 else "Europe/Rome" if at < datetime(2020, 1, 1, tzinfo=UTC) else "America/New_York"
        text, seen = mail(zone, at, 2000 if rng.random() < 0.1 else rng.lognormvariate(0.7, 0.8))
        if source == 4:
            text += "+01:00" if zone == "Europe/Rome" else "-05:00"
            source = 3 if rng.random() < 0.5 else 2
        else:
            want[i] = round(at.timestamp()) * US
        rows.append((i, source, text, seen, ""))
    got = {r["id"]: r["sent_us"] for r in normalise(spark.createDataFrame(rows, EMAILS), sources).collect()}
    assert sum(got[i] == w for i, w in want.items()) >= 0.97 * len(want)


def test_no_estimate_where_all_zones_are_declared(spark, sources):
    df = spark.createDataFrame([(1, 1, "2020-01-01 10:00", datetime(2020, 1, 1), "")], EMAILS)
    plan = normalise(df, sources)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" not in plan


def test_unknown_source_and_empty(spark, sources):
    df = spark.createDataFrame([(1, None, "2020-01-01 10:00", None, ""), (2, None, "2020-01-01 10:00Z", None, "")], EMAILS)
    assert {r["id"]: r["sent_us"] for r in normalise(df, sources).collect()} == {1: None, 2: utc(2020, 1, 1, 10)}
    assert normalise(df.limit(0), sources).count() == 0
