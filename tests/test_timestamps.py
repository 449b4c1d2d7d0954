"""The cascade against Python's own calendar and zone data, value by value."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from evplace.operators.timestamps import normalise_timestamps

SOURCES = [("Paris Post", "Europe/Paris", "dmy"), ("York Times", "America/New_York", "mdy"), ("Tokyo Daily", "Asia/Tokyo", "ymd")]
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*parts, tz="UTC"):
    return (datetime(*parts, tzinfo=ZoneInfo(tz)) - EPOCH) // timedelta(microseconds=1)


def run(spark, values, **options):
    rows = [(i, v, s) for i, (v, s) in enumerate(values)]
    df = spark.createDataFrame(rows, "row_id long, published_at string, source string")
    sources = spark.createDataFrame(SOURCES, "source_name string, tz_name string, date_order string")
    out = {r["row_id"]: (r["instant_us"], r["instant_status"]) for r in normalise_timestamps(df, sources, **options).collect()}
    return [out[i] for i in range(len(rows))]


GOOD = [
    ("2024-03-05T10:11:12Z", None, us(2024, 3, 5, 10, 11, 12)),
    ("2024-03-05T10:11:12.123456+01:00", None, us(2024, 3, 5, 9, 11, 12, 123456)),
    ("2024-03-05 10:11:12.5 -0530", None, us(2024, 3, 5, 15, 41, 12, 500000)),
    ("2024-07-05T10:11:12+02:00[Europe/Paris]", None, us(2024, 7, 5, 8, 11, 12)),
    ("2024-03-05 10:11:12 EST", "Paris Post", us(2024, 3, 5, 15, 11, 12)),
    ("20240305T101112Z", None, us(2024, 3, 5, 10, 11, 12)),
    ("1709633472", None, 1709633472_000000),
    ("1709633472.25", None, 1709633472_250000),
    ("1709633472123", None, 1709633472_123000),
    ("Tue, 05 Mar 2024 10:11:12 +0100", None, us(2024, 3, 5, 9, 11, 12)),
    ("March 05, 2024 at 12:07 AM UTC", None, us(2024, 3, 5, 0, 7)),
    ("Mar 5, 2024 8:54 pm", "York Times", us(2024, 3, 5, 20, 54, tz="America/New_York")),
    (" 2024-03-05\n", "  PARIS post ", us(2024, 3, 5, tz="Europe/Paris")),
    ("2024/03/05 (Tue) 10:11", "Paris Post", us(2024, 3, 5, 10, 11, tz="Europe/Paris")),
    ("05/03/2024 10:11", "Paris Post", us(2024, 3, 5, 10, 11, tz="Europe/Paris")),
    ("03/05/2024 10:11 PM", "York Times", us(2024, 3, 5, 22, 11, tz="America/New_York")),
    ("05.03.2024 10:11", "Paris Post", us(2024, 3, 5, 10, 11, tz="Europe/Paris")),
    ("2024.03.05 10:11", "Tokyo Daily", us(2024, 3, 5, 10, 11, tz="Asia/Tokyo")),
    ("23 décembre 2021 à 17h02", "Paris Post", us(2021, 12, 23, 17, 2, tz="Europe/Paris")),
    ("12. März 2022, 02:33 Uhr", "Paris Post", us(2022, 3, 12, 2, 33, tz="Europe/Paris")),
    ("7 de junio de 2021, 13:39", "Paris Post", us(2021, 6, 7, 13, 39, tz="Europe/Paris")),
    ("8 June 2023, 00:45", "Tokyo Daily", us(2023, 6, 8, 0, 45, tz="Asia/Tokyo")),
    ("2024-02-29", "Tokyo Daily", us(2024, 2, 29, tz="Asia/Tokyo")),
]
BAD = [
    (None, "Paris Post", "empty"), ("  ", "Paris Post", "empty"), ("recently", "Paris Post", "unreadable"), ("2023-", "Paris Post", "unreadable"),
    ("March 2022", "Paris Post", "unreadable"), ("25:61", "Paris Post", "unreadable"), ("2023-02-30T10:00:00Z", "Paris Post", "impossible"),
    ("0000-00-00 00:00:00", "Paris Post", "impossible"), ("31/31/2022", "Paris Post", "impossible"), ("2022-13-05 08:10", "Paris Post", "impossible"),
    ("2024-03-05 24:00", "Paris Post", "impossible"), ("03/05/2024 13:11 PM", "York Times", "impossible"), ("2024-03-05", None, "no_zone"),
    ("2024-03-05", "Nobody", "no_zone"), ("05/03/2024 10:11", "Tokyo Daily", "unreadable"), ("2024-03-31T02:30:00", "Paris Post", "nonexistent"),
    ("2024-10-27 02:30", "Paris Post", "ambiguous"), ("2024/03/05 (Mon) 10:11", "Paris Post", "impossible"), ("2024-03-05 10:11:12 XYZ", "Paris Post", "unreadable"),
]


def test_every_format_names_one_instant(spark):
    got = run(spark, [(v, s) for v, s, _ in GOOD])
    assert [g[0] for g in got] == [w for *_, w in GOOD]
    assert {g[1] for g in got} == {"ok"}


def test_values_without_instant(spark):
    got = run(spark, [(v, s) for v, s, _ in BAD])
    assert [g for g in got] == [(None, w) for *_, w in BAD]


def test_policies(spark):
    twice, never = ("2024-10-27 02:30", "Paris Post"), ("2024-03-31 02:30", "Paris Post")
    early = run(spark, [twice], ambiguous="earlier")[0][0]
    late = run(spark, [twice], ambiguous="later")[0][0]
    assert early == us(2024, 10, 27, 0, 30) and late == us(2024, 10, 27, 1, 30)
    assert run(spark, [never], nonexistent="shift")[0][0] == us(2024, 3, 31, 1, 30)


def test_offsets_survive_both_sides_of_a_change(spark):
    got = run(spark, [("2024-10-27T02:30:00+02:00", "Paris Post"), ("2024-10-27T02:30:00+01:00", "Paris Post"), ("2024-10-27 01:59", "Paris Post"), ("2024-10-27 03:00", "Paris Post")])
    assert [g[0] for g in got] == [us(2024, 10, 27, 0, 30), us(2024, 10, 27, 1, 30), us(2024, 10, 26, 23, 59), us(2024, 10, 27, 2)]


def test_empty_table_and_long_text(spark):
    assert run(spark, [("x" * 100_000, "Paris Post"), ("x", None), ("a" + " " * 300_000 + "b", "Paris Post")]) == [(None, "unreadable")] * 3
    empty = spark.createDataFrame([], "row_id long, published_at string, source string, tz_name string")
    sources = spark.createDataFrame(SOURCES, "source_name string, tz_name string, date_order string")
    assert normalise_timestamps(empty, sources).columns == ["row_id", "published_at", "source", "tz_name", "instant_status", "instant_us"]
    assert normalise_timestamps(empty, sources).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "2024-03-05", "Paris Post", "a", "b")], "row_id long, published_at string, source string, tz_name string, date_order string")
    sources = spark.createDataFrame(SOURCES + SOURCES, "source_name string, tz_name string, date_order string")
    row = normalise_timestamps(df, sources).collect()
    assert len(row) == 1 and row[0]["tz_name"] == "a" and row[0]["instant_us"] == us(2024, 3, 5, tz="Europe/Paris")


@pytest.mark.parametrize("zone", ["Europe/London", "America/Los_Angeles", "Australia/Sydney"])
def test_against_zone_data_around_changes(spark, zone):
    values, want = [], []
    for start in (datetime(2023, 3, 25), datetime(2023, 10, 28), datetime(2023, 11, 4), datetime(2023, 3, 11), datetime(2023, 4, 1), datetime(2023, 9, 30)):
        for step in range(0, 48 * 2):
            t = start + timedelta(minutes=30 * step)
            values.append((t.strftime("%Y-%m-%d %H:%M"), "Z"))
            both = {t.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(timezone.utc) for f in (0, 1)}
            real = [u for u in both if u.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t]
            want.append((real[0] - EPOCH) // timedelta(microseconds=1) if len(real) == 1 else None)
    df = spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate(values)], "row_id long, published_at string, source string")
    sources = spark.createDataFrame([("Z", zone, "dmy")], "source_name string, tz_name string, date_order string")
    got = {r["row_id"]: r["instant_us"] for r in normalise_timestamps(df, sources).collect()}
    assert [got[i] for i in range(len(want))] == want
