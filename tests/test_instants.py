"""Instants of mixed timestamps against the standard library."""

import datetime as dt
import json
import random
import zoneinfo

from lumika.operators.instants import capture_instants, utc_text

ZONES = ["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Lord_Howe", "America/Sao_Paulo"]


def resolve(local, zone):
    info, found = zoneinfo.ZoneInfo(zone), set()
    for fold in (0, 1):
        at = local.replace(tzinfo=info, fold=fold).astimezone(dt.timezone.utc)
        if at.astimezone(info).replace(tzinfo=None) == local:
            found.add(at)
    return found.pop().replace(tzinfo=None).isoformat(timespec="microseconds") + "Z" if len(found) == 1 else None


def run(spark, rows):
    df = spark.createDataFrame([(i, c, e, "x") for i, (c, e) in enumerate(rows)], "id long, captured_at string, exif_json string, t string")
    found = capture_instants(df)
    return {r[0]: r[1] for r in found.select("photo_id", utc_text(found["micros"])).collect()}


def test_notations(spark):
    cases = [
        ("2021-09-23T03:13:31+00:00", "2021-09-23T03:13:31.000000Z"), (" 2021-09-23T03:13:31.1234567Z\n", "2021-09-23T03:13:31.123456Z"),
        ("2021:09:23 03:13:31-04:00", "2021-09-23T07:13:31.000000Z"), ("2021-09-23 03:13:31+0545", "2021-09-22T21:28:31.000000Z"),
        ("2021-09-23T03:13+11", "2021-09-22T16:13:00.000000Z"), ("20210923T031331Z", "2021-09-23T03:13:31.000000Z"),
        ("2021-09-23 03:13:31 GMT", "2021-09-23T03:13:31.000000Z"), ("Thu, 23 Sep 2021 03:13:31 +0200", "2021-09-23T01:13:31.000000Z"),
        ("2021-07-01 12:00:00 Europe/Berlin", "2021-07-01T10:00:00.000000Z"), ("2021-07-01T12:00:00-04:00[America/New_York]", "2021-07-01T16:00:00.000000Z"),
        ("1632366811", "2021-09-23T03:13:31.000000Z"), ("1632366811123", "2021-09-23T03:13:31.123000Z"), ("1632366811123456", "2021-09-23T03:13:31.123456Z"),
        ("1632366811.25", "2021-09-23T03:13:31.250000Z"), ("2021-02-30T10:00:00Z", None), ("2021-09-23", None), ("2021-09-23T24:00:00Z", None), ("0000:00:00 00:00:00", None),
        ("2021-09-23T03:13:31", None), ("", None), (None, None), ("yesterday", None), ("2021-09-23 03:13:31 Mars/Base", None), ("2020-02-29T00:00:00Z", "2020-02-29T00:00:00.000000Z"),
    ]
    got = run(spark, [(c, None) for c, _ in cases])
    assert [got.get(i) for i in range(len(cases))] == [w for _, w in cases]


def test_what_gives_the_offset(spark):
    tags = lambda **k: json.dumps({f"EXIF {n}": v for n, v in k.items()})
    both = tags(DateTimeOriginal="2021:01:02 03:04:05", OffsetTimeOriginal="+02:00", TimeZone="Asia/Tokyo")
    cases = [
        ("n/a", both, "2021-01-02T01:04:05.000000Z"), ("09/23/2021 01:13:31 PM", both, "2021-09-23T11:13:31.000000Z"), ("23.09.2021 12:13", both, "2021-09-23T10:13:00.000000Z"),
        ("2021-07-01 12:00:00 Europe/Berlin", both, "2021-07-01T10:00:00.000000Z"), ("2021-07-01", tags(DateTimeOriginal="2021:01:02 03:04:05", TimeZone="Asia/Tokyo"), "2021-01-01T18:04:05.000000Z"),
        ("1 Apr 2024 14:17:38", tags(OffsetTimeOriginal="local", TimeZone="Asia/Tokyo"), "2024-04-01T05:17:38.000000Z"), ("1 Apr 2024 14:17:38", tags(OffsetTimeOriginal="   :  "), None),
        ("2021-03-28T02:30:00", tags(TimeZone="Europe/Berlin"), None), ("2021-10-31T02:30:00", tags(TimeZone="Europe/Berlin"), None),
        ("2021-10-31T02:30:00", tags(OffsetTimeOriginal="+01:00", TimeZone="Europe/Berlin"), "2021-10-31T01:30:00.000000Z"),
        (None, both[:-5], None), (None, both + " trailing", None), (None, "[]", None), (None, "", None), (None, "null", None), ("2021-01-01T00:00:00", both[:-5], None),
    ]
    got = run(spark, [(c, e) for c, e, _ in cases])
    assert [got.get(i) for i in range(len(cases))] == [w for *_, w in cases]


def test_named_zones_against_the_zone_database(spark):
    r = random.Random(1)
    rows, want = [], []
    for zone in ZONES:
        for _ in range(60):
            local = dt.datetime(r.choice([1950, 1995, 2011, 2018, 2021, 2040]), r.choice([2, 3, 4, 10, 11]), r.randrange(1, 29), r.randrange(4), r.choice([0, 15, 30, 59]))
            rows.append((local.strftime("%Y-%m-%d %H:%M:%S ") + zone, None))
            want.append(resolve(local, zone))
    turns = ["2021-10-31 02:30:00 Europe/Berlin", "2021-03-28 02:00:00 Europe/Berlin", "2021-11-07 01:59:59 America/New_York", "2018-11-04 00:30:00 America/Sao_Paulo", "2018-02-17 23:30:00 America/Sao_Paulo", "2021-04-04 01:45:00 Australia/Lord_Howe"]
    rows += [(t, None) for t in turns]
    want += [resolve(dt.datetime.fromisoformat(t[:19]), t[20:]) for t in turns]
    got = run(spark, rows)
    assert [got.get(i) for i in range(len(rows))] == want and want[-len(turns) :] == [None] * len(turns)


def test_named_zones_in_far_years(spark):
    rows, want = [], []
    for zone in ("America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Africa/Casablanca"):
        for year in (2, 1701, 1850, 1899, 2037, 2100, 2101, 2150, 2499, 2500, 2900, 3333, 9998):
            for month, day in ((1, 1), (3, 14), (4, 5), (7, 1), (10, 4), (10, 25), (12, 31)):
                local = dt.datetime(year, month, day, 2, 10)
                rows.append((local.isoformat() + " " + zone, None))
                want.append(resolve(local, zone))
    got = run(spark, rows)
    assert [got.get(i) for i in range(len(rows))] == want
    # 1850 is before the zone's time: its clocks showed the sun's
    assert got[next(i for i, (t, _) in enumerate(rows) if t.startswith("1850-07-01"))] == "1850-07-01T07:06:02.000000Z"


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "2021-09-23T03:13:31Z", None)] * 3 + [(None, "2021-09-23T03:13:31Z", None)], "id long, captured_at string, exif_json string")
    assert capture_instants(df).count() == 1 and capture_instants(df.limit(0)).count() == 0
