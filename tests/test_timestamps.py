import datetime

import pytest

from heronry.functions.timestamps import normalise

FEEDS = [("ny", "America/New_York", "mdy"), ("berlin", "Europe/Berlin", "dmy"), ("utc", "UTC", "ymd"), ("free", "UTC", None), ("free_dmy", "UTC", None)]


def us(text):
    t = datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.UTC)
    return (t - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1)


CASES = [
    ("2020-01-01 05:00:00", "ny", "2020-01-01 10:00:00"), ("  2020-01-01T05:00 ", "berlin", "2020-01-01 04:00:00"),
    ("03/04/2021 00:00:00", "ny", "2021-03-04 05:00:00"), ("03/04/2021 00:00:00", "berlin", "2021-04-02 22:00:00"),
    ("25.12.2020 10:00", "berlin", "2020-12-25 09:00:00"), ("25.12.2020 10:00", "ny", None), ("31/31/2020", "ny", None),
    ("1566792000", "ny", "2019-08-26 04:00:00"), ("1566792000123", "ny", "2019-08-26 04:00:00.123"), ("1566792000123456", "ny", "2019-08-26 04:00:00.123456"),
    ("156679200012", "ny", None), ("Mon, 05 Aug 2019 04:00:00 GMT", "ny", "2019-08-05 04:00:00"), ("Wed, 08 Oct 2014 23:03:12 +0200", "ny", "2014-10-08 21:03:12"),
    ("Jul 09, 2023 12:00 AM", "utc", "2023-07-09 00:00:00"), ("Jul 9, 2023 12:30 PM", "utc", "2023-07-09 12:30:00"), ("Jul 9, 2023 13:30 PM", "utc", None),
    ("20150210T012500", "berlin", "2015-02-10 00:25:00"), ("20150210T012500Z", "berlin", "2015-02-10 01:25:00"), ("20150210", "berlin", "2015-02-09 23:00:00"),
    ("2022-06-03T02:38:39.123456789+05:45", "ny", "2022-06-02 20:53:39.123456"), ("2022-06-03 02:38:39,5", "utc", "2022-06-03 02:38:39.500000"),
    ("2022-06-03 02:00 UTC+02:00", "ny", "2022-06-03 00:00:00"), ("2022-06-03 02:00 GMT-3", "ny", "2022-06-03 05:00:00"), ("2022-06-03T02:00-03", "ny", "2022-06-03 05:00:00"),
    ("2022-06-03 02:00 EDT", "berlin", "2022-06-03 06:00:00"), ("2022-06-03 02:00 America/New_York", "berlin", "2022-06-03 06:00:00"), ("2022-06-03T02:00[Europe/Berlin]", "ny", "2022-06-03 00:00:00"),
    ("2021-11-07 01:30:00", "ny", "2021-11-07 05:30:00"),  # occurs twice: the first
    ("2021-03-14 02:30:00", "ny", "2021-03-14 07:30:00"),  # skipped: the offset before
    ("2022-06-03 02:00 XYZ", "ny", None), ("2022-06-03 02:00 Mars/Base", "ny", None), ("2021-06", "ny", None), ("2019-02-30", "ny", None), ("2020-02-29", "utc", "2020-02-29 00:00:00"),
    ("2020-05-17 25:61:00", "ny", None), ("2020-05-17 24:00:00", "ny", None), ("2020-05-17 23:59:60", "ny", None), ("0000-00-00", "ny", None), ("", "ny", None), ("   ", "ny", None), (None, "ny", None),
    ("pending", "ny", None), ("2020-01-01 05:00:00", None, None), ("2020-01-01 05:00:00", "nowhere", None), ("2020-01-01T05:00:00Z", None, "2020-01-01 05:00:00"),
    ("x" * 100_000, "ny", None),
]


def test_readings(spark):
    feeds = spark.createDataFrame(FEEDS, "feed string, tz_name string, date_order string")
    df = spark.createDataFrame([(i, v, f, "kept") for i, (v, f, _) in enumerate(CASES)], "i int, v string, feed string, tz_name string")
    got = {r.i: r for r in normalise(df, "v", "feed", feeds).collect()}
    assert len(got) == len(CASES)
    for i, (v, f, want) in enumerate(CASES):
        assert got[i].utc_us == (us(want) if want else None), (v and v[:40], f, got[i])
        assert got[i].tz_name == "kept"


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kolkata"])
def test_session_zone_plays_no_part(spark, zone):
    feeds = spark.createDataFrame(FEEDS, "feed string, tz_name string, date_order string")
    df = spark.createDataFrame([("2021-03-14 02:30:00", "ny"), ("1566792000", "ny")], "v string, feed string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert [r.utc_us for r in normalise(df, "v", "feed", feeds).collect()] == [us("2021-03-14 07:30:00"), 1566792000000000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_mixture_settles_or_marks(spark):
    feeds = spark.createDataFrame(FEEDS, "feed string, tz_name string, date_order string")
    clear = [(f"{d}/01/2020", "free_dmy") for d in range(13, 32)] * 3 + [("03/04/2020", "free_dmy")]
    torn = [("13/01/2020", "free"), ("01/13/2020", "free"), ("03/04/2020", "free"), ("04/04/2020", "free")]
    got = normalise(spark.createDataFrame(clear + torn, "v string, feed string"), "v", "feed", feeds).collect()
    at = {(r.v, r.feed): r for r in got}
    assert at["03/04/2020", "free_dmy"].reading == "dmy" and at["03/04/2020", "free_dmy"].posterior > 0.95
    assert at["03/04/2020", "free"].reading == "ambiguous" and at["03/04/2020", "free"].utc_us is None
    assert at["04/04/2020", "free"].utc_us == us("2020-04-04") and at["01/13/2020", "free"].reading == "mdy"


def test_a_declaration_is_a_prior(spark):
    """It decides where values say nothing, and gives way to values that cannot be read as declared."""
    feeds = spark.createDataFrame([("quiet", "UTC", "mdy"), ("wrong", "UTC", "mdy"), ("slip", "UTC", "dmy"), ("iso", "UTC", "ymd"), ("turned", "UTC", "ymd")], "feed string, tz_name string, date_order string")
    rows = [("03/04/2020", "quiet"), ("03/04/2020", "wrong"), *[(f"{d}/01/2020", "wrong") for d in range(13, 32)] * 2]
    rows += [*[(f"{d}/01/2020", "slip") for d in range(13, 32)] * 5, ("01/31/2020", "slip"), ("03/04/2020", "slip"), ("2020-03-04", "iso"), ("2020-25-12", "iso"), ("2020-03-25", "iso")]
    rows += [("2020-03-04", "turned"), *[(f"2020-{d}-01", "turned") for d in range(13, 32)] * 2]
    at = {(r.v, r.feed): r for r in normalise(spark.createDataFrame(rows, "v string, feed string"), "v", "feed", feeds).collect()}
    assert at["03/04/2020", "quiet"].utc_us == us("2020-03-04") and 0.95 <= at["03/04/2020", "quiet"].posterior < 1
    assert at["03/04/2020", "wrong"].utc_us == us("2020-04-03") and at["31/01/2020", "wrong"].utc_us == us("2020-01-31")
    assert at["03/04/2020", "slip"].utc_us == us("2020-04-03") and at["01/31/2020", "slip"].reading == "unreadable"
    assert at["2020-03-04", "iso"].reading == "single" and at["2020-03-04", "iso"].utc_us == us("2020-03-04") and at["2020-25-12", "iso"].utc_us is None
    assert at["2020-03-04", "turned"].reading == "ydm" and at["2020-03-04", "turned"].utc_us == us("2020-04-03")


def test_repeated_feeds(spark):
    feeds = spark.createDataFrame([("f", "UTC", "ymd"), ("f", "UTC", "ymd"), ("f", "Europe/Berlin", "dmy")], "feed string, tz_name string, date_order string")
    got = normalise(spark.createDataFrame([("2020-01-01", "f")] * 2, "v string, feed string"), "v", "feed", feeds).collect()
    assert [r.utc_us for r in got] == [us("2019-12-31 23:00:00")] * 2


def test_clashing_names(spark):
    feeds = spark.createDataFrame(FEEDS, "feed string, tz_name string, date_order string")
    df = spark.createDataFrame([("2020-01-01", "utc", 1, "x", 2, "y")], "v string, feed string, utc_us int, reading string, _t_v int, `a.b` string")
    got = normalise(df, "v", "feed", feeds).collect()
    assert got[0].asDict() == {"v": "2020-01-01", "feed": "utc", "a.b": "y", "utc_us": us("2020-01-01"), "reading": "single", "posterior": 1.0}


def test_empty(spark):
    feeds = spark.createDataFrame([], "feed string, tz_name string, date_order string")
    assert normalise(spark.createDataFrame([], "v string, feed string"), "v", "feed", feeds).collect() == []
