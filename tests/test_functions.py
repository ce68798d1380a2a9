import hashlib
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import instants, times, urls, values


def one(rows, value, expr):
    return rows("x string", (value,)).select(expr.alias("y")).first().y


@pytest.mark.parametrize("url,ext", [("http://a/a.b/c", "html"), ("http://a/.htaccess", "html"), ("http://a/x.", "html"), ("http://a/x.tar.gz", "gz"), ("http://a/v1.2", "2"), ("http://a/D.PDF?x=1", "pdf")])
def test_extension(rows, url, ext):
    assert one(rows, url, urls.extension("x")) == ext


def test_domain_and_keys(rows):
    cases = {"http://A.Test:80/": "a.test", "https://a.test:80/": "a.test:80", "http://a.test./": "a.test", "http://u:p@a.test/x": "a.test"}
    got = rows("x string", *[(u,) for u in cases]).select("x", urls.domain("x").alias("d")).collect()
    assert {r.x: r.d for r in got} == cases
    keys = {"HTTP://A.Test:80/x/#f": "http://a.test/x", "http://a.test": "http://a.test/", "http://a.test/?q=1": "http://a.test/?q=1", "http://a.test:99999/x": None, "https://a.test:80/": "https://a.test:80/"}
    got = rows("x string", *[(u,) for u in keys]).select("x", urls.link_key("x").alias("k")).collect()
    assert {r.x: r.k for r in got} == keys
    assert one(rows, "http://www.A.test.:8080/x", urls.site("x")) == "a.test"
    assert one(rows, "no url", urls.site("x")) is None
    assert one(rows, "http://a.test/b/", urls.registry_keys("x")) == ["http://a.test/b", "http://a.test/b/index.html"]


def test_paths(rows):
    q = hashlib.sha1(b"id=1").hexdigest()[:12]
    cases = {"http://a.test/": "a.test/index.html", "http://a.test/about/": "a.test/about/index.html", "http://a.test/x.php?id=1": f"a.test/x__q_{q}.php"}
    got = rows("x string", *[(u,) for u in cases]).select("x", urls.relative_path("x").alias("p")).collect()
    assert {r.x: r.p for r in got} == cases
    names = {"a:b": "a_b", "con": "_con", "con.txt": "_con.txt", "..": "_", "x" * 200: "x" * 120}
    got = rows("x string", *[(n,) for n in names]).select("x", urls.sanitized("x").alias("p")).collect()
    assert {r.x: r.p for r in got} == names


def test_types_by_mime(rows):
    data = rows("u string, m string", ("http://a/download.php", "application/pdf; x"), ("http://a/a.pdf", "text/html"), ("http://a/a.php", "text/html"), ("http://a/a.php", None))
    assert [r.e for r in data.select(urls.document_extension("u", "m").alias("e")).collect()] == ["pdf", "pdf", "php", "php"]


def test_times_and_sizes(rows):
    t = rows("x string", ("20180412093122",), ("bad",), ("201804120930",), (None,))
    got = t.select(times.pretty("x").alias("p"), times.folder("x").alias("f"), times.date_only("x").alias("d")).collect()
    assert tuple(got[0]) == ("2018-04-12 09:31", "2018-04-12_09-31-22", "2018-04-12")
    assert tuple(got[1]) == ("bad", "bad", "0000-00-00")
    sizes = {"0": "0.0 B", "1023": "1023.0 B", "1024": "1.0 KB", "1280": "1.2 KB", "abc": "?"}
    got = rows("x string", *[(s,) for s in sizes]).select("x", values.human_size("x").alias("h")).collect()
    assert {r.x: r.h for r in got} == sizes


def test_hashes_and_phones(rows):
    import base64

    got = rows("x string", ("hello",)).select(values.sha1_base32(F.col("x").cast("binary")).alias("b")).first().b
    assert got == base64.b32encode(hashlib.sha1(b"hello").digest()).decode().lower()
    local = "local_" + hashlib.sha1(b"u|t").hexdigest()
    got = rows("d string", ("-",), ("abc",), (None,), (" ABCDEFGH ",)).select(values.store_digest(F.lit("u"), F.lit("t"), "d").alias("s")).collect()
    assert [r.s for r in got] == [local, local, local, "ABCDEFGH"]
    phones = {"8 (912) 345-67-89": "79123456789", "+1 (663) 555-6869": "16635556869", "8888888888": None}
    got = rows("x string", *[(p,) for p in phones]).select("x", values.clean_phone("x").alias("p"), values.phone_confidence("x").alias("c")).collect()
    assert {r.x: r.p for r in got} == phones
    assert [r.c for r in got] == ["high", "high", "low"]


@settings(max_examples=200, deadline=None)
@given(st.integers(-60_000_000_000, 200_000_000_000))
def test_day_arithmetic_round_trip(seconds):
    days = seconds // 86400
    y, m, d = instants.civil_from_days(days)
    assert instants.days_from_civil(y, m, d) == days


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(2000, 1, 1), datetime(2030, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Sydney"]))
def test_instants_equal_zoneinfo(when, zone):
    when = when.replace(microsecond=0)
    want = when.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y:%m:%d %H:%M:%S", "D:%Y%m%d%H%M%S", "%d.%m.%Y %H:%M:%S", "%a %b %d %H:%M:%S %Y", "%Y%m%d%H%M%S"):
        assert instants.utc_text(when.strftime(form), None, zone) == want


@pytest.mark.parametrize(
    "value,offset,zone,want",
    [
        ("2020-02-30", None, "UTC", None),
        ("07/08/2016 05:48", None, "UTC", None),
        ("05/05/2016 05:48", None, "UTC", "2016-05-05 05:48:00"),
        ("24/07/2020 07:19", None, "UTC", "2020-07-24 07:19:00"),
        ("2/16/2020 6:40:22 PM", None, "UTC", "2020-02-16 18:40:22"),
        ("2010-03-14T02:30:00", None, "America/New_York", "2010-03-14 07:30:00"),  # skipped: offset before the change
        ("2010-11-07T01:30:00", None, "America/New_York", "2010-11-07 05:30:00"),  # twice: the first
        ("1552924015", None, None, "2019-03-18 15:46:55"),
        ("1465917905999", None, None, "2016-06-14 15:25:05"),
        ("2020:01:29 11:12:13", "+02:00", "Asia/Tokyo", "2020-01-29 09:12:13"),
        ("2020-01-29T11:12:13-05:00", "+02:00", "Asia/Tokyo", "2020-01-29 16:12:13"),
        ("2019-01-20 22:53:20 EST", None, "Asia/Tokyo", "2019-01-21 03:53:20"),
        ("2020-01-29 11:12:13", None, "No/Zone", None),
        ("2020-01-29 11:12:13", None, None, None),
        ("D:20200301", None, "UTC", "2020-03-01 00:00:00"),
        ("yesterday", None, "UTC", None), ("", None, "UTC", None), (None, None, "UTC", None),
    ],
)
def test_instants(value, offset, zone, want):
    assert instants.utc_text(value, offset, zone) == want


def test_instants_on_tables(spark, rows):
    t = rows("value string, zone string, utc_second string", ("2020-01-01", "UTC", "clash"), (None, None, None), ("2020-01-01", "UTC", "clash"))
    got = instants.with_utc_second(t, "value", "zone")
    assert [r.utc_second for r in got.collect()] == ["2020-01-01 00:00:00", None, "2020-01-01 00:00:00"]
    assert instants.with_utc_second(t.filter("false"), "value", "zone").count() == 0
    assert instants.utc_text("x" * 1_000_000, None, "UTC") is None
