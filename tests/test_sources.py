import hashlib
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.archive import Archive
from tidemark.operators import download
from tidemark.sources import archive_files, capture_index
from tidemark.streaming import updates

LINE = "http://a.test/{} 20200101000000 D{} text/html 200 5"


def transport(url):
    """Two pages, linked by a resume key."""
    if "resumeKey" in url:
        return LINE.format(2, 2)
    return LINE.format(1, 1) + "\nbroken line\n\nkey"


def test_scopes_and_requests():
    assert capture_index.Scope.parse("A.test").match == "domain"
    page = capture_index.Scope.parse("http://a.test/dir")
    assert [s.match for s in page.plan()] == ["exact", "prefix"]
    assert [s.match for s in capture_index.Scope.parse("a.test/x.html").plan()] == ["exact"]
    assert capture_index.Scope("a.test").narrower().narrower().match == "exact"
    url = capture_index.request_url("http://i", capture_index.Scope("a.test", start="2020"))
    assert "matchType=domain" in url and "from=2020" in url and "filter=statuscode%3A200" in url


def test_pages():
    got = [r[0] for rows in capture_index.pages(capture_index.Scope("a.test"), "http://i", transport) for r in rows]
    assert got == ["http://a.test/1", "http://a.test/2"]
    same = lambda url: LINE.format(1, 1) + "\n\nkey"  # noqa: E731 - the key repeats, so the scan ends
    assert len(list(capture_index.pages(capture_index.Scope("a.test"), "http://i", same))) == 2


def test_data_source(spark):
    capture_index.register(spark)
    spark.sparkContext.addPyFile(os.path.abspath(__file__))
    df = spark.read.format("capture_index").options(domain="a.test", endpoint="http://i", transport="test_sources:transport").load()
    assert {r.original for r in capture_index.unique_records(df.filter("statuscode = '200' and timestamp >= '2020'")).collect()} == {"http://a.test/1", "http://a.test/2"}


def flaky(url):
    """The second page never comes."""
    if "resumeKey" in url:
        raise TimeoutError
    return LINE.format(1, 1) + "\n\nkey"


def test_incomplete_scans_are_told(spark):
    capture_index.register(spark)
    spark.sparkContext.addPyFile(os.path.abspath(__file__))
    reader = lambda **more: spark.read.format("capture_index").options(domain="a.test", endpoint="http://i", pause="0", transport="test_sources:flaky", **more).load()
    with pytest.raises(Exception, match="TIMEOUT"):
        reader().collect()
    kept = [(r.original, r.scan_error) for r in reader(partial="keep").filter("statuscode = '200' and timestamp >= '2020'").collect()]
    assert kept == [("http://a.test/1", None), (None, "TIMEOUT")]
    assert capture_index.unique_records(reader(partial="keep")).count() == 1


def test_narrower_scopes_after_time_outs():
    asked = []

    def get(url):
        asked.append(url)
        if "matchType" in url:
            raise TimeoutError("timed out")
        return LINE.format(1, 1)

    rows = [r for page in capture_index.scan(capture_index.Scope("a.test"), "http://i", get, pause=0) for r in page]
    assert len(rows) == 1 and ["matchType=domain" in u for u in asked] == [True, True, False, False, False] and "matchType=host" in asked[2]

    def refused(url):
        raise OSError("refused")

    with pytest.raises(capture_index.ScanError, match="NETWORK"):
        list(capture_index.scan(capture_index.Scope("a.test"), "http://i", refused, pause=0))


def statuses(url):
    assert "filter=" not in url and "from=" not in url
    return "http://a.test/1 20200101000000 404"


def test_status_history(spark):
    capture_index.register(spark)
    spark.sparkContext.addPyFile(os.path.abspath(__file__))
    df = spark.read.format("capture_index").options(domain="a.test", endpoint="http://i", kind="status", start="2021", transport="test_sources:statuses").load()
    assert [(r.original, r.statuscode, r.digest) for r in df.filter("statuscode = '404'").collect()] == [("http://a.test/1", "404", None)]


def test_unique_records_stay_whole(rows):
    R = "original string, timestamp string, digest string, mimetype string, statuscode string, length string, row_ord bigint"
    t = rows(R, ("u", "1", "BBBBBBBB", "text/html", "200", "5", 1), ("u", "1", "AAAAAAAA", "image/png", "404", "9", 2), ("v", "1", None, None, None, None, 3))
    assert sorted(tuple(r)[2:6] for r in capture_index.unique_records(t).filter("original = 'u'").collect()) == [("BBBBBBBB", "text/html", "200", "5")]
    assert [r.original for r in capture_index.unseen_records(t, rows("original string, timestamp string", ("u", "1"))).collect()] == ["v"]


def test_probes_and_waits():
    s = capture_index.Scope("a.test")
    assert len(capture_index.well_known_scopes(s)) == 7 and capture_index.well_known_scopes(s)[0].target == "a.test/robots.txt"
    hosts = [x.target for x in capture_index.subdomain_scopes("a.test", ["X.a.test", "www.a.test", "b.test"], s, 3)]
    assert hosts == ["x.a.test/", "www.a.test/", "mail.a.test/"]
    assert len(capture_index.subdomain_scopes("a.test", [], s, 0)) == 25
    now = datetime(2020, 1, 1, tzinfo=timezone.utc)
    cases = {"5": 5, "9999": 600, "": 30, None: 30, "soon": 30, "Wed, 01 Jan 2020 00:01:00 GMT": 60, "Wed, 01 Jan 2020 05:00:00 GMT": 600, "Tue, 31 Dec 2019 00:00:00 GMT": 1}
    assert {k: capture_index.retry_after(k, now=now) for k in cases} == cases


def test_subdomains(spark, rows):
    text = json.dumps([{"name_value": "*.X.a.test\ny.a.test", "common_name": "a.test"}, {"name_value": "m@a.test", "common_name": "z.b.test"}])
    assert {r.name for r in capture_index.subdomains(spark, rows("json string", (text,)), "a.test").collect()} == {"x.a.test", "y.a.test"}


def test_underscore_tables(spark, tmp_path):
    path = tmp_path / "_database.csv"
    path.write_text('﻿digest,original_url,timestamp,extra\nA,"http://a/?x=1,2",1,z\n', encoding="utf-8")
    got = archive_files.load_table(spark, str(path), ("digest", "original_url", "timestamp", "mimetype")).collect()
    assert [tuple(r) for r in got] == [(1, "A", "http://a/?x=1,2", "1", "")]
    assert archive_files.load_table(spark, str(tmp_path / "none.csv"), ("a",)).count() == 0


def get(url):
    if url.endswith("bad"):
        raise OSError("refused")
    return url.encode()


def test_archive_update_and_verify(spark, rows, tmp_path):
    (tmp_path / "_store").mkdir()
    a = Archive(spark, str(tmp_path))
    index = rows("original_url string, timestamp string, digest string, mimetype string, statuscode string", ("http://a/1.txt", "1", "-", "text/plain", "200"), ("http://a/bad", "1", "BBBBBBBB", "text/html", "200"))
    new, queue = a.update(index, lambda u: get(u) if not u.endswith("bad") else b"", "2024-01-01 00:00")
    assert new.count() == 1 and [r.reason for r in queue.collect()] == ["[PERMANENT] server returned an empty file"]
    assert a.captures().count() == 1 and a.failures().count() == 1
    again, _ = a.update(index, get, "2024-01-02 00:00")
    assert {r.original_url for r in again.collect()} == set()
    assert a.reports()["totals"].first().capture_count == 1


def test_download_once_per_digest(spark, rows, tmp_path):
    wanted = rows("original_url string, timestamp string, digest string", ("http://a/1", "1", "AAAAAAAA"), ("http://a/2", "2", "AAAAAAAA"), ("http://a/bad", "1", "CCCCCCCC"))
    got = {r.original_url: (r.sha256 is not None, r.reason) for r in download.download(wanted, str(tmp_path), get).collect()}
    assert got["http://a/1"] == got["http://a/2"] == (True, None)
    assert got["http://a/bad"] == (False, "OSError: refused")


class Answer(Exception):
    def __init__(self, code):
        self.code, self.reason, self.headers = code, "no", {"Retry-After": "0"}


def test_downloads_are_checked(tmp_path):
    name = download.sha1_name(hashlib.sha1(b"right").digest())
    path = str(tmp_path / "s" / name)
    assert download.fetch_one("u", path, name, lambda u: b"wrong", pause=0) == (None, 0, "SHA-1 digest mismatch")
    assert not os.path.exists(path) and not os.listdir(tmp_path / "s")
    assert download.fetch_one("u", path, name, lambda u: iter([b"ri", b"ght"]), pause=0)[1:] == (5, None)
    assert download.sound_blob(path, name, None)[1] == 5 and download.sound_blob(path, name, "other") is None
    tries = []

    def busy(url):
        tries.append(url)
        raise Answer(429 if len(tries) < 6 else 404)

    assert download.fetch_one("u", path, name, busy, attempts=3, pause=0) == (None, 0, "HTTP Error 404: no") and len(tries) == 6
    tries.clear()

    def gone(url):
        tries.append(url)
        raise Answer(410)

    download.fetch_one("u", path, name, gone, pause=0)
    assert len(tries) == 1


def test_sound_blobs_are_not_fetched_again(spark, rows, tmp_path):
    name = download.sha1_name(hashlib.sha1(b"right").digest())
    wanted = rows("original_url string, timestamp string, digest string", ("http://a/1", "1", name))
    first = download.download(wanted, str(tmp_path), lambda u: b"right").first()
    again = download.download(wanted, str(tmp_path), lambda u: b"never used").first()
    assert (first.reused, again.reused, again.sha256) == (False, True, first.sha256)
    with open(first.store_path, "wb") as f:
        f.write(b"damaged")
    assert download.download(wanted, str(tmp_path), lambda u: b"right").first().reused is False


def test_new_captures_come_after_old_ones(spark, rows, tmp_path):
    (tmp_path / "_store").mkdir()
    a = Archive(spark, str(tmp_path))
    I = "original_url string, timestamp string, digest string, mimetype string, statuscode string"
    a.update(rows(I, ("http://a/old1", "1", "-", "", "200"), ("http://a/old2", "1", "-", "", "200")), lambda u: u.encode(), "t1")
    a.update(rows(I, ("http://a/new1", "1", "-", "", "200"), ("http://a/new2", "1", "-", "", "200")), lambda u: u.encode(), "t2")
    order = [r.original_url[9:12] for r in a.captures().orderBy("row_ord").collect()]
    assert order == ["old", "old", "new", "new"]


def test_retry_and_repair(spark, rows, tmp_path):
    (tmp_path / "_store").mkdir()
    a = Archive(spark, str(tmp_path))
    I = "original_url string, timestamp string, digest string, mimetype string, statuscode string"
    name = download.sha1_name(hashlib.sha1(b"right").digest())

    def down(url):
        raise OSError("down")

    _, queue = a.update(rows(I, ("http://a/1", "1", name, "", "200")), down, "t", pause=0)
    assert queue.count() == 1
    new, queue = a.retry_failed(lambda u: b"right", "t")
    assert new.count() == 1 and queue.count() == 0 and a.failures().count() == 0
    text = (tmp_path / "_database.csv").read_text(encoding="utf-8-sig").replace(new.first().sha256, "")
    (tmp_path / "_database.csv").write_text(text, encoding="utf-8-sig")
    assert [r.sha256 for r in a.repair_metadata().collect()] == [new.first().sha256] and a.captures().first().sha256 == new.first().sha256
    assert archive_files.archive_domain(a.captures()) == "a" and archive_files.read_manifest(str(tmp_path / "none")) == {}


def test_views_are_unpacked(spark, rows, tmp_path):
    import gzip

    (tmp_path / "s" / "ab").mkdir(parents=True)
    (tmp_path / "s" / "ab" / "abz").write_bytes(gzip.compress(b"page"))
    view = rows("digest string, rel_path string, wrapped boolean", ("abz", "x/p.html", True), ("abz", "x/p.gz", False), ("none", "x/q", False))
    got = {r.rel_path: r.written for r in archive_files.materialize(view, str(tmp_path / "s"), str(tmp_path / "v")).collect()}
    assert got == {"x/p.html": True, "x/p.gz": True, "x/q": False} and (tmp_path / "v" / "x" / "p.html").read_bytes() == b"page"


def test_manifest(spark, rows, tmp_path):
    path = str(tmp_path / "MANIFEST.json")
    archive_files.save_manifest(rows("n bigint", (1,)), path, {"archive_created": "a"})
    assert archive_files.save_manifest(rows("n bigint", (2,)), path, {"archive_created": "b"}) == {"schema_version": 2, "archive_created": "a", "n": 2}


def test_stream(spark, rows, tmp_path):
    S = updates.RAW
    source, root = str(tmp_path / "in"), str(tmp_path / "t")
    rows(S, (1, 1, 1, "index", LINE.format(1, 1)), (2, 1, 2, "index", "bad"), (5, 1, 3, "index", LINE.format(7, 7))).coalesce(1).write.mode("append").parquet(source)
    table = updates.BucketTable(spark, root, ("original", "timestamp"), 4)
    assert table.read() is None
    failed = rows("original_url string, timestamp string, digest string, reason string", ("http://a.test/7", "20200101000000", "d7", "HTTP Error 404: gone"))
    for i in range(4):
        updates.stream_update(spark, source, table, str(tmp_path / "c"), failures=failed).awaitTermination()
        rows(S, (3 + i, 2, 1, "index", LINE.format(1, 9)), (4 + i, 2, 2, "index", LINE.format(2, 2))).coalesce(1).write.mode("append").parquet(source)
    assert {(r.original, r.digest) for r in table.read().collect()} == {("http://a.test/1", "D9"), ("http://a.test/2", "D2")}
    held = updates.BucketTable(spark, root, ("original", "timestamp"), 99)
    assert held.read().count() == 2 and held.buckets == 4 and len(held._lists()) == 2
    ev = rows("ts timestamp, event_type string").select(F.col("ts"), F.col("event_type"))
    assert updates.windowed_status(ev).count() == 0


def test_a_write_touches_only_its_buckets(spark, rows, tmp_path):
    R = "row_ord bigint, k string, v string"
    table = updates.BucketTable(spark, str(tmp_path / "t"), ("k",), 8)
    table.upsert(rows(R, *[(i, f"k{i}", "old") for i in range(40)]))
    before = table.placed()
    table.upsert(rows(R, (100, "k3", "new")))
    assert sum(before[b] != n for b, n in table.placed().items()) == 1
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 40 and got["k3"] == "new" and got["k4"] == "old"
    table.upsert(rows(R))
    assert table.version() == 2
