import hashlib

from tidemark.archive import Archive
from tidemark.content import builders
from tidemark.operators import captures as C
from tidemark.operators import download, reports

S = "row_ord bigint, digest string, original_url string, timestamp string, mimetype string, statuscode string, size_bytes string, sha256 string, store_path string, first_seen string"


def cap(i, d, u, t, size="1"):
    return (i, d, u, t, "text/html", "200", size, None, f"_store/{d}", None)


def test_timeline_and_single(rows):
    t = rows(S, cap(1, "A", "u", "20200101000000", "2048"), cap(2, "B", "u", "20210101000000", "1024"), cap(3, "C", "v", "x", "?"))
    text = list(reports.timeline(t))
    assert text[1] == "Unique URLs: 2" and text[4:9] == ["u", "  versions: 2", "  first: 2020-01-01 00:00 (2.0 KB)", "  latest: 2021-01-01 00:00 (1.0 KB)", "  size change: -1.0 KB"]
    assert list(reports.single_captures(t))[-1] == "x (0.0 B) v"
    assert list(reports.timeline(rows(S)))[1] == "Unique URLs: 0"


def test_removed_and_links(rows):
    h = rows("original string, timestamp string, statuscode string", ("a", "1", "200"), ("a", "2", "404"))
    assert "  unavailable (404) since: 2" in list(reports.removed_pages(h))
    g = rows("group_id string, source string, target string, is_internal boolean", ("g", "p", "q", True), ("g", "p", "http://x.test/", False))
    text = list(reports.link_graph(g, rows("url string", *[(f"u{i:03}",) for i in range(102)]), rows("url string", ("q",))))
    assert "     1 q" in text and "  ... and 2 more" in text and "DOCUMENTS WITHOUT INCOMING LINKS (0):" in text and "     1 x.test" in text


def test_contacts(rows):
    texts = rows("store_path string, text string, addresses array<string>", ("p", "a@b.test", ["mailto:C@d.test?x=1", "TEL:8 912 345 67 89", "https://t.me/x/", "http://z/"]), ("n", None, None))
    found = C.contacts(texts, rows("store_path string, source string", ("p", "u @ 1"), ("p", "v @ 1")))
    text = list(reports.contacts(found))
    assert text[:3] == ["EMAIL (2):", "  a@b.test (on 2 pages)", "  c@d.test (on 2 pages)"] and "  +79123456789 (on 2 pages)" in text and text[-2:] == ["--- Telegram ---", "  https://t.me/x (on 2 pages)"]
    assert list(reports.contacts_table(found))[-1] == "network:Telegram,https://t.me/x,high,2,u @ 1"
    assert [tuple(r) for r in C.by_network(found).collect()] == [("Telegram", 1, 2)]


def test_site_lists_and_integrity(rows):
    text = list(reports.site_lists(rows("url string", ("http://a/1",), ("http://a/2",)), rows("source string, rule string, value string", ("r", "sitemap", "http://a/s"), ("r", "disallow", "/x")), rows("url string", ("http://a/1/",))))
    assert "Not captured: 1" in text and "  http://a/s" in text and "  /x" in text
    checked = rows("digest string, status string, detail string, appearances bigint", ("A", "OK", "", 2), ("B", "MISSING", "", 1))
    assert "MISSING: 1 files, 1 captures" in list(reports.integrity(checked))


def test_photos(rows):
    t = rows(S, cap(1, "A", "http://a/p.jpg", "1"), cap(2, "A", "http://a/q.jpg", "1"), cap(3, "B", "http://a/r.jpg", "1"))
    E = "digest string, make string, model string, software string, date_time string, date_time_original string, lat double, lon double"
    text = list(reports.photos(t, rows(E, ("A", "Cam", None, None, None, None, 1.5, 2.0), ("B", None, None, None, None, None, None, None))))
    assert text[1:3] == ["With metadata: 2 of 3", "With a position: 2"] and "    make: Cam" in text


def test_written_reports(spark, rows, tmp_path):
    (tmp_path / "_store").mkdir()
    pdf = builders.pdf({"Author": "Ann", "Company": "Town"})
    name = download.sha1_name(hashlib.sha1(pdf).digest())
    a = Archive(spark, str(tmp_path))
    a.update(rows("original_url string, timestamp string, digest string, mimetype string, statuscode string", ("http://a.test/f.pdf", "20200101000000", name, "application/pdf", "200")), lambda u: pdf, "t")
    paths = a.write_reports()
    read = {p.rsplit("/", 1)[1]: open(p, encoding="utf-8").read() for p in paths}
    assert "  Ann (in 1 documents)" in read["documents.txt"] and "http://a.test/f.pdf" in read["index.html"] and "reports/timeline.txt" in read["index.html"]
    assert "OK: 1 files, 1 captures" in read["integrity.txt"] and read["documents.csv"].splitlines()[1].startswith("http://a.test/f.pdf,20200101000000,Ann")
    assert reports.relative_link("/a/b", "/a/c d/x") == "../c%20d/x" and reports.entry_page(str(tmp_path), "h") == str(tmp_path / "index.html")
