import gzip
import io
import zipfile

from pyspark.sql import functions as F

from tidemark.content import binary, builders, html


def test_decode():
    assert html.decode("привет".encode("cp1251")) == "привет"
    assert html.decode(b'<meta charset="koi8-r">' + "да".encode("koi8-r")).endswith("да")
    assert html.decode(None) is None and html.decode(b"") == ""
    assert html.with_utf8_meta("<head><meta charset=x></head>") == '<head><meta charset="utf-8"></head>'
    assert html.with_utf8_meta("a") == '<meta charset="utf-8">a'


def test_links_and_rewriting():
    page = '<base href="/q/"><a href="p.html?a=1&amp;b=2">x</a><img srcset="a.png 1x, b.png 2x"><a href=plain.html>y</a><a href="mailto:a@b">m</a><style>b{background:url("c.png")}</style>'
    found = [v for _, _, v in html.read_links(page)]
    assert found == ["p.html?a=1&b=2", "a.png", "b.png", "plain.html", "mailto:a@b"]
    assert html.resolved("http://a.test/d/", "../x") == "http://a.test/x" and html.resolved("http://a.test/", "mailto:x") is None
    out, n = html.rewrite_page(page, lambda v: "new/" + v.split("?")[0] if not v.startswith("b") else None)
    assert n == 4 and "<base" not in out and 'href="new/p.html"' in out and "new/a.png 1x, b.png 2x" in out and 'url("new/c.png")' in out
    css, n = html.rewrite_css("@import 'a.css'; x{b:url(i.png);c:url(data:x)}", lambda v: "z/" + v)
    assert n == 2 and css == "@import 'z/a.css'; x{b:url(z/i.png);c:url(data:x)}"


def test_rewrite_by_join(rows):
    pages = rows("group_id string, url string, path string, html string", ("g", "http://a/d/x.html", "a/d/x.html", '<a href="../y.html">y</a><a href="http://b/">b</a>'), ("g", "http://a/n", "a/n", None))
    known = rows("group_id string, key string, path string", ("g", "http://a/y.html", "a/y.html"))
    got = {r.url: (r.html, r.changed) for r in html.rewrite(pages, known).collect()}
    assert got == {"http://a/d/x.html": ('<meta charset="utf-8"><a href="../y.html">y</a><a href="http://b/">b</a>', 0), "http://a/n": ("", 0)}


def test_documents_round_trip():
    fields = {"Author": "A (x) \\ Мир", "Title": "Überblick", "Company": "C&D"}
    assert binary.pdf_metadata(builders.pdf(fields)) == (fields, None)
    assert binary.pdf_metadata(b"<html>")[1] and binary.pdf_metadata(None)[1]
    assert binary.pdf_metadata(b"%PDF-1.4 /Author (a\\(b\\) (n) \\101) /Title <FEFF0041>")[0] == {"Author": "a(b) (n) A", "Title": "A"}
    office = builders.office({"dc:creator": "Ann & Bob", "dc:title": "T"}, {"Company": "K", "Manager": "M"})
    assert binary.office_metadata(office) == ({"Author": "Ann &amp; Bob", "Title": "T", "Company": "K", "Manager": "M"}, None)
    assert binary.office_metadata(b"PK\x03\x04broken")[1] == "file is damaged" and binary.office_metadata(b"x")[1]


def test_photos_round_trip():
    got = binary.exif(builders.jpeg({0x010F: "Make", 0x9003: "2020:01:01 00:00:00"}, -33.5, 151.25))
    assert got == {"make": "Make", "date_time_original": "2020:01:01 00:00:00", "lat": -33.5, "lon": 151.25}
    assert binary.exif(builders.jpeg({0x010F: "M"})) == {"make": "M"}
    assert binary.exif(b"\xff\xd8\xff\xd9") == {} and binary.exif(None) == {} and binary.exif(b"II*\x00") == {}
    assert binary.degrees([55.0, 45.0, 0.0], "S") == -55.75 and binary.degrees([1.0, 2.0], "N") is None


def test_structure_and_gzip(rows):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    data = [
        ("http://a/x.pdf", None, b"%PDF-1 startxref %%EOF", "OK"), ("http://a/x.pdf", None, b"%PDF-1", "WARNING"), ("http://a/x.pdf", None, b"no", "BROKEN"),
        ("http://a/x.jpg", None, b"\xff\xd8\xff\xd9", "OK"), ("http://a/x", "image/png", b"x", "BROKEN"), ("http://a/x.gif", None, b"GIF89a;", "OK"),
        ("http://a/x.zip", None, z.getvalue(), "OK"), ("http://a/x.docx", None, b"PK", "BROKEN"), ("http://a/", "text/html", b"<!DOCTYPE html>", "OK"), ("http://a/", None, b"text", "WARNING"), ("http://a/x.txt", None, b"", "BROKEN"), ("http://a/x.txt", None, None, "BROKEN"),
    ]
    t = rows("u string, m string, c binary, want string", *data)
    assert all(r.s == r.want for r in t.select("want", binary.structure(F.col("c"), "u", "m").getField("status").alias("s")).collect())
    g = gzip.compress(b"<html>")
    t = rows("u string, m string, c binary", ("http://a/p.html", None, g), ("http://a/p.gz", None, g), ("http://a/p.html", "application/gzip", g), ("http://a/b.html", None, g[:-4]), ("http://a/n", None, None))
    assert [None if r.o is None else bytes(r.o) for r in t.select(binary.unwrapped(F.col("c"), "u", "m").alias("o")).collect()] == [b"<html>", g, g, None, None]


def test_integrity(rows):
    import hashlib

    S = "row_ord bigint, digest string, original_url string, timestamp string, mimetype string, sha256 string"
    sha = hashlib.sha256(b"text").hexdigest()
    caps = rows(S, (1, "okokokok", "http://a/x.txt", "1", None, sha.upper()), (2, "okokokok", "http://a/y.txt", "1", None, None), (3, "badbadbad", "http://a/x.txt", "1", None, "0" * 64), (4, "gonegone", "http://a/z", "1", None, None))
    files = rows("digest string, content binary", ("okokokok", b"text"), ("badbadbad", b"text"))
    got = {r.digest: (r.status, r.appearances) for r in binary.integrity(caps, files).collect()}
    assert got == {"okokokok": ("OK", 2), "badbadbad": ("MODIFIED", 1), "gonegone": ("MISSING", 1)}
