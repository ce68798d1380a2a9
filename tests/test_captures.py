import random

from pyspark.sql import functions as F

from tidemark.operators import captures as C

S = "row_ord bigint, digest string, original_url string, timestamp string, mimetype string, statuscode string, size_bytes string, sha256 string, store_path string, first_seen string"


def cap(i, d, u, t, size="1", mime="text/html", sha=None):
    return (i, d, u, t, mime, "200", size, sha, f"_store/{d}", None)


def test_first_row_wins_and_order_of_rows_does_not_matter(rows):
    data = [cap(1, "A", "u1", "2"), cap(2, "A", "u2", "1"), cap(3, None, "u3", "1"), cap(4, None, "u4", "1")]
    for _ in range(3):
        random.shuffle(data)
        assert {(r.digest, r.row_ord) for r in C.dedup_by_digest(rows(S, *data)).collect()} == {("A", 1), (None, 3)}
    assert C.dedup_by_digest(rows(S)).count() == 0


def test_upsert_is_idempotent(rows):
    old, new = rows(S, cap(1, "A", "u", "1"), cap(2, "B", "v", "1")), rows(S, cap(1, "C", "u", "1"), cap(2, "D", "u", "1"), cap(3, "E", "w", "1"))
    once = C.upsert(old, new)
    got = {(r.original_url, r.digest) for r in once.collect()}
    assert got == {("u", "D"), ("v", "B"), ("w", "E")}
    assert {(r.original_url, r.digest) for r in C.upsert(once, new).collect()} == got


def test_timeline_and_totals(rows):
    t = rows(S, cap(1, "A", "u", "2", "10"), cap(2, "B", "u", "1", " 7 "), cap(3, "A", "v", "1", "x"), cap(4, "A", "u", "2", "99"))
    got = {r.original_url: (r.versions, r.first, r.last, r.first_size, r.last_size) for r in C.timeline(t).collect()}
    assert got == {"u": (3, "1", "2", 7, 10), "v": (1, "1", "1", 0, 0)}
    assert tuple(C.totals(t).first()) == (4, 2, 109, 10)
    assert tuple(C.totals(rows(S)).first()) == (0, 0, 0, 0)


def test_removed(rows):
    H = "original string, timestamp string, statuscode string"
    t = rows(H, ("a", "1", "200"), ("a", "2", "404"), ("b", "1", "404"), ("b", "2", "200"), ("c", "1", "200"), ("c", "2", "301"), ("d", "1", "404"), ("d", "2", "500"))
    assert [r.original for r in C.removed(t).collect()] == ["a"]


def test_failures(rows):
    cases = {"HTTP Error 404: Not Found": True, "HTTP Error 429: x": False, "HTTP Error 408: x": False, "timed out": False, " [PERMANENT] x": True, "SHA-1 digest mismatch": True}
    got = rows("r string", *[(c,) for c in cases], (None,)).select("r", C.is_permanent(F.col("r")).alias("p"), C.marked_reason(F.col("r")).alias("m")).collect()
    assert {r.r: r.p for r in got if r.r} == cases
    assert {r.r: r.m for r in got}["HTTP Error 404: Not Found"] == "[PERMANENT] HTTP Error 404: Not Found"
    assert {r.r: r.m for r in got}[" [PERMANENT] x"] == " [PERMANENT] x"


def test_to_fetch(rows):
    I = "original_url string, timestamp string, digest string"
    caps = rows(S, cap(1, "A", "u", "1", sha="s1"), cap(2, "B", "v", "1"))
    good = rows("store_path string", ("_store/A",))
    failed = rows("original_url string, timestamp string, digest string, reason string", ("w", "1", "x ", "HTTP Error 404: gone"))
    got = C.to_fetch(rows(I, ("u", "1", "A"), ("v", "1", "B"), ("u", "2", "A"), ("w", "1", "X")), caps, good, failed)
    assert {(r.original_url, r.timestamp, r.repair, r.expected_sha256) for r in got.collect()} == {("v", "1", True, None), ("u", "2", False, "s1")}


def test_collisions_and_views(rows):
    t = rows(S, cap(1, "AAAAAAAAAA", "http://a.test/x.pdf", "20200101000000"), cap(2, "BBBBBBBBBB", "http://a.test/y/x.pdf", "20200101000001"), cap(3, "AAAAAAAAAA", "http://a.test/z/X.PDF", "20200101000002"))
    got = {r.row_ord: r.destination for r in C.destinations(t).collect()}
    assert got == {1: "2020-01-01_x.pdf", 2: "2020-01-01_x_BBBBBB.pdf", 3: "2020-01-01_X.PDF"}
    late = C.latest_site(rows(S, cap(1, "A", "http://a.test/p", "1"), cap(2, "B", "http://a.test/p/", "2"), cap(3, "C", "http://a.test/p/", "2"))).collect()
    assert [(r.rel_path, r.row_ord) for r in late] == [("a.test/p/index.html", 2)]


def test_graph(rows):
    links = rows("group_id string, source string, target string", ("g", "http://a/1", "http://a/2#x"), ("g", "http://a/1", "http://a/2"), ("g", "http://a/3", "http://b/"), ("h", "http://a/1", "http://a/2"))
    reg = rows("group_id string, url string", ("g", "http://a/2/"))
    g = C.edges(links, reg)
    assert sorted((r.group_id, r.is_internal) for r in g.collect()) == [("g", False), ("g", True), ("g", True), ("h", False)]
    assert {r.target: r.sources for r in C.most_linked(g).collect()} == {"http://a/2": 1, "http://a/2#x": 1}
    assert [r.url for r in C.isolated(rows("url string", ("http://a/2",), ("http://z/",)), g).collect()] == ["http://z/"]


def test_contacts(rows):
    texts = rows("store_path string, text string", ("p", "Call 8 (912) 345-67-89 or 89123456789, a@b.test X@EXAMPLE.com https://t.me/x/"), ("q", None))
    where = rows("store_path string, source string", ("p", "u1"), ("p", "u2"), ("p", "u2"))
    got = {(r.type, r.value): (r.confidence, r.pages) for r in C.contacts(texts, where).collect()}
    assert got == {("phone", "79123456789"): ("high", 2), ("email", "a@b.test"): (None, 2), ("Telegram", "https://t.me/x"): (None, 2)}


def test_robots_and_sitemaps(rows):
    t = rows("source string, text string", ("r", "user-agent: *\nDISALLOW: /a\nAllow: /b\r\nSitemap: http://s/\n"), ("s", "<loc> http://a/1 </loc><LOC>http://a/2</LOC>"))
    assert {(r.rule, r.value) for r in C.robots_rules(t).collect()} == {("disallow", "/a"), ("allow", "/b"), ("sitemap", "http://s/")}
    assert {r.url for r in C.missing_from(C.sitemap_urls(t), rows("url string", ("http://a/1/",))).collect()} == {"http://a/2"}
