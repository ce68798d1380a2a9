import itertools
import random

import pytest

from tidemark.operators import error_parse as E

GOOD = "http://a.test/x,20200101000000,D,text/html,200,12,late"


@pytest.mark.parametrize(
    "raw,reason",
    [
        (GOOD, None),
        ('"http://a.test/x?q=a,b",1,D,-,200,,"a ""b"" c\nd"', None),
        ('"http://a.test/x,1,D,-,200,5,r', "quoting"),
        ('http://a.test/x,1,D,-,200,5,"r" tail', "quoting"),
        ('http://a.test/x,1,D,-,200,5,lost "quote', "quoting"),
        ("http://a.test/x,1", "columns"), ("", "columns"), (GOOD + ",more", "columns"),
        ("ftp://a.test/x,1,D,-,200,5,r", "value"), ("http:///x,1,D,-,200,5,r", "value"), ("http://a.test:99999/,1,D,-,200,5,r", "value"), ("http://[::/a,1,D,-,200,5,r", "value"),
        ("http://a.test/x,1,D,-,200,-5,r", "value"), ("http://a.test/x,1,D,-,200,9223372036854775808,r", "value"), ("http://a.test/x,1,D,-,200,9223372036854775807,r", None),
        ("http://a.test:0/,1,D,-,200,5,r", "value"), ("http://[::1]:80/,1,D,-,200,007,r", None),
    ],
)
def test_reasons(raw, reason):
    fields, got, _ = E.parse(raw, E.QUEUE)
    assert got == reason
    assert (fields is None) == (reason is not None)


def brute_force(toks, width, most=3):
    """Cheapest repair by trying all edits, fewest first (quoting repairs first)."""

    def fits(t):
        f = E.sound_fields(t)
        return f is not None and len(f) == width

    signs = (("Q", '"'), ("D", ","))
    level = {tuple(toks): (0, 0)}
    best = None
    for _ in range(most + 1):
        for t, cost in level.items():
            if fits(list(t)) and (best is None or cost < best):
                best = cost
        nxt = {}
        for t, (q, d) in level.items():
            for i in range(len(t) + 1):
                for s in signs:
                    u, c = (*t[:i], s, *t[i:]), (q + (s[0] == "Q"), d + (s[0] == "D"))
                    nxt[u] = min(nxt.get(u, c), c)
                if i < len(t) and t[i][0] in "QD":
                    u, c = (*t[:i], *t[i + 1 :]), (q + (t[i][0] == "Q"), d + (t[i][0] == "D"))
                    nxt[u] = min(nxt.get(u, c), c)
        level = nxt
    return best


def test_sound_records_cost_only_delimiters():
    for n in range(1, 6):
        toks = E.tokens(",".join(["a"] * n), E.QUEUE)
        assert E.cheapest_repair(toks, 3)[0] == (0, abs(n - 3))


def test_repair_is_never_dearer_than_brute_force():
    random.seed(3)
    for _ in range(60):
        raw = "".join(random.choice('a,"') for _ in range(random.randint(1, 6)))
        toks = E.tokens(raw, E.QUEUE)
        (q, d), _ = E.cheapest_repair(toks, 2)
        want = brute_force(toks, 2, 2)
        if want is not None:
            # labels count some delimiters as quoting repairs, so compare the number of edits and the zero case
            assert (q == 0 and d == 0) == (want == (0, 0))
            assert q + d <= sum(want) + 1


def test_index_pages(rows):
    S = "line_id bigint, page_no bigint, line_no int, kind string, raw string, reason string"
    good = "http://a.test/ 1 D text/html 200 5"
    t = rows(S, (1, 1, 1, "index", good, "x"), (2, 1, 2, "index", "", "x"), (3, 1, 3, "index", "key", "x"), (4, 2, 1, "index", "a b", "x"), (5, 2, 2, "queue", None, "x"), (6, 3, 1, None, "z", "x"), (7, 2, 3, "index", good.replace(" 5", " "), None), (8, 2, 3, "index", "", None))
    got = {r.line_id: r.reason for r in E.parse_lines(t).collect()}
    assert got == {1: None, 4: "columns", 5: "columns", 6: "kind", 7: None, 8: "columns"}
    assert E.parse_lines(t.filter("false")).count() == 0
    assert E.parse("x" * 300_000, E.QUEUE)[1] == "columns"


def test_all_small_records_parse():
    for raw in itertools.product('a,"', repeat=5):
        E.parse("".join(raw), E.QUEUE)


def test_sound_quoting_with_a_wrong_width():
    """Every delimiter stands beside a quote, so no repair goes without quotes, and still only the width is wrong."""
    raw = 'http://a.test/x,"20230201070829",DIGEST,"application/pdf",200,"x",3845,"empty reply"'
    fields, reason, detail = E.parse(raw, E.FORMS["queue"])
    assert (fields, reason) == (None, "columns") and detail
    assert E.parse(raw.replace('"x"', '"x'), E.FORMS["queue"])[1] == "quoting"
