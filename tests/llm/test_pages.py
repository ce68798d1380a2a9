import pytest

from tidemark.llm import main_body, page_lines, recurrence, residue

PAGE = """We use cookies to count visits. Read the cookie policy or press Accept.
* News
* Contacts
Home > News > How Ada found the map
How Ada found the map
By Ada Lovelace
The map of the old harbour was found on 3 May 2001 with 12 drawings from the museum.
Read also: Older map restored near Town Hall
Background
- register of ships
Nobody at the harbour had counted the ships, although the older tickets were gone.
Most read
Grey ship and the careful mirror of Town
How Bob closed the catalogue at Town
see Map at Harbour
Ships of the year | Harbour | 1,200
The crew of Town copied a narrow list with 20 folders and two older maps.

Share  Tweet  Pin  Print
Tags: map, harbour
Back to top
© 2001 Site. All rights reserved."""


def lines_of(text, recurs=()):
    """main and outside lines of a page whose lines at these numbers recur."""
    looks = recurrence.text_lines(text)
    codes, flags, chars, parts, _ = map(list, zip(*looks))
    return main_body.split_lines(codes, flags, chars, parts, {n - 1 for n in recurs})


def test_main_body():
    main, outside = lines_of(PAGE, (1, 19, 21, 22))
    assert main == [5, 7, 9, 10, 11, 15, 16, 17]
    assert outside == [1, 2, 3, 4, 6, 8, 12, 13, 14, 19, 20, 21, 22]


def test_density_decides(monkeypatch):
    """With one density for all nodes nothing is outside."""
    monkeypatch.setattr(main_body, "density", lambda n, body: 1.0)
    assert lines_of(PAGE, (1, 19, 21, 22))[1] == []


def test_unknown_wordings():
    """Furniture of no listed wording is all link characters where it recurs, and part of the body where it doesn't."""
    page = "Zorps and blips make it hum. Knarf them?\nHow Ada found the map\nThe map of the old harbour was found on 3 May 2001 with 12 drawings from the museum.\nGlimpse\nNobody at the harbour had counted the ships, although the tickets were gone.\nWobble this page onward\nThe keepers of Zorps hold no blame for anything said here."
    assert lines_of(page, (1, 4, 6, 7)) == ([2, 3, 4, 5], [1, 6, 7])
    assert 7 in lines_of(page)[0]


def test_thin_blocks_below_the_article_stay_outside():
    """Lines of an unknown wording don't widen the span if their density is below the bound."""
    article = "How Ada found the map\n" + "\n".join("The map of the old harbour was found on 3 May 2001 with 12 drawings, and nobody at the museum had counted the ships before." for _ in range(4))
    page = article + "\nBack to top\n- Ox\n- Elk\n- Emu"
    assert lines_of(page, (6,)) == ([1, 2, 3, 4, 5], [6, 7, 8, 9])


def test_headline_above_byline_and_link():
    page = "Home > A > The map of Town found again by Ann\nThe map of Town found again by Ann\nBy Ann Lee\nBackground\nMore: Other story about the Town map\nThe crew of Town copied a narrow list with 20 folders.\nBack to top"
    assert lines_of(page, (4, 7)) == ([2, 4, 6], [1, 3, 5, 7])


@pytest.mark.parametrize(
    "line,kind",
    [
        ("", "blank"), ("Error 404", "message"), ("{{ title }}", "message"), ("by %%NAME%%", "message"), ("Lorem ipsum. Lorem ipsum.", "message"), ("asdf asdf asdf dolor viniam elitra.", "message"), ("[body] (ref. A-B)", "message"),
        ("The old template of Town printed {{ title }} on each card until Bob repaired it.", "text"), ("Printers at Town set Lorem ipsum in lead to test a new face.", "text"), ("Lorem ipsum is what the printers of Town set in lead.", "text"),
        ("Posted by Ann Lee on 01.10.2012", "link"), ("Site | Imprint | Privacy | Terms of use", "table"), ("Help", "menu"),
        ("News · Shop · Press", "link"), ("A | B | 3", "table"), ("- one", "list"), ("1. one", "list"), ("Latest from Site", "related_head"), ("Lire aussi : x y", "link"), ("Home / News > Title here", "crumb"), ("What happened next", "title"),
    ],
)
def test_kinds(line, kind):
    assert page_lines.NAMES[page_lines.kind(line)] == kind


def test_masked_lines():
    same = ["The address /a/b does not exist.", "The address /c/d/e does not exist."], ["Page viewed 12 times", "Page viewed 1,300 times"], ["by {{ name }}", "by %%AUTHOR%%"], ["Broken (abc).", "Broken (xyz)."], ["Oops! Oops!", "Oops!"]
    for a, b in same:
        assert page_lines.masked(page_lines.clean(a)) == page_lines.masked(page_lines.clean(b))
    assert page_lines.masked("a map of town") != page_lines.masked("a map of ships")


SITES = "store_path string, site string, html boolean"


def test_residue(rows):
    S = "id bigint, store_path string, text string, messages string"
    found = ["Error 404\nTry a search", "Home > News\n404 - page not found\nTags: a, b", "{{ title }}\n$body$"]
    fine = [PAGE, "Error 404\nThe crew of Town reviewed the page and found it gone in May.", "", None, "Tags: a, b"]
    t = rows(S, *[(i, f"p{i}", x, "x") for i, x in enumerate(found + fine)], (100, None, found[0], "x"))
    sites = rows(SITES, *[(f"p{i}", "s", True) for i in range(5)])
    got = [(r.id, r.residue) for r in residue.residue(t, sites).collect()]
    assert sorted(i for i, r in got if r) == [0, 1, 2, 100] and len(got) == 9
    assert residue.residue(t.filter("false"), sites).count() == 0
    assert residue.residue(t, sites.filter("false")).count() == 9


def test_widespread_lines_are_messages_without_any_rule(rows):
    """A wording no list holds is a message where it stands alone on many sites, and none on one site or beside content."""
    S = "id bigint, store_path string, text string"
    odd = "Gurgle the {} knob before you enter."
    alone = [(i, f"p{i}", odd.format(i)) for i in range(6)]
    content = [(10 + i, f"q{i}", f"The crew number {'abcdefg'[i]} of Town copied a narrow list and two older maps.\nPlease wave at the tower.") for i in range(6)]
    files = rows(S, *alone, *content)
    sites = rows(SITES, *[(f"p{i}", f"s{i}", True) for i in range(6)], *[(f"q{i}", f"s{i}", True) for i in range(6)])
    assert sorted(r.id for r in residue.residue(files, sites).filter("residue").collect()) == [0, 1, 2, 3, 4, 5]
    one_site = rows(SITES, *[(f"p{i}", "s", True) for i in range(6)], *[(f"q{i}", "s", True) for i in range(6)])
    assert residue.residue(files, one_site).filter("residue").count() == 0


def test_pages_and_texts(rows):
    S = "id bigint, store_path string, text string, main string"
    t = rows(S, (1, "a", PAGE, "clash"), (2, "b", None, None), (3, "c", "", None), (4, "d", PAGE, "no html"), (5, "e", "Error 404", None), (6, None, PAGE, None))
    sites = rows(SITES, *[(p, "s", p != "d") for p in "abcde"])
    pages = main_body.html_pages(t, sites)
    got = {r.id: (r.main, r.outside) for r in pages.collect()}
    assert set(got) == {1, 2, 3} and got[2] == ([], []) and got[3] == ([], []) and len(got[1][0]) >= 8
    texts = {r.id: r.main_text for r in main_body.body_text(t, pages).collect()}
    assert "How Ada found the map\nThe map" in texts[1] and not texts[2] and not texts[3]
    assert main_body.html_pages(t.filter("false"), sites).count() == 0


def test_very_long_text():
    long = "The harbour was counted again by the crew of the old ship. " * 20_000
    assert lines_of("Home > A > T\nT\n" + long) == ([2, 3], [1])
