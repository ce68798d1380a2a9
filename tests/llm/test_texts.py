import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import leaks, mixing, mojibake, one_form, repeats

# -- one form --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,form,changed",
    [
        ("Ｆｕｌｌ ﬁle", "full file", True), ("café", "café", True), ("zero​width so­ft", "zerowidth soft", True), ("a b c\td", "a b c d", True),
        ("the phοto wаs", "the photo was", True), ("ѕауѕ the man", "says the man", True), ("Москва и мoре", "москва и море", True),
        ("Δελφίζω came to town", "δελφίζω came to town", False), ("а b and с", "а b and с", False), ("“quoted” – dash — 20°", "“quoted” – dash — 20°", False), ("café größer", "café grösser", False), ("a\r\nb", "a\nb", False), ("", "", False),
    ],
)
def test_one_form(text, form, changed):
    assert one_form.one_form(text) == form
    assert one_form.visible(text)[1] == changed


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_one_form_is_stable(text):
    once = one_form.visible(text)[0]
    assert one_form.visible(once)[0] == once
    assert not one_form.HIDDEN.search(once)


def test_one_form_on_tables(rows):
    t = rows("doc_id bigint, text string, one_form string", (1, "ﬁ", "x"), (2, None, None), (1, "ﬁ", "x"))
    assert [(r.one_form, r.changed) for r in one_form.with_one_form(t).collect()] == [("fi", True), (None, False), ("fi", True)]
    assert one_form.with_one_form(t.filter("false")).count() == 0


# -- encodings -------------------------------------------------------------------------------------------

WRITTEN = ["Café Müller & Söhne", "Société Générale", "Compañía Pequeña", "Завод Стярклимсяд", "Институт Дюнсяны и журнал", "Größerer Katalog – Print", "Как Тосюрпин искал список для Лизедыст"]


@pytest.mark.parametrize("text", WRITTEN + ["JOÃO SILVA", "Çem Öz", "ÅSA BERG", "Caf&eacute; &nbsp;", "АО «Гулкож»", "plain", "Рёбра пёс Сёстры", None, ""])
def test_right_text_stays(text):
    assert mojibake.repair(text) == (False, None)


def sloppy(raw, charset):
    table = mojibake.char_of(charset)
    return "".join(table[b] for b in raw)


@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac_roman"])
@pytest.mark.parametrize("text", WRITTEN)
def test_multibyte_round_trip(text, charset):
    garbled = sloppy(text.encode("utf-8"), charset)
    found, restored = mojibake.repair(garbled)
    assert found
    if charset != "cp866" or not text.isascii():
        assert restored == text


@pytest.mark.parametrize("shown,written", [("latin-1", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866")])
def test_single_byte_round_trip(shown, written):
    for text in WRITTEN[3:5]:
        found, restored = mojibake.repair(sloppy(text.encode(written), shown))
        assert found and restored == text


def test_twice_partly_and_lost():
    twice = sloppy(sloppy("Café Müller".encode(), "cp1252").encode(), "cp1252")
    assert mojibake.repair(twice) == (True, "Café Müller")
    assert mojibake.repair("Cafй Müller") == (True, "Café Müller")
    assert mojibake.repair("Caf� Müller") == (True, None)


def test_garbled_tables(rows):
    S = "meta_id bigint, author string, title string, field string"
    t = rows(S, (1, "CafÃ©", None, "x"), (2, None, "", "x"), (1, "CafÃ©", None, "x"))
    got = [(r.meta_id, r.field, r.garbled, r.restored) for r in mojibake.find_garbled(t, ["author", "title"], "meta_id").collect()]
    assert sorted(got, key=str) == sorted([(1, "author", True, "Café"), (2, "title", False, None), (1, "author", True, "Café")], key=str)
    assert mojibake.find_garbled(t.filter("false"), ["author"], "meta_id").count() == 0


# -- repeated lines --------------------------------------------------------------------------------------


def brute_sequences(texts, support, longest):
    """Frequent runs of neighbouring lines with letters, by source."""
    docs = defaultdict(set)
    for doc, source, text in texts:
        if source is None or text is None:
            continue
        keys = ["".join(c for c in x.upper().lower() if c.isalpha()) for x in text.split("\n")]
        keys = [k for k in keys if k]
        for n in range(1, longest + 1):
            for i in range(len(keys) - n + 1):
                docs[source, tuple(keys[i : i + n])].add(doc)
    return Counter((s, len(k)) for (s, k), d in docs.items() if len(d) >= support)


def test_sequences_equal_brute_force(rows):
    r = random.Random(1)
    texts = [(i, r.choice(["a", "a", "b", None]), r.choice([None, "\n".join(r.choice(["One.", "ONE 2", "Two", "", "3", f"own{chr(97 + i % 26)}{chr(97 + i // 26)}", "Größe", "GRÖSSE"]) for _ in range(r.randint(0, 6)))])) for i in range(120)]
    t = rows("doc bigint, source string, text string, item string", *[(*x, "clash") for x in texts])
    items = repeats.line_hashes(t)
    got = Counter((x.source, x.length) for x in repeats.frequent_sequences(items, 4, 3).collect())
    assert got == brute_sequences(texts, 4, 3)
    cleaned = {x.doc: x.text for x in repeats.remove_repeated(t.select("doc", "source", "text"), 4).collect()}
    assert len(cleaned) == 120 and all("One" not in (cleaned[i] or "") for i, s, x in texts if s == "a" and x)
    assert repeats.frequent_sequences(repeats.line_hashes(t.filter("false")), 4).count() == 0


def test_long_sequences(rows):
    """A six-line footer is reported whole, with all its parts."""
    footer = "\n".join(["alpha", "beta", "", "gamma", "delta", "epsilon", "zeta"])
    t = rows("doc bigint, source string, text string", *[(i, "s", f"own {'x' * i}\n{footer}") for i in range(1, 13)])
    got = Counter((x.length, x.support) for x in repeats.frequent_sequences(repeats.line_hashes(t)).collect())
    assert got == {(n, 12): 7 - n for n in range(1, 7)}


def test_line_key(rows):
    t = rows("doc bigint, source string, text string", *[(i, "s", f"Nr. {i}: Maße\n\n12\nonly{chr(97 + i)}") for i in range(12)], (99, None, "x"))
    got = {(r.doc, r.line_no) for r in repeats.repeated_lines(repeats.line_hashes(t)).collect()}
    assert got == {(i, 1) for i in range(12)}


# -- leaks -----------------------------------------------------------------------------------------------


def test_simhash_equals_brute_force():
    r = np.random.default_rng(1)
    ids = r.integers(0, 2**63, 100, dtype=np.uint64)
    got = leaks.simhashes(ids)
    for i in (0, 40, 88):
        bits = np.unpackbits(ids[i : i + 12].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) * 2 > 12
        assert got[i] == np.packbits(bits).view(np.uint64)[0]
    long = r.integers(0, 2**63, leaks.CHUNK + 50, dtype=np.uint64)
    assert np.array_equal(leaks.simhashes(long)[-20:], leaks.simhashes(long[-31:]))


def test_index_finds_all_within_radius():
    r = np.random.default_rng(2)
    index = leaks.ItemIndex([(1, r.integers(0, 2**63, 60, dtype=np.uint64))])
    h = index.hashes.copy()
    for bits in range(leaks.RADIUS + 1):
        for i in range(len(h)):
            for b in r.choice(64, bits, replace=False):
                h[i] ^= np.uint64(1 << int(b))
        i, j = index.pairs(h)
        assert {(k, k) for k in range(len(h))} <= set(zip(i.tolist(), j.tolist()))
        h = index.hashes.copy()


def words_of(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def test_leaks_equal_brute_force(rows, monkeypatch):
    passages = {i: words_of(i, 40) for i in range(5)}
    r = random.Random(3)
    docs = []
    for d in range(60):
        w, item, n = words_of(1000 + d, 50), r.randrange(5), r.choice([0, 8, 11, 12, 13, 40])
        cut = passages[item][:n] if r.random() < 0.5 else passages[item][-n:] if n else []
        docs.append((d, " ".join([*w[:20], *(x.upper() + "," for x in cut), *w[20:]])))
    want = set()
    for d, t in docs:
        w = t.lower().replace(",", "").split()
        for i, p in passages.items():
            runs = {tuple(p[k : k + 12]) for k in range(29)}
            if any(tuple(w[k : k + 12]) in runs for k in range(len(w) - 11)):
                want.add((d, i))
    t = rows("id bigint, text string, item bigint", *[(*x, 7) for x in docs], (900, None, 1), (901, "", 1), (902, "too short", 1))
    items = rows("item bigint, passage string", *[(i, " ".join(p)) for i, p in passages.items()], (77, None), (78, "short one"))
    results = []
    for limit in (leaks.INDEX_WINDOWS, 300):  # the second takes the items in blocks
        monkeypatch.setattr(leaks, "INDEX_WINDOWS", limit)
        results.append(sorted(map(tuple, leaks.find_leaks(t, items).collect())))
        assert {(r[0], r[1]) for r in results[-1] if r[3] > 0} == want
    assert results[0] == results[1]  # all columns
    assert leaks.find_leaks(t.filter("false"), items).count() == 0
    assert leaks.find_leaks(t, items.filter("false")).count() == 0


def test_windows_with_a_shared_shingle():
    """The sieve keeps exactly the windows that hold a shingle of an item."""
    r = np.random.default_rng(5)
    item, ids = r.integers(0, 2**63, 40, dtype=np.uint64), r.integers(0, 2**63, 120, dtype=np.uint64)
    ids[30:36], ids[80:85], ids[116:] = item[3:9], item[20:25], item[:4]
    index = leaks.ItemIndex([(1, item)])
    have = set(leaks.W.shingles(item).tolist())
    want = [i for i in range(len(ids) - 11) if have & set(leaks.W.shingles(ids[i : i + 12]).tolist())]
    assert index.shared(ids).tolist() == want and len(want) > 10
    assert index.shared(ids[:3]).tolist() == [] and leaks.ItemIndex([]).shared(ids).tolist() == []


def test_recall_of_similar_windows():
    """Against brute force over all pairs of windows; equal ones are found without exception."""
    r = random.Random(11)
    shared = words_of(500, 7)  # passages with a part in common, so that losing it costs little similarity
    items = [(i, leaks.text_words(" ".join([*words_of(i, 20), *shared, *words_of(100 + i, 20)]))) for i in range(8)]
    index = leaks.ItemIndex(items)
    similar = hit = 0
    for _ in range(60):
        ids = r.choice(items)[1].copy()
        ids[r.randrange(len(ids))] = np.uint64(r.getrandbits(63))
        found = set(zip(*(x.tolist() for x in index.pairs(leaks.simhashes(ids)))))
        for p in range(len(ids) - 11):
            y = index.flat[index.start[:, None] + np.arange(12)]
            x = np.repeat(ids[None, p : p + 12], len(y), axis=0)
            for q in np.flatnonzero(index.similarity(leaks.row_shingles(x), leaks.row_shingles(y)) >= leaks.SIMILAR).tolist():
                same = np.array_equal(x[q], y[q])
                assert not same or (p, q) in found
                similar, hit = similar + (not same), hit + (not same and (p, q) in found)
    assert similar > 20 and hit >= 0.9 * similar


def test_weighted_similarity():
    index = leaks.ItemIndex([(i, np.arange(20, dtype=np.uint64) + np.uint64(5 * i)) for i in range(3)])
    count = {}
    for ids in index.words:
        for s in set(leaks.W.shingles(ids).tolist()):
            count[s] = count.get(s, 0) + 1
    weight = lambda g: sum(np.log1p(3 / count[s]) if s in count else np.log1p(3) for s in g)
    x, y = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 99, 98], np.uint64), np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], np.uint64)
    for a, b in ((x, y), (y, y), (np.zeros(12, np.uint64), y), (x, np.zeros(12, np.uint64))):
        s, t = set(leaks.W.shingles(a).tolist()), set(leaks.W.shingles(b).tolist())
        got = index.similarity(leaks.row_shingles(a[None]), leaks.row_shingles(b[None]))[0]
        assert abs(got - weight(s & t) / weight(s | t)) < 1e-12


# -- mixing ----------------------------------------------------------------------------------------------


def brute_mix(docs, targets, budget):
    """Weighted fair queueing one packet at a time, over the same shuffle."""
    sent, out = {s: 0 for s in targets}, []
    for s, finish, i, copy, tokens in sorted(docs, key=lambda x: (x[1], x[0], x[2], x[3])):
        out.append((s, i, copy, tokens))
        sent[s] += tokens
    total, kept = 0, []
    for row in out:
        total += row[3]
        if total > budget:
            break
        kept.append(row)
    return kept


def test_mix(rows, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)  # several buckets
    r = random.Random(1)
    data = [(i, r.choice("aaaaaaab"), r.randint(1, 50)) for i in range(300)] + [(900, "zz", 5), (901, None, 5), (902, "a", 0)]
    docs = rows("id bigint, source string, tokens bigint, share double", *[(*x, 0.5) for x in data])
    targets = rows("source string, target_share double, max_repeat int", ("a", 0.6, 1), ("b", 0.4, 2), ("none", 0.1, 3))
    got = mixing.mix(docs, targets, budget=4000).collect()
    assert [x.total for x in got] == list(np.cumsum([x.tokens for x in got])) and got[-1].total <= 4000
    assert [x.finish for x in got] == sorted(x.finish for x in got)
    uses = Counter(x.id for x in got)
    assert max(uses[x.id] for x in got if x.source == "a") == 1 and max(uses.values()) <= 2
    assert {x.source for x in got} == {"a", "b"}
    # finish times are the running sums of each source by its share
    for s, share in (("a", 0.6), ("b", 0.4)):
        run = [x for x in got if x.source == s]
        assert np.allclose([x.finish for x in run], np.cumsum([x.tokens for x in run]) / share)
    caps = {"a": sum(t for _, s, t in data if s == "a"), "b": 2 * sum(t for _, s, t in data if s == "b")}
    report = {x.source: x for x in mixing.shares(mixing.mix(docs, targets, budget=1000), targets).collect()}
    assert caps["b"] > 400 and abs(report["a"].actual_share - 0.6) < 0.06 and report["none"].tokens == 0
    assert mixing.mix(docs.filter("false"), targets).count() == 0
    again = [(x.id, x.copy) for x in mixing.mix(docs, targets, budget=4000).collect()]
    assert again == [(x.id, x.copy) for x in got]


def test_virtual_end():
    flows = [{"share": 0.5, "cap": 100}, {"share": 0.5, "cap": 1000}]
    assert mixing.virtual_end(flows, 150) == 150 and mixing.virtual_end(flows, 400) == 600 and mixing.virtual_end([], 5) == 0.0


def test_tokens(rows):
    got = mixing.with_tokens(rows("id bigint, text string", (1, "Hello world"), (2, None), (3, ""), (4, "é" * 1000))).collect()
    assert [r.tokens for r in got][:3] == [2, 0, 0] and got[3].tokens > 0
    assert unicodedata.name("é")
