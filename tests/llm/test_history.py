import random

import numpy as np
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.llm import history
from tidemark.llm import words as W

C = "digest string, sha256 string, store_path string, clash string"
I = "arrival_id bigint, batch_no int, digest string, sha256 string, store_path string, seen string"
B = "blob_id bigint, store_path string, body string, words int"


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def edited(t, share, seed):
    r, w = random.Random(seed), t.split()
    for i in r.sample(range(len(w)), int(len(w) * share)):
        w[i] = r.choice(["", f"new{i}", f"{w[i]} more"])
    return " ".join(w)


def verdicts(spark, caps, inc, blobs):
    out = history.dedup_batches(caps, inc, blobs, runtime.new_dir(spark, "t"))
    return {r.arrival_id: r.reason for r in out.collect()}


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_equals_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 9))] for _ in range(2))
        d = brute_distance(a, b)
        for limit in range(10):
            assert W.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), limit) == (d if d <= limit else None)


def test_identifiers_and_texts(spark, rows):
    t = text(1)
    caps = rows(C, ("SHA1:ABCDEFGHIJ", "AA" * 32, "p1", "x"), ("-", None, None, "x"), (None, None, "p1", None))
    blobs = rows(B, (1, "p1", t, 0), (2, "p2", edited(t, 0.06, 2), 0), (3, "p3", t.upper().replace(" ", ", "), 0), (4, "p4", edited(t, 0.3, 3), 0), (5, "p5", text(9), 0), (6, "p6", "", 0), (7, "p7", None, 0), (8, "p8", "", 0), (9, "p9", text(9), 0))
    inc = rows(
        I,
        (1, 1, " abcdefghij ", None, None, "s"), (2, 1, "-", "aa" * 32, None, "s"), (3, 1, "-", None, "p2", "s"), (4, 1, "?", None, "p3", "s"), (5, 1, "", None, "p4", "s"),
        (6, 2, None, None, "p5", "s"), (7, 2, None, None, "p6", "s"), (8, 2, None, None, "p7", "s"), (9, 2, "-", None, "p8", None), (10, 3, "-", None, "p9", None), (11, None, "NEWDIGEST1", None, None, None), (12, 3, "newdigest1", None, None, None), (13, 1, None, None, None, None),
    )
    got = verdicts(spark, caps, inc, blobs)
    assert got == {1: "identifier", 2: "identifier", 3: "near", 4: "body", 5: None, 6: None, 7: None, 8: None, 9: None, 10: "body", 11: "identifier", 12: None, 13: None}


def test_within_a_batch_the_earlier_counts(spark, rows):
    t = text(4)
    blobs = rows(B, (1, "p1", t, 0), (2, "p2", edited(t, 0.05, 1), 0))
    inc = rows(I, (2, 1, None, None, "p2", None), (1, 1, None, None, "p1", None), (3, 2, None, None, "p1", None))
    assert verdicts(spark, rows(C), inc, blobs) == {1: None, 2: "near", 3: "body"}


def test_empty_tables(spark, rows):
    assert verdicts(spark, rows(C), rows(I), rows(B)) == {}
    assert verdicts(spark, rows(C), rows(I, (1, 1, "ABCDEFGHIJ", None, "p", None)), rows(B)) == {1: None}


def test_recall_against_brute_force(spark, rows):
    """Near copies at up to a tenth of the words are found, short and sparse bodies included."""
    r = random.Random(7)
    base = [text(100 + i, r.choice([12, 25, 60, 150, 400])) for i in range(80)]
    copies = [edited(b, r.choice([0.0, 0.03, 0.07, 0.09]), i) for i, b in enumerate(base)]
    blobs = rows(B, *[(i, f"h{i}", b, 0) for i, b in enumerate(base)], *[(1000 + i, f"n{i}", c, 0) for i, c in enumerate(copies)])
    caps = rows(C, *[(None, None, f"h{i}", None) for i in range(80)])
    inc = rows(I, *[(i, 1 + i % 3, None, None, f"n{i}", None) for i in range(80)])
    found = {k for k, v in verdicts(spark, caps, inc, blobs).items() if v}
    want = set()
    for i, (b, c) in enumerate(zip(base, copies)):
        x, y = W.word_ids(b), W.word_ids(c)
        if W.edits_within(x, y, max(len(x), len(y)) // 10) is not None:
            want.add(i)
    assert len(want) > 60 and found == want


def test_every_near_copy_shares_enough_windows():
    """For bodies of all lengths: at most one window is lost an edit, and there are more windows than edits."""
    r = random.Random(3)
    for n in [*range(1, 80), 120, 300]:
        for _ in range(12):
            body = np.array([r.getrandbits(63) for _ in range(n)], np.uint64)
            copy = body.tolist()
            for _ in range(r.randint(0, (n + n // 9) // 10)):
                at, how = r.randrange(len(copy)) if copy else 0, r.randrange(3)
                if how == 0 and copy:
                    copy[at] = r.getrandbits(63)
                elif how == 1 and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, r.getrandbits(63))
            copy = np.array(copy, np.uint64)
            limit = max(n, len(copy)) // 10
            if W.edits_within(body, copy, limit) is None:
                continue
            w = history.window_width(n)
            kept = set(W.shingles(body, w)[::w].tolist())
            m = len(copy)
            widths = {history.window_width(k) for k in range(m - m // 9 - 1, m + m // 9 + 2) if k > 0}
            asked = {x for k in widths for x in W.shingles(copy, k).tolist()}
            assert w in widths and len(kept) > limit and len(kept & asked) >= len(kept) - limit


def test_hot_body(spark, rows):
    """A third of all files hold one body and one furniture line; the common windows are left out, nothing is lost."""
    hot, foot = text(1, 80), text(2, 30)
    bodies = [hot] * 200 + [text(1000 + i, 70) + " " + foot for i in range(400)]
    blobs = rows(B, *[(i, f"h{i}", b, 0) for i, b in enumerate(bodies)], (9001, "n1", hot, 0), (9002, "n2", edited(bodies[300], 0.05, 3), 0), (9003, "n3", text(77, 70) + " " + foot, 0))
    caps = rows(C, *[(None, None, f"h{i}", None) for i in range(600)])
    inc = rows(I, (1, 1, None, None, "n1", None), (2, 1, None, None, "n2", None), (3, 1, None, None, "n3", None))
    assert verdicts(spark, caps, inc, blobs) == {1: "body", 2: "near", 3: None}


def test_family_of_near_copies(spark, rows):
    """A third of the bodies are near copies of one: their shared windows are all common, and still they are found."""
    base = text(1, 420).split()

    def replaced(share, seed):
        spots = random.Random(seed).sample(range(len(base)), int(len(base) * share))
        return " ".join(f"new{seed}x{i}" if i in spots else w for i, w in enumerate(base))

    family = [replaced([0.05, 0.05, 0.07, 0.09][i % 4], 50 + i) for i in range(120)]
    news = [replaced([0.04, 0.045, 0.05, 0.09][i % 4], 500 + i) for i in range(16)]
    bodies = family + [text(3000 + i, 400) for i in range(240)]
    blobs = rows(B, *[(i, f"h{i}", b, 0) for i, b in enumerate(bodies)], *[(5000 + i, f"n{i}", b, 0) for i, b in enumerate(news)], (6000, "far", replaced(0.3, 9), 0))
    caps = rows(C, *[(None, None, f"h{i}", None) for i in range(len(bodies))])
    inc = rows(I, *[(i, 1, None, None, f"n{i}", None) for i in range(16)], (99, 1, None, None, "far", None))
    ids = [W.word_ids(b) for b in family + news]
    near = [any(W.edits_within(ids[120 + i], y, max(len(ids[120 + i]), len(y)) // 10) is not None for y in ids[: 120 + i]) for i in range(16)]
    assert sum(near) > 8
    assert verdicts(spark, caps, inc, blobs) == {**{i: "near" if n else None for i, n in enumerate(near)}, 99: None}


def test_common_windows_by_a_fixed_number(spark):
    """Pairs would grow with the square of the bodies if a window of a share of all bodies still counted as rare."""
    shared = [F.xxhash64(F.lit("shared"), (F.col("id") / 60).cast("int"))]
    fps = F.array(*[F.xxhash64("id", F.lit(i)) for i in range(12)], *shared)
    some = F.struct(*[F.col("id").alias(f"s{i}") for i in range(8)]).alias("sketch")
    bodies = spark.range(40_000).select(F.col("id").cast("string").alias("body"), F.lit(90).alias("words"), some, fps.alias("fps"), F.col("id").alias("text_id"), F.expr("struct(-1 AS batch, 0L AS id)").alias("seen"))
    store = history.HistoryStore(spark, runtime.new_dir(spark, "t"), spark.createDataFrame([], "text_id bigint, text string"))
    store.load(spark.createDataFrame([], "fp bigint, check bigint, seen struct<batch:int,id:bigint>"), bodies)
    assert store.prints().groupBy("fp").count().agg(F.max("count")).first()[0] <= 50
    assert store.prints().count() == 40_000 * 12 + 40  # the last group has 40 bodies only


def test_thin_bodies_keep_their_rarest_common_windows():
    rare, common = np.arange(100, 104), np.array([7, 5, 9, 3, 1, 8, 2])  # the most frequent first
    fps = [np.sort(np.concatenate((rare, common))), np.arange(100, 112), common[:2]]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([60, 60, 60], pa.int32()), history._lists(fps)], ["words", "fps"])
    out = next(history.narrow(iter([batch]), common)).to_pylist()
    assert [(set(r["fps"]), set(r["hot"]), r["kept"]) for r in out] == [({*rare}, {8, 2, 1}, 7), ({*range(100, 112)}, set(), 12), (set(), {7, 5}, 2)]


def test_an_edit_turns_two_parities_at_most():
    r = random.Random(11)
    for n in (1, 9, 40, 300):
        for _ in range(30):
            body = [r.getrandbits(64) for _ in range(n)]
            copy = list(body)
            for _ in range(r.randint(0, 6)):
                at, how = r.randrange(len(copy) + 1), r.randrange(3)
                copy[at : at + (how > 0)] = [r.getrandbits(64)] * (how < 2)
            a, b = (history.sketch(np.array(x, np.uint64)).view(np.uint64) for x in (body, copy))
            assert sum(int(x).bit_count() for x in a ^ b) <= 2 * brute_distance(body, copy)


def test_remembered_words_stay_few():
    """Workers keep them beside the groups of later stages: a million took an executor over its memory on large tables."""
    ids = W.WordIds()
    some = [ids[f"word{i}"] for i in range(250_000)]
    assert len(ids) <= 100_001 and [ids[f"word{i}"] for i in range(50)] == some[:50]


def test_store_used_again(spark, rows, monkeypatch):
    """A second call opens the store as it was written, parts included, and reads no captures."""
    path, old = runtime.new_dir(spark, "again"), [text(i, 80) for i in range(40)]
    blobs = rows(B, *[(i, f"h{i}", b, 0) for i, b in enumerate(old)], *[(100 + i, f"n{i}", edited(b, 0.05, i), 0) for i, b in enumerate(old)], (200, "x", text(99), 0), (201, "y", edited(text(99), 0.05, 1), 0))
    caps = rows(C, *[(f"DIGEST-{i:04}", None, f"h{i}", None) for i in range(40)])
    monkeypatch.setattr(history, "LEAST_PARTS", 31)
    first = history.dedup_batches(caps, rows(I, (1, 3, None, None, "x", None), (2, 4, "digest-0007", None, None, None)), blobs, path)
    monkeypatch.undo()
    assert history.HistoryStore(spark, path, blobs).partitions == 31
    store = history.HistoryStore(spark, path, blobs)
    before = {r[0]: r[1] for r in store.keys().groupBy("gen").count().collect()}
    store.compact()  # nothing is lost, all is one generation, and a store opened later knows
    opened = history.HistoryStore(spark, path, blobs)
    assert len(before) > 1 and opened.last == store.last and opened.base == "base1" and [r.gen for r in opened.blooms().select("gen").distinct().collect()] == [store.last]
    again = rows(I, *[(i, 1, None, None, f"n{i}", None) for i in range(40)], (50, 1, None, None, "y", None), (51, 2, "digest-0008", None, None, None), (52, 2, "newdigest1", None, None, None))
    got = {r.arrival_id: r.reason for r in history.dedup_batches(rows(C), again, blobs, path).collect()}
    assert got == {**{i: "near" for i in range(40)}, 50: "near", 51: "identifier", 52: None}
    assert {r.arrival_id: r.reason for r in first.collect()} == {1: None, 2: "identifier"}


def test_digest_keys(rows):
    got = rows("d string", ("sha1: ABCDEFGH",), ("ABCDEFG",), (None,)).select(history.digest_key(F.col("d")).alias("k")).collect()
    assert [r.k for r in got] == ["abcdefgh", None, None]
