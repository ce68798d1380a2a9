"""Problem 8: evaluation passages inside training text.

Both sides are cut into windows of WINDOW words (the least run that counts as a leak), each with a 64-bit
SimHash of its words. Two windows within RADIUS bits agree in at least one of RADIUS + 1 blocks, so an index of
the items' windows by each block finds every pair within the radius. Pairs are verified by the weighted
similarity of their five-word shingles (weight: rarity among the items) and, for a run of equal words, by
the words themselves. Words are those of the one visible form (problem 10), without case and punctuation.

Windows that share no shingle with any item can't be similar; only the others get a SimHash.

The items are the queries, taken in blocks of about INDEX_WINDOWS characters (a window has at least one, and takes
24 bytes), each of which goes to all executors and over all documents. Weights are counted over all items first, so
the number of blocks changes no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.llm import one_form
from tidemark.llm import words as W

WINDOW = 12
#: An edit at the edge of a window changes some bits of twelve words' majority: within 11 lie 93 % of the similar but
#: unequal windows of the sf0.1 tables, within 3 only 3 %. Equal windows have distance 0.
RADIUS = 11
BLOCKS = RADIUS + 1
EDGES = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
SLICE = 256  # windows compared at a time
SIMILAR = 0.8
INDEX_WINDOWS = 50_000
SIEVE_BITS = 20
CHUNK = 30_000  # words whose bits are summed at a time; sums fit 16 bits


def text_words(text: str | None) -> np.ndarray:
    return W.word_ids(one_form.visible(text)[0]) if text else np.empty(0, np.uint64)


def simhashes(ids: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """SimHash of each run of k words."""
    n = len(ids) - k + 1
    out = np.empty(max(n, 0), np.uint64)
    for at in range(0, n, CHUNK):
        part = ids[at : at + CHUNK + k - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
        sums = np.zeros((len(part) + 1, 64), np.int16)
        np.cumsum(bits, axis=0, out=sums[1:])
        ones = (sums[k:] - sums[:-k]) * 2 > k
        out[at : at + len(ones)] = np.packbits(ones, axis=1).view(np.uint64).ravel()
    return out


def block(h: np.ndarray, b: int) -> np.ndarray:
    return (h >> np.uint64(EDGES[b])) & np.uint64((1 << EDGES[b + 1] - EDGES[b]) - 1)


class ItemIndex:
    """Windows of a block of items by Hamming block: arrays of hashes, owners and word ids; and all their shingles.

    holders: in how many of all items each shingle stands; total: how many items there are.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], holders: dict[int, int] | None = None, total: int | None = None):
        self.items, self.words = [], []
        hashes, owner, start = [], [], []
        for item, ids in items:
            h = simhashes(ids)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.items), np.int32))
            start.append(np.arange(len(h), dtype=np.int64) + sum(map(len, self.words)))
            self.items.append(item)
            self.words.append(ids)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int32)
        self.start = np.concatenate(start) if start else np.empty(0, np.int64)  # within the words of all items
        self.flat = np.concatenate(self.words) if self.words else np.empty(0, np.uint64)
        total = len(self.words) if total is None else total
        if holders is None:
            holders = Counter(s for ids in self.words for s in set(W.shingles(ids).tolist()))
        self.rarest = float(np.log1p(total))
        self.shingles = np.unique(np.concatenate([W.shingles(ids) for ids in self.words])) if self.words else np.empty(0, np.uint64)
        self.by_place = np.log1p(total / np.array([holders[s] for s in self.shingles.tolist()], float))
        self.some = np.zeros(1 << SIEVE_BITS, bool)
        self.some[(self.shingles >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        self.order, self.sorted = [], []
        for b in range(BLOCKS):
            v = block(self.hashes, b)
            o = np.argsort(v, kind="stable")
            self.order.append(o)
            self.sorted.append(v[o])

    def shared(self, ids: np.ndarray) -> np.ndarray:
        """Start positions of the windows of WINDOW words that hold a shingle of an item."""
        s = W.shingles(ids)
        at = np.flatnonzero(self.some[(s >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)
        at = at[self.shingles[place] == s[at]]
        hit = np.zeros(len(s) + 1, np.int32)
        hit[at + 1] = 1
        upto = np.cumsum(hit)
        n = len(ids) - WINDOW + 1
        return np.flatnonzero(upto[WINDOW - W.K + 1 : WINDOW - W.K + 1 + n] > upto[:n]) if n > 0 else at[:0]

    def pairs(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, index window) of all pairs within RADIUS bits, each once."""
        parts = [self._pairs(h[at : at + SLICE]) + np.array([at, 0]) for at in range(0, len(h), SLICE)]
        both = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
        return both[:, 0], both[:, 1]

    def _pairs(self, h: np.ndarray) -> np.ndarray:
        found = []
        for b in range(BLOCKS):
            v = block(h, b)
            lo = np.searchsorted(self.sorted[b], v, "left")
            n = np.searchsorted(self.sorted[b], v, "right") - lo
            i = np.repeat(np.arange(len(h)), n)
            j = self.order[b][np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            near = np.bitwise_count(h[i] ^ self.hashes[j]) <= RADIUS
            found.append(np.stack([i[near], j[near]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """Weight of each shingle; those of no item weigh as much as the rarest."""
        if not len(self.shingles):
            return np.full(shingles.shape, self.rarest)
        place = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[place] == shingles, self.by_place[place], self.rarest)

    def similarity(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of windows, given as rows of their shingles."""
        same = x[:, :, None] == y[:, None, :]
        once_x, once_y = first_in_row(x), first_in_row(y)
        wx, wy = self.weights(x) * once_x, self.weights(y) * once_y
        common = (wx * same.any(axis=2)).sum(axis=1)
        total = wx.sum(axis=1) + wy.sum(axis=1) - common
        return np.where(total > 0, common / np.where(total > 0, total, 1.0), 0.0)


def row_shingles(windows: np.ndarray) -> np.ndarray:
    """Shingles of windows, one row each."""
    n = WINDOW - W.K + 1
    flat = W.shingles(windows.ravel())  # some run over two rows; those aren't taken
    return flat[np.arange(len(windows))[:, None] * WINDOW + np.arange(n)] if len(windows) else np.empty((0, n), np.uint64)


def first_in_row(a: np.ndarray) -> np.ndarray:
    """Whether a value has none equal before it in its row."""
    earlier = np.tril(np.ones((a.shape[1], a.shape[1]), bool), -1)
    return ~((a[:, :, None] == a[:, None, :]) & earlier).any(axis=2)


def runs(at: np.ndarray) -> list[np.ndarray]:
    """Positions cut into runs of neighbours."""
    return np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []


def leak_rows(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, item, windows, equal_windows, similarity), one row per document and item that match."""
    for b in batches:
        docs = [text_words(t) for t in b.column("text").to_pylist()]
        lengths = np.array([len(d) for d in docs])
        ids = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        ends = np.cumsum(lengths)
        doc_of = np.repeat(np.arange(len(docs)), lengths)
        at = index.shared(ids)
        at = at[at + WINDOW <= ends[doc_of[at]]]  # no window runs over two documents
        h = np.concatenate([simhashes(ids[r[0] : r[-1] + WINDOW]) for r in runs(at)]) if len(at) else np.empty(0, np.uint64)
        i, j = index.pairs(h)
        found: dict[tuple[int, int], list] = {}
        for k in range(0, len(i), CHUNK):
            p, q = at[i[k : k + CHUNK]], j[k : k + CHUNK]
            x, y = ids[p[:, None] + np.arange(WINDOW)], index.flat[index.start[q][:, None] + np.arange(WINDOW)]
            same = (x == y).all(axis=1)
            sim = np.where(same, 1.0, index.similarity(row_shingles(x), row_shingles(y)))
            for n in np.flatnonzero(sim >= SIMILAR).tolist():
                row = found.setdefault((int(doc_of[p[n]]), int(index.owner[q[n]])), [0, 0, 0.0])
                row[0] += 1
                row[1] += bool(same[n])
                row[2] = max(row[2], float(sim[n]))
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(pa.array([k[0] for k in keys], pa.int64())), pa.array([index.items[k[1]] for k in keys], pa.int64())]
            + [pa.array([found[k][n] for k in keys], t) for n, t in enumerate((pa.int32(), pa.int32(), pa.float64()))],
            ["id", "item", "windows", "equal_windows", "similarity"],
        )


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (id, text) and items (item, passage) to (id, item, windows, equal_windows, similarity).

    windows: pairs of windows whose similarity is at least SIMILAR; equal_windows: those with equal words, so a
    value above 0 means at least WINDOW equal consecutive words. NULL, empty and shorter texts and passages
    match nothing; repeated rows give repeated results; empty tables give none.
    """
    out = "id bigint, item bigint, windows int, equal_windows int, similarity double"
    docs, items = docs.select(F.col("id").cast("bigint"), "text"), items.select(F.col("item").cast("bigint"), "passage")
    # no passage has more windows than characters
    size, total = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-size // INDEX_WINDOWS))
    if blocks == 1:
        index = ItemIndex([(r.item, text_words(r.passage)) for r in items.collect()])
        return docs.mapInArrow(lambda it: leak_rows(it, index), out)
    root = runtime.new_dir(docs.sparkSession, "items")
    items = runtime.written(items.withColumn("block", F.pmod(F.xxhash64("item", "passage"), F.lit(blocks))), f"{root}/items")
    shingles = runtime.written(items.select("block", "passage").mapInArrow(_shingle_rows, "block bigint, shingle bigint"), f"{root}/shingles")
    holders = runtime.written(shingles.groupBy("shingle").agg(F.count("*").alias("n")), f"{root}/holders")
    found = None
    for k in range(blocks):  # each holds about INDEX_WINDOWS characters of passages
        own = shingles.filter(F.col("block") == k).select("shingle").distinct()
        counts = {r.shingle & (2**64 - 1): r.n for r in holders.join(own, "shingle", "left_semi").collect()}
        index = ItemIndex([(r.item, text_words(r.passage)) for r in items.filter(F.col("block") == k).collect()], counts, total)
        part = docs.mapInArrow(lambda it, index=index: leak_rows(it, index), out)
        found = part if found is None else found.unionByName(part)
    return found


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, passage) to (block, shingle), each shingle of a passage once."""
    for b in batches:
        sets = [np.unique(W.shingles(text_words(t))).view(np.int64) for t in b.column("passage").to_pylist()]
        blocks = np.repeat(b.column("block").to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["block", "shingle"])
