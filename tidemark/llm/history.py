"""Problem 1: new batches against everything seen before.

A `HistoryStore` is a folder with three growing tables, each in generations, one per batch:

- keys    exact identifiers (SHA-256, digest, the body's words) by 128-bit hash: (fp, check, seen),
          seen = (batch, id) of the first row that carried the value
- prints  content fingerprints: (fp, cls, words, kept, text_id, seen, sketch), cls = class of the body's length,
          sketch = parities of the body's words, with common windows only
- bloom   Bloom filters over the fps of both, one row per hash partition and generation

and one row of settings that hold for all generations: the number of hash partitions and the common windows.

A batch costs what it holds: its fingerprints are tested against the Bloom filters partition by
partition, only positives are looked up in the tables, candidates are verified by shared coverage and
then by word edit distance, and the batch is appended as one more generation.

Content fingerprints. A body is a row of word ids. Its unit is the shingle of five words; a window holds
three neighbouring shingles, that is seven words. The index side keeps one fingerprint per disjoint window;
the query side asks for the windows at every position, so any unbroken run of 13 common words is found
wherever it stands, and an edit destroys one kept window only. Windows that stand in more than a fixed number of
bodies (page furniture, unedited parts of a family of near copies) are left out where the others alone are
more than the edits a near copy may have, so that one of those is shared for certain; a body with fewer
others keeps as many of its rarest windows as that takes. Every window is asked for, so common ones meet such
bodies only. Keys carry the length class of the body, so that only bodies of a possible length meet.

The number is fixed because a share of all bodies let the pairs grow with their square. What common windows still
bring together is compared by sketches where it meets, before anything of it is shuffled: 512 parities of the
numbers of words, of which an edit turns two at most.

All batches at hand go through one set of jobs, each seeing its own and earlier generations only: job by job
and batch by batch the driver held too many plans.

Why windows side by side and not winnowing (the least hash of every few): winnowing promises a common fingerprint
only for unbroken runs, and TESTDATA allows an edit in every ten words. The figures are in the README.

Generations are merged by compact(), so that a probe meets one filter a partition and not one for every batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.llm import words as W

WINDOW = 7
#: A window is common if it stands in more than COMMON_MIN bodies. The driver holds the common ones: where they
#: are more than MOST_COMMON, the bound is doubled until they aren't.
COMMON_MIN, MOST_COMMON = 50, 500_000
#: Partitions over which the questions for one common window are spread.
SALT = 16
SKETCH = 512  # parities of a sketch, 64 in each of its fields
EDIT_SHARE = 10  # one word in ten may differ
MOST_EDITS = 9  # a near copy may be longer: a tenth of its words is a ninth of its original's at most
PLACEHOLDER = 8  # digests under this length equal nothing
BITS_PER_KEY, HASHES = 12, 4
LEAST_PARTS, KEYS_PER_PART = 12, 250_000  # a part's filter, keys and questions are in one task's memory
SETTINGS = "version int, base string, partitions int, common array<bigint>"

SEEN = "struct<batch:int,id:bigint>"
PARITIES = f"struct<{','.join(f's{i}:bigint' for i in range(SKETCH // 64))}>"
LAST = 2**31 - 2
EXACT = -9  # stands for the length class of exact identifiers


def length_class_of(words: str) -> Column:
    """Bodies whose lengths differ by a tenth of the longer at most are in the same or in neighbouring classes."""
    return F.floor(F.log(F.greatest(F.col(words), F.lit(1))) / F.lit(float(np.log(10 / 9)))).cast("int")


def keyed(fp: np.ndarray, cls: np.ndarray | int) -> np.ndarray:
    return W.mix(fp + np.uint64(0x632BE59BD9B4E019) * np.asarray(cls).astype(np.uint64))


def window_width(n: int) -> int:
    """Words in a window of a body of n words: few enough that there are more windows than a near copy may have edits."""
    return max(1, min(WINDOW, n // ((n + n // MOST_EDITS) // EDIT_SHARE + 1)))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def sketch(ids: np.ndarray) -> np.ndarray:
    """SKETCH parities: whether the words of each residue are odd in number. An edit takes, adds or swaps a word."""
    odd = np.bincount((ids % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _structs(sketches: list[np.ndarray]) -> pa.StructArray:
    fields = np.array(sketches, np.int64).reshape(-1, SKETCH // 64)
    return pa.StructArray.from_arrays([pa.array(f) for f in fields.T], names=[f"s{i}" for i in range(SKETCH // 64)])


def turned(a: str, b: str) -> Column:
    """The number of parities in which two sketches differ."""
    fields = [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH // 64)]
    return sum(fields[1:], fields[0])


def body_features(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
    """(text_id, text, ...) to (body, words, sketch, fps[, asked], ...); no row for texts without words."""
    for b in batches:
        rest = [n for n in b.schema.names if n != "text"]
        keep, body, count, odd, index, ask = [], [], [], [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            ids = W.word_ids(text)
            n = len(ids)
            if not n:
                continue
            w = window_width(n)
            keep.append(i)
            body.append(xxhash.xxh3_128_hexdigest(ids.tobytes()))
            count.append(n)
            odd.append(sketch(ids))
            index.append(np.unique(W.shingles(ids, w)[::w]).view(np.int64))
            if query:
                widths = {window_width(k) for k in range(n - n // 9 - 1, n + n // 9 + 2) if k > 0}
                ask.append(np.unique(np.concatenate([W.shingles(ids, k) for k in widths])).view(np.int64))
        cols = [b.column(n).take(pa.array(keep, pa.int64())) for n in rest]
        cols += [pa.array(body, pa.string()), pa.array(count, pa.int32()), _structs(odd), _lists(index)]
        names = [*rest, "body", "words", "sketch", "fps"]
        if query:
            cols.append(_lists(ask))
            names.append("asked")
        yield pa.RecordBatch.from_arrays(cols, names)


def features(texts: DataFrame, query: bool = False) -> DataFrame:
    """Fingerprint the `text` column; all other columns are kept, rows without any word are dropped."""
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text"]
    out = ", ".join([*rest, "body string", "words int", f"sketch {PARITIES}", "fps array<bigint>"] + ["asked array<bigint>"] * query)
    return texts.mapInArrow(lambda it: body_features(it, query), out)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of an array of lists."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _picked(values: np.ndarray, row: np.ndarray, stay: np.ndarray, rows: int) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row[stay], minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[stay]))


def narrow(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """fps without common windows, and hot, the rarest common ones of bodies whose others a near copy may all have lost.

    common: the most frequent first. Adds kept = size of both.
    """
    order = np.argsort(common)
    known = common[order]
    for b in batches:
        cols = {n: b.column(n) for n in b.schema.names}
        values, lengths = _flat(cols["fps"])
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.full(len(values), len(common))  # of rare ones behind all others
        if len(common):
            at = np.minimum(np.searchsorted(known, values), len(common) - 1)
            place = np.where(known[at] == values, order[at], place)
        rare = place == len(common)
        first = np.lexsort((values, -place, row))
        rank = np.empty(len(values), np.int64)
        rank[first] = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        hot = ~rare & (rank <= (cols["words"].to_numpy() // MOST_EDITS)[row])
        cols["fps"], cols["hot"] = _picked(values, row, rare, len(lengths)), _picked(values, row, hot, len(lengths))
        cols["kept"] = pa.array(np.bincount(row[rare | hot], minlength=len(lengths)), pa.int32())
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def slots(key: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions of each key by double hashing; bits is a power of two."""
    a, b = key & np.uint64(0xFFFFFFFF), (key >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(j) * b) & np.uint64(bits - 1) for j in range(HASHES)])


def bloom_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    key = np.unique(keyed(pdf["fp"].to_numpy().view(np.uint64), pdf["cls"].to_numpy()))
    bits = 1 << max(10, int(np.ceil(np.log2(len(key) * BITS_PER_KEY))))
    field = np.zeros(bits, bool)
    for s in slots(key, bits):
        field[s.astype(np.int64)] = True
    return pd.DataFrame({"gen": [pdf["gen"].iat[0]], "part": [pdf["part"].iat[0]], "field": [np.packbits(field, bitorder="little").tobytes()]})


def bloom_test(probe: pd.DataFrame, blooms: pd.DataFrame) -> pd.DataFrame:
    """Rows of probe that a filter of their own or an earlier generation may hold.

    Content fps are tried with their own and both neighbouring length classes.
    """
    fields = [(g, np.frombuffer(raw, np.uint8)) for g, raw in zip(blooms["gen"], blooms["field"])]
    fp, cls, gen, out = probe["fp"].to_numpy().view(np.uint64), probe["cls"].to_numpy(), probe["gen"].to_numpy(), []
    for shift in (-1, 0, 1):
        rows = np.arange(len(fp)) if shift == 0 else np.flatnonzero(cls != EXACT)
        key = keyed(fp[rows], cls[rows] + shift)
        hit = np.zeros(len(rows), bool)
        for g, field in fields:
            ok = gen[rows] >= g
            for s in slots(key, len(field) * 8):
                ok &= (field[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 > 0
            hit |= ok
        found = probe.iloc[rows[hit]]
        out.append(found.assign(cls=(found["cls"] + shift).astype("int32")))
    return pd.concat(out)[["fp", "cls", "text_id", "words", "gen"]]


def digest_key(digest: Column) -> Column:
    """Digest without case, outer spaces and 'sha1:' prefix; NULL for placeholders."""
    d = F.trim(F.regexp_replace(F.lower(F.trim(digest)), r"^sha1:\s*", ""))
    return F.when(F.length(d) >= PLACEHOLDER, d)


def sha256_key(sha: Column) -> Column:
    s = F.lower(F.trim(sha))
    return F.when(F.length(s) >= PLACEHOLDER, s)


def key_hash(value: Column) -> list[Column]:
    """128 bits of an identifier: equal values are taken as equal by them."""
    return [F.xxhash64(value).alias("fp"), F.xxhash64(value, F.lit("second")).alias("check")]


def exact_keys(rows: DataFrame, keep: list[str], body: bool = False) -> DataFrame:
    """One row (keep..., kind, fp, check) per identifier of each row."""
    values = [F.concat(F.lit("s:"), sha256_key(F.col("sha256"))), F.concat(F.lit("d:"), digest_key(F.col("digest")))]
    values += [F.concat(F.lit("b:"), F.col("body"))] * body
    values = rows.select(*keep, F.explode(F.array_compact(F.array(*values))).alias("value"))
    return values.select(*keep, F.left("value", F.lit(1)).alias("kind"), *key_hash(F.col("value")))


def seen(batch: Column, row: Column) -> Column:
    return F.struct(F.coalesce(batch.cast("int"), F.lit(LAST)).alias("batch"), F.coalesce(row.cast("bigint"), F.lit(2**63 - 1)).alias("id"))


class HistoryStore:
    """Persistent fingerprint store; see the module's text. Generation 0 is the first load.

    A folder that was loaded once opens as it is: loaded is set, and last is its latest generation.
    """

    def __init__(self, spark, path: str, texts: DataFrame):
        """texts: (text_id, text) from which candidates' bodies are fetched again for the last check."""
        self.spark, self.path, self.texts = spark, path, texts
        self.partitions, self.common, self.last = LEAST_PARTS, np.empty(0, np.int64), 0
        self.version, self.base = 0, "base0"
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/settings/_SUCCESS")
        self.loaded = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        if self.loaded:
            kept = spark.read.schema(SETTINGS).parquet(f"{path}/settings").orderBy(F.desc("version")).first()
            self.version, self.base, self.partitions, self.common = kept.version, kept.base, kept.partitions, np.array(kept.common, np.int64)
            self.last = self.blooms().agg(F.max("gen")).first()[0] or 0

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, gen int").parquet(f"{self.path}/{self.base}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        with runtime.tidy(self.spark):
            df.write.mode("append").partitionBy("gen").parquet(f"{self.path}/{self.base}/{name}")

    def _settle(self) -> None:
        """Add a row of settings; the one with the latest version holds."""
        row = (self.version, self.base, self.partitions, self.common.tolist())
        self.spark.createDataFrame([row], SETTINGS).coalesce(1).write.mode("append").parquet(f"{self.path}/settings")

    def keys(self) -> DataFrame:
        return self._read("keys", f"fp bigint, check bigint, seen {SEEN}")

    def prints(self) -> DataFrame:
        return self._read("prints", f"fp bigint, cls int, words int, kept int, text_id bigint, seen {SEEN}, sketch {PARITIES}")

    def blooms(self) -> DataFrame:
        return self._read("bloom", "part int, field binary")

    def part(self) -> Column:
        return F.pmod(F.shiftrightunsigned("fp", 7), F.lit(self.partitions)).cast("int")

    def load(self, keys: DataFrame, bodies: DataFrame) -> None:
        """Generation 0; settles which windows are common and into how many parts the filters are split.

        keys: (fp, check, seen); bodies: (body, words, fps, text_id, seen), one row per file.
        """
        one = runtime.written(distinct_bodies(bodies), f"{self.path}/stage")
        n = one.count()
        counts = one.select(F.explode("fps").alias("fp")).groupBy("fp").count().filter(F.col("count") > COMMON_MIN)
        often, bound = runtime.written(counts, f"{self.path}/often"), COMMON_MIN
        while often.filter(F.col("count") > bound).count() > MOST_COMMON:
            bound *= 2
        table = often.filter(F.col("count") > bound).toArrow()
        fp = table["fp"].to_numpy()
        self.common = fp[np.lexsort((fp, -table["count"].to_numpy()))]
        self.partitions = max(LEAST_PARTS, n * 45 // KEYS_PER_PART)
        self.append([0], keys.unionByName(body_keys(one)).withColumn("gen", F.lit(0)), self.narrowed(one).withColumn("gen", F.lit(0)))
        # last of all, so that a load that broke off doesn't count
        self._settle()
        self.loaded = True
        runtime.remove(self.spark, f"{self.path}/stage", f"{self.path}/often")

    def compact(self) -> None:
        """Merge all generations into one under a new base, with one Bloom filter a partition; between batches only.

        What was seen when is kept in the rows. The old base stays for readers at work; a merge that broke off leaves
        settings as they were.
        """
        keys, prints = self.keys().drop("gen"), self.prints().drop("gen")
        # as many parts as the filters' size asks for now
        rows = prints.count() + keys.count()
        self.partitions = max(LEAST_PARTS, rows // KEYS_PER_PART)
        self.version += 1
        self.base = f"base{self.version}"
        gen = F.lit(self.last)
        self._write(keys.groupBy("fp", "check").agg(F.min("seen").alias("seen")).withColumn("gen", gen), "keys")
        self._write(prints.withColumn("gen", gen), "prints")
        self._filter([self.last])
        self._settle()

    def narrowed(self, bodies: DataFrame) -> DataFrame:
        common = self.common
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bodies.schema) + ", hot array<bigint>, kept int"
        return bodies.mapInArrow(lambda it: narrow(it, common), schema)

    def append(self, gens: list[int], keys: DataFrame, bodies: DataFrame) -> None:
        """Add the generations to keys, prints and Bloom filters; column gen says to which a row belongs.

        keys: (fp, check, seen, gen), those of bodies included; bodies: narrowed, one row per distinct body of a
        generation.
        """
        self._write(keys.groupBy("gen", "fp", "check").agg(F.min("seen").alias("seen")), "keys")
        plain = F.transform("fps", lambda x: F.struct(x.alias("fp"), F.lit(None).cast(PARITIES).alias("sketch")))
        hot = F.transform("hot", lambda x: F.struct(x.alias("fp"), F.col("sketch").alias("sketch")))
        prints = bodies.select(F.explode(F.concat(plain, hot)).alias("p"), length_class_of("words").alias("cls"), "words", "kept", "text_id", "seen", "gen")
        self._write(prints.select("p.fp", "cls", "words", "kept", "text_id", "seen", "p.sketch", "gen"), "prints")
        self._filter(gens)

    def _filter(self, gens: list[int]) -> None:
        """Write the Bloom filters of these generations."""
        fps = self.prints().select("fp", "cls", "gen").unionByName(self.keys().select("fp", F.lit(EXACT).alias("cls"), "gen"))
        fps = fps.filter(F.col("gen").isin(gens)).select("gen", self.part().alias("part"), "fp", "cls")
        self._write(fps.groupBy("gen", "part").applyInPandas(bloom_rows, "gen int, part int, field binary"), "bloom")

    def prescreen(self, probe: DataFrame) -> DataFrame:
        """The rows (fp, cls, text_id, words, gen) that a Bloom filter of an earlier or the own generation may hold."""
        return probe.withColumn("part", self.part()).groupBy("part").cogroup(self.blooms().groupBy("part")).applyInPandas(bloom_test, "fp bigint, cls int, text_id bigint, words int, gen int")

    def check(self, arrivals: DataFrame, bodies: DataFrame, work: str) -> DataFrame:
        """Arrivals known already: rows (arrival_id, reason) with reason 'identifier', 'body' or 'near'.

        arrivals: arrival_id, digest, sha256, body (NULL without text), seen, gen.
        bodies: one row per distinct body of a batch, narrowed (body, words, sketch, asked, text_id, seen, gen).
        Both are written tables and their generations are in the store already: what arrived earlier, in an
        earlier batch or in the same, makes an arrival known; later generations are left aside.
        work: folder for the tables on the way, which the result reads.
        """
        own = exact_keys(arrivals, ["arrival_id", "seen", "gen"], body=True)
        asked = bodies.select(F.explode("asked").alias("fp"), length_class_of("words").alias("cls"), "text_id", "words", "gen")
        probe = asked.unionByName(own.select("fp", F.lit(EXACT).alias("cls"), F.lit(None).cast("bigint").alias("text_id"), F.lit(None).cast("int").alias("words"), "gen"))
        hits = runtime.written(self.prescreen(probe), f"{work}/hits")

        exact = hits.filter(F.col("cls") == EXACT).select("fp").distinct()
        first = runtime.join_small(self.keys(), exact, ["fp"], "left_semi").groupBy("fp", "check").agg(F.min("seen").alias("first"))
        by_key = own.join(first, ["fp", "check"]).filter(F.col("first") < F.col("seen"))
        by_key = by_key.select("arrival_id", F.when(F.col("kind") == "b", "body").otherwise("identifier").alias("reason"))

        other = self.prints().select("fp", "cls", *(F.col(c).alias(f"o_{c}") for c in ("words", "kept", "text_id", "seen", "gen", "sketch")))
        content = hits.filter(F.col("cls") != EXACT)
        longer = F.greatest("words", "o_words")
        limit = F.floor(longer / EDIT_SHARE).cast("int")
        rare = runtime.join_small(other.filter(F.col("o_sketch").isNull()).drop("o_sketch"), content, ["fp", "cls"], rows=runtime.BROADCAST_ROWS // 2)
        # common windows bring many together: those whose words differ too much go before they are shuffled
        hot = other.filter(F.col("o_sketch").isNotNull())
        common = runtime.written(hot.select("fp", "cls").distinct(), f"{work}/common")
        asked = runtime.join_small(content, common, ["fp", "cls"], "left_semi").join(bodies.select("text_id", "gen", "sketch"), ["text_id", "gen"])
        met = runtime.join_small(asked, hot, ["fp", "cls"], rows=runtime.BROADCAST_ROWS // 4, salt=SALT)
        met = met.filter(turned("sketch", "o_sketch") <= 2 * limit).drop("sketch", "o_sketch")
        pairs = rare.unionByName(met)
        pairs = pairs.filter((F.col("text_id") != F.col("o_text_id")) & (F.col("o_gen") <= F.col("gen")))
        # an edit destroys one kept window at most, so all others must be shared
        pairs = pairs.groupBy("text_id", "words", "gen", "o_text_id", "o_words", "o_kept", "o_gen").agg(F.count("*").alias("shared"), F.min("o_seen").alias("o_seen"))
        pairs = pairs.filter((longer - F.least("words", "o_words") <= limit) & (F.col("shared") >= F.greatest(F.lit(1), F.col("o_kept") - limit)))
        pairs = pairs.groupBy("text_id", "o_text_id").agg(F.min("o_seen").alias("o_seen"), F.max("shared").alias("shared"))
        pairs = runtime.written(pairs, f"{work}/pairs")
        near = self.verified(pairs, bodies, work).groupBy("text_id").agg(F.min("o_seen").alias("near_seen")).join(bodies.select("text_id", "body").distinct(), "text_id")
        by_text = arrivals.select("arrival_id", "seen", "body").join(near, "body").filter(F.col("near_seen") < F.col("seen")).select("arrival_id", F.lit("near").alias("reason"))
        rank = F.when(F.col("reason") == "identifier", 3).when(F.col("reason") == "body", 2).otherwise(1)
        return by_key.unionByName(by_text).groupBy("arrival_id").agg(F.max_by("reason", rank).alias("reason"))

    def verified(self, pairs: DataFrame, bodies: DataFrame, work: str) -> DataFrame:
        """The near ones of pairs (text_id, o_text_id, o_seen, shared), as far as they matter.

        In a family of near copies each has all others as candidates: the likeliest of those seen before a body
        first arrived comes first, and only where it isn't near all others follow.
        """
        arrived = bodies.groupBy("text_id").agg(F.min("seen").alias("arrived"))
        earlier = pairs.join(arrived, "text_id").filter(F.col("o_seen") < F.col("arrived"))
        best = earlier.groupBy("text_id").agg(F.max_by(F.struct("o_text_id", "o_seen"), F.struct("shared", "o_text_id")).alias("o")).select("text_id", "o.o_text_id", "o.o_seen")
        sure = runtime.written(self.verify(best), f"{work}/sure")
        rest = runtime.join_small(pairs, sure.select("text_id"), ["text_id"], "left_anti")
        return sure.unionByName(self.verify(rest.select("text_id", "o_text_id", "o_seen")))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose bodies differ by a tenth of the longer's words at most, by word edit distance."""
        ids = pairs.select("text_id").union(pairs.select("o_text_id")).distinct()
        texts = runtime.join_small(self.texts, ids, ["text_id"], "left_semi")
        full = pairs.join(texts, "text_id").join(texts.select(F.col("text_id").alias("o_text_id"), F.col("text").alias("o_text")), "o_text_id")

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ok, bags = [], {}
                for t in set(pdf["text"]).union(pdf["o_text"]):
                    ids = W.word_ids(t)
                    bags[t] = ids, *np.unique(ids, return_counts=True)
                for a, b in zip(pdf["text"], pdf["o_text"]):
                    (x, *x_bag), (y, *y_bag) = bags[a], bags[b]
                    longer = max(len(x), len(y))
                    limit = longer // EDIT_SHARE
                    # each edit takes one word of the longer from the words in common at most
                    ok.append(W.common_words(*x_bag, *y_bag) >= longer - limit and W.edits_within(x, y, limit) is not None)
                yield pdf.loc[np.array(ok, bool), ["text_id", "b", "i"]]

        out = full.select("text_id", F.col("o_seen.batch").alias("b"), F.col("o_seen.id").alias("i"), "text", "o_text").mapInPandas(near, "text_id bigint, b int, i bigint")
        return out.select("text_id", F.struct(F.col("b").alias("batch"), F.col("i").alias("id")).alias("o_seen"))


def body_keys(bodies: DataFrame) -> DataFrame:
    """Exact keys of bodies: (fp, check, seen)."""
    return bodies.select(*key_hash(F.concat(F.lit("b:"), "body")), "seen")


def distinct_bodies(files: DataFrame) -> DataFrame:
    """Exact copies become one row that carries the first time the body was seen."""
    rest = [c for c in files.columns if c not in ("body", "seen")]
    return files.groupBy("body").agg(F.min("seen").alias("seen"), *(F.min_by(c, "text_id").alias(c) for c in rest))


def dedup_batches(captures: DataFrame, incoming: DataFrame, blobs: DataFrame, path: str) -> DataFrame:
    """Verdict on every row of incoming, batch by batch: (arrival_id, batch_no, reason), reason NULL for new files.

    captures: digest, sha256, store_path; incoming: arrival_id, batch_no, digest, sha256, store_path;
    blobs: blob_id, store_path, body. Other columns are ignored. NULL or empty bodies and bodies without any
    letter or digit match nothing; NULL and placeholder identifiers match nothing; a NULL batch_no comes last.
    Repeated rows are repeats: the later arrival is known. Empty tables give an empty result.

    path: folder of the store. A new one is loaded with captures first; in one that holds a store captures aren't
    read, and incoming comes after all it has seen, whatever the batch numbers. blobs must hold earlier texts too:
    those of candidates are looked up, only those of incoming are fingerprinted.
    """
    spark = captures.sparkSession
    store = HistoryStore(spark, path, blobs.select(F.col("blob_id").alias("text_id"), F.col("body").alias("text")))
    never = F.struct(F.lit(-1).alias("batch"), F.lit(0).cast("bigint").alias("id"))
    stored = blobs.select(F.col("blob_id").alias("text_id"), "store_path", F.col("body").alias("text"))

    if not store.loaded:
        marks = captures.select("store_path").filter(F.col("store_path").isNotNull()).distinct()
        old = features(stored).join(marks, "store_path", "left_semi").withColumn("seen", never)
        history_keys = exact_keys(captures.select("sha256", "digest"), []).withColumn("seen", never)
        store.load(history_keys.select("fp", "check", "seen"), old.select("body", "words", "sketch", "fps", "text_id", "seen"))

    # the batches at hand, in order, are the generations after the last
    numbers = sorted({LAST if r.batch_no is None else r.batch_no for r in incoming.select("batch_no").distinct().collect()})  # one row per batch
    place = F.array_position(F.array(*map(F.lit, numbers)).cast("array<int>"), F.coalesce(F.col("batch_no").cast("int"), F.lit(LAST)))
    arrivals = incoming.select("arrival_id", "batch_no", "digest", "sha256", "store_path").withColumn("seen", seen(place + store.last, F.col("arrival_id")))
    arrivals = arrivals.withColumn("gen", F.col("seen.batch"))
    new_paths = arrivals.select("store_path").filter(F.col("store_path").isNotNull()).distinct()
    fresh = store.narrowed(features(runtime.join_small(stored, new_paths, ["store_path"], "left_semi"), query=True))
    work = runtime.new_dir(spark, "work")
    fresh = runtime.written(fresh, f"{work}/fresh")
    placed = runtime.written(arrivals.join(fresh.select("store_path", "text_id", "body"), "store_path", "left"), f"{work}/arrivals")
    first = placed.filter(F.col("body").isNotNull()).groupBy("gen", "body").agg(F.min("seen").alias("seen"))
    one = fresh.groupBy("body").agg(*(F.min_by(c, "text_id").alias(c) for c in ("words", "sketch", "fps", "hot", "asked", "kept")), F.min("text_id").alias("text_id"))
    bodies = runtime.written(first.join(one, "body"), f"{work}/bodies")
    runtime.remove(spark, f"{work}/fresh")
    # all rows that arrived count as seen, so the generations of all batches at hand can be added at once;
    # check() lets each batch see its own and earlier generations only
    gens = [r.gen for r in placed.select("gen").distinct().collect()]  # one row per batch
    store.append(gens, exact_keys(placed, ["seen", "gen"], body=True).select("fp", "check", "seen", "gen"), bodies.select("body", "words", "sketch", "fps", "hot", "kept", "text_id", "seen", "gen"))
    known = runtime.written(store.check(placed, bodies, work), runtime.new_dir(spark, "known"))
    runtime.remove(spark, work)
    return incoming.select("arrival_id", "batch_no").join(known, "arrival_id", "left")
