"""Which lines of stored files recur: within their site, and across sites.

One Arrow pass turns every text into arrays, one value a line: code and flags of its form, characters, parts and
the hash of its masked form (numbers, addresses, dates and names left out). Exact hashes are then counted by
site, and the sites by hash; texts never move again.

- local: in at least LOCAL files of one site, or HINTED_LOCAL if the line's words hint at furniture
- wide: on at least WIDE sites, or HINTED_WIDE if its words hint at a message

Articles stay far below: on the sf0.1 tables no sentence, list item or table row of a main body stands in
more than 4 files of its site or on more than 3 sites, although many files are near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.llm import page_lines as P

LOCAL, HINTED_LOCAL = 8, 2
WIDE, HINTED_WIDE = 5, 3
#: Partitions over which the occurrences of one hot line are spread when they meet the recurrent ones.
SALT = 16
ARRAYS = (("codes", "array<tinyint>", pa.int8()), ("flags", "array<tinyint>", pa.int8()), ("chars", "array<int>", pa.int32()), ("parts", "array<int>", pa.int32()), ("hashes", "array<bigint>", pa.int64()))


def text_lines(text: str | None) -> list[tuple]:
    """(code, flags, characters, parts, hash) of every line; titles that stand in a crumb are flagged as headline."""
    looks = [P.LOOKS[x] for x in (text or "").split("\n")]
    heads = {c.split(sep)[-1].strip() for code, *_, c in looks if code == P.CRUMB_LINE for sep in (">", "›", "/", "»") if sep in c}
    return [(code, flags | P.HEADLINE * (code == P.TITLE and c in heads), n, parts, h) for code, flags, n, parts, h, c in looks]


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages = [text_lines(t) for t in b.column("text").to_pylist()]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pages]))).astype(np.int32))
        columns = list(zip(*(x for p in pages for x in p))) or [()] * len(ARRAYS)
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, (_, _, t) in zip(columns, ARRAYS)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("store_path"), *arrays], ["id", "store_path", *(n for n, _, _ in ARRAYS)])


def hinted(h: Column, flag: int) -> Column:
    return h.bitwiseAND(F.lit(flag)) != 0


def with_recurrence(texts: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (id, store_path, text) and sites (store_path, site, html) to two written tables.

    pages: (id, site BIGINT, html, arrays of a value a line, recurs ARRAY<INT>, wide ARRAY<INT>), where recurs holds
    the positions from 0 of lines that recur, wide of those that do on many sites.
    lines: (id, pos, h) of the wide lines. One row per text; NULL texts have one blank line; a text whose path
    is NULL or has no site counts for no site, its lines only recur by being wide.
    """
    root = runtime.new_dir(texts.sparkSession, "recurrence")
    schema = f"id {texts.schema['id'].dataType.simpleString()}, store_path string, " + ", ".join(f"{n} {t}" for n, t, _ in ARRAYS)
    rows = texts.select("id", "store_path", "text").mapInArrow(line_rows, schema)
    placed = rows.join(sites.select("store_path", F.xxhash64("site").alias("at"), F.col("site").isNotNull().alias("known"), "html"), "store_path", "left")
    placed = placed.select("id", F.when(F.col("known"), F.col("at")).alias("site"), F.coalesce("html", F.lit(False)).alias("html"), *(n for n, _, _ in ARRAYS))
    placed = runtime.written(placed, f"{root}/placed")

    once = placed.filter("site is not null").select("site", F.explode(F.array_distinct("hashes")).alias("h")).filter("h <> 0")
    counts = runtime.written(once.groupBy("h", "site").agg(F.count("*").alias("files")), f"{root}/counts")
    wide = runtime.written(counts.groupBy("h").agg(F.count("*").alias("sites")).filter(F.col("sites") >= F.when(hinted(F.col("h"), P.MESSAGE_LIKE), HINTED_WIDE).otherwise(WIDE)).select("h"), f"{root}/wide")
    local = counts.filter(F.col("files") >= F.when(hinted(F.col("h"), P.HINTED), HINTED_LOCAL).otherwise(LOCAL)).select("h", "site")
    local = runtime.written(local, f"{root}/local")

    lines = placed.select("id", "site", F.posexplode("hashes").alias("pos", "h")).filter("h <> 0")
    on_wide = runtime.join_small(lines.select("id", "pos", "h"), wide, ["h"], "left_semi", salt=SALT)
    on_wide = runtime.written(on_wide, f"{root}/wide_lines")
    on_local = runtime.join_small(lines, local, ["h", "site"], "left_semi", salt=SALT).select("id", "pos", F.lit(False).alias("w"))
    both = on_local.unionByName(on_wide.select("id", "pos", F.lit(True).alias("w")))
    found = both.groupBy("id").agg(F.collect_set("pos").alias("recurs"), F.collect_set(F.when(F.col("w"), F.col("pos"))).alias("wide"))
    none = F.array().cast("array<int>")
    pages = placed.join(found, "id", "left").select(*placed.columns, F.coalesce("recurs", none).alias("recurs"), F.coalesce("wide", none).alias("wide"))
    return runtime.written(pages, f"{root}/pages"), on_wide
