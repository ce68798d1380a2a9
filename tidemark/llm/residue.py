"""Problem 2: files that hold template residue, filler, error or script messages instead of content.

Lines are masked (numbers, addresses, dates, names), hashed and counted over all sources (recurrence). A group of
equal hashes that stands on many sources is a message if most of its files have nothing of their own beside
lines that recur; page furniture, which recurs as well, stands beside content. That needs no phrase: an
unknown wording counts as soon as it is widespread. A rare line is a message by rule only: nothing but unfilled
placeholders, filler, or the form of a numbered error or failed program. A file is residue if it holds a message and
no sentence, list item or table row that recurs neither on its site nor elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.functions import urls
from tidemark.llm import page_lines as P
from tidemark.llm import recurrence

#: Share of a widespread line's files that must hold nothing of their own.
ALONE = 0.5


def verdicts(pages: DataFrame, wide_lines: DataFrame) -> DataFrame:
    """Tables of recurrence.with_recurrence to (id, messages, own, residue BOOLEAN)."""
    content = F.array(*[F.lit(c).cast("tinyint") for c in sorted(P.CONTENT)])
    own = F.size(F.filter("codes", lambda c, i: F.array_contains(content, c) & ~F.array_contains("recurs", i)))
    ruled = F.size(F.filter("codes", lambda c: c == P.MESSAGE))
    files = pages.select("id", own.alias("own"), ruled.alias("ruled"), F.size("wide").alias("n_wide"))
    files = runtime.written(files, runtime.new_dir(pages.sparkSession, "files"))
    beside = wide_lines.join(files.filter("n_wide > 0").select("id", (F.col("own") == 0).alias("alone")), "id")
    share = beside.groupBy("h").agg(F.avg(F.col("alone").cast("int")).alias("share")).filter(F.col("share") >= ALONE).select("h")
    by_use = runtime.join_small(beside.filter("alone").select("id", "h"), share, ["h"], "left_semi", salt=recurrence.SALT).groupBy("id").agg(F.count("*").alias("used"))
    out = runtime.join_small(files, by_use, ["id"], "left").select("id", (F.col("ruled") + F.coalesce("used", F.lit(0))).cast("int").alias("messages"), "own")
    return out.withColumn("residue", (F.col("messages") > 0) & (F.col("own") == 0))


def residue(texts: DataFrame, sites: DataFrame) -> DataFrame:
    """texts (id, store_path, text) and sites (store_path, site, html) to (id, messages, own, residue BOOLEAN).

    One row per text; ids are unique. NULL and empty texts have no messages and are not residue; a text without
    a site counts for no source. Other columns are ignored.
    """
    return verdicts(*recurrence.with_recurrence(texts, sites))


def store_sites(*tables: DataFrame) -> DataFrame:
    """(store_path, site, html): the site of every stored file and whether any of its captures is HTML."""
    rows = None
    for t in tables:
        r = t.select("store_path", urls.site("original_url").alias("site"), F.lower("mimetype").startswith("text/html").alias("h"))
        rows = r if rows is None else rows.unionByName(r)
    rows = rows.filter(F.col("store_path").isNotNull())
    return rows.groupBy("store_path").agg(F.min("site").alias("site"), F.coalesce(F.max("h"), F.lit(False)).alias("html"))
