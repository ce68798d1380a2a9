"""Queries of the training-text operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.llm import history, leaks, main_body, mixing, mojibake, one_form, repeats, residue


def p1_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every arrival with the reason why it is known, or NULL."""
    return history.dedup_batches(runtime.table(spark, d, "captures"), runtime.table(spark, d, "incoming"), runtime.table(spark, d, "blobs"), runtime.new_dir(spark, "p1"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals whose file is already known."""
    return p1_verdicts(spark, d).filter(F.col("reason").isNotNull()).select("arrival_id").distinct()


def sites(spark: SparkSession, d: str) -> DataFrame:
    return residue.store_sites(runtime.table(spark, d, "captures"), runtime.table(spark, d, "incoming"))


def stored_texts(spark: SparkSession, d: str) -> DataFrame:
    return runtime.table(spark, d, "blobs").select(F.col("blob_id").alias("id"), "store_path", F.col("body").alias("text"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """Every blob with its numbers of message lines and lines of its own, and the verdict."""
    return residue.residue(stored_texts(spark, d), sites(spark, d)).withColumnRenamed("id", "blob_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Blobs that hold residue instead of content."""
    return p2_files(spark, d).filter("residue").select("blob_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of HTML files outside the main body."""
    pages = main_body.html_pages(stored_texts(spark, d), sites(spark, d))
    return pages.select(F.col("id").alias("blob_id"), F.explode("outside").alias("line_no"))


def p3_body(spark: SparkSession, d: str) -> DataFrame:
    """The main body of every HTML file that isn't residue."""
    pages = stored_texts(spark, d)
    return main_body.body_text(pages, main_body.html_pages(pages, sites(spark, d))).withColumnRenamed("id", "blob_id")


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """Author, title and company values with the verdict and the restored text."""
    return mojibake.find_garbled(runtime.table(spark, d, "docmeta"), ["author", "title", "company"], "meta_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Garbled fields."""
    return p5_fields(spark, d).filter("garbled").select("meta_id", "field")


def site_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc, source, lines) of every blob, written: hashes of its lines."""
    blobs = runtime.table(spark, d, "blobs").select(F.col("blob_id").alias("doc"), "store_path", F.col("body").alias("text"))
    placed = repeats.line_hashes(blobs).join(sites(spark, d).select("store_path", F.col("site").alias("source")), "store_path", "left")
    return runtime.written(placed.select("doc", "source", "lines"), runtime.new_dir(spark, "lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand in at least 10 files of their site."""
    return repeats.repeated_lines(site_lines(spark, d)).select(F.col("doc").alias("blob_id"), "line_no")


def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Runs of neighbouring lines, of any length, that stand in at least 10 files of a site."""
    return repeats.frequent_sequences(site_lines(spark, d)).select("source", "length", F.col("example.doc").alias("doc"), F.col("example.first_line").alias("first_line"), F.col("example.last_line").alias("last_line"), "support")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every blob without the lines repeated on its site."""
    blobs = runtime.table(spark, d, "blobs").select(F.col("blob_id").alias("doc"), "store_path", F.col("body").alias("text"))
    placed = blobs.join(sites(spark, d).select("store_path", F.col("site").alias("source")), "store_path", "left")
    return repeats.remove_repeated(placed).withColumnRenamed("doc", "blob_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document and item with similar windows: how many, how many with equal words, and the best similarity."""
    docs = runtime.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = runtime.table(spark, d, "evalitems").select(F.col("item_id").alias("item"), "passage")
    return leaks.find_leaks(docs, items).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows", "equal_windows", F.round("similarity", 6).alias("similarity"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share at least 12 consecutive words with an item."""
    return p8_leaks(spark, d).filter(F.col("equal_windows") > 0).select("doc_id", "item_id").distinct()


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, one row per use, in order."""
    docs = mixing.with_tokens(runtime.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text"))
    return mixing.mix(docs, runtime.table(spark, d, "mixtargets")).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Reached shares of the sources against their targets."""
    return mixing.shares(p9_mix(spark, d).withColumnRenamed("doc_id", "id"), runtime.table(spark, d, "mixtargets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold look-alike or invisible characters."""
    return runtime.table(spark, d, "documents").select("doc_id", "text").filter(one_form.is_changed(F.col("text"))).select("doc_id")


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its one form."""
    return one_form.with_one_form(runtime.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "one_form", "changed")


QUERIES = {
    "p1_found": p1_found,
    "p1_verdicts": p1_verdicts,
    "p2_found": p2_found,
    "p2_files": p2_files,
    "p3_found": p3_found,
    "p3_body": p3_body,
    "p5_found": p5_found,
    "p5_fields": p5_fields,
    "p6_found": p6_found,
    "p6_sequences": p6_sequences,
    "p6_cleaned": p6_cleaned,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_texts": p10_texts,
}

SITES_SQL = """sites AS (
  SELECT store_path, min(nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(trim(original_url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), ':[0-9]*$', ''), '[.]+$', ''), '^www[.]', ''), '')) AS site
  FROM (SELECT store_path, original_url FROM captures UNION ALL SELECT store_path, original_url FROM incoming)
  WHERE store_path IS NOT NULL GROUP BY store_path)"""

LINES_SQL = f"""{SITES_SQL}, parts AS (
  SELECT b.blob_id, s.site, unnest(string_split(b.body, chr(10))) AS line, generate_subscripts(string_split(b.body, chr(10)), 1) AS line_no
  FROM blobs b JOIN sites s USING (store_path) WHERE s.site IS NOT NULL),
items AS (SELECT * FROM (SELECT blob_id, site, line_no, replace(replace(lower(regexp_replace(line, '[^\\p{{L}}]+', '', 'g')), 'ς', 'σ'), 'ß', 'ss') AS item FROM parts) WHERE item <> '')"""

SQL: dict[str, str] = {
    "p6_found": f"""WITH {LINES_SQL},
often AS (SELECT site, item FROM items GROUP BY site, item HAVING count(DISTINCT blob_id) >= 10)
SELECT blob_id, CAST(line_no AS INTEGER) AS line_no FROM items JOIN often USING (site, item)""",
}
