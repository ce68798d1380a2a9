"""Queries of the core operators for dates and broken rows (problems 4 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.functions import instants
from tidemark.operators import error_parse


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every date value that names one instant, as a UTC second."""
    docs = runtime.table(spark, d, "docmeta").select("meta_id", "tz_name", "creationdate", "moddate")
    none = F.lit(None).cast("string")
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("creationdate", "moddate")])
    from_docs = docs.select(F.col("meta_id").alias("rec_id"), "tz_name", none.alias("offsettime"), F.explode(pairs).alias("p")).select("rec_id", "p.field", "p.value", "offsettime", "tz_name")
    photos = runtime.table(spark, d, "photoexif").select(F.col("photo_id").alias("rec_id"), F.lit("datetimeoriginal").alias("field"), F.col("datetimeoriginal").alias("value"), "offsettime", "tz_name")
    values = from_docs.unionByName(photos).filter(F.col("value").isNotNull())
    return instants.with_utc_second(values, "value", "tz_name", "offsettime").filter(F.col("utc_second").isNotNull()).select("rec_id", "field", "utc_second")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that fail, with the first reason that applies."""
    return error_parse.parse_lines(runtime.table(spark, d, "rawlines")).filter(F.col("reason").isNotNull()).select("line_id", "reason")


def p7_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Good records in columns; a missing length is NULL."""
    good = error_parse.parse_lines(runtime.table(spark, d, "rawlines")).filter(F.col("reason").isNull())
    names = ("original_url", "timestamp", "digest", "mimetype", "statuscode", "length", "reason")
    cols = [F.get("fields", i).alias(n) for i, n in enumerate(names)]
    return good.select("line_id", "kind", *cols).withColumn("length", F.when(~F.col("length").isin("", "-"), F.col("length")).cast("bigint"))


def p7_repairs(spark: SparkSession, d: str) -> DataFrame:
    """What would mend each record that fails."""
    return error_parse.parse_lines(runtime.table(spark, d, "rawlines")).filter(F.col("reason").isNotNull()).select("line_id", "kind", "reason", "detail")


QUERIES = {"p4_found": p4_found, "p7_found": p7_found, "p7_loaded": p7_loaded, "p7_repairs": p7_repairs}

RECORDS_SQL = """ends AS (SELECT page_no, max(line_no) AS last FROM rawlines WHERE kind = 'index' GROUP BY page_no),
gaps AS (SELECT page_no, last, max(line_no) AS gap, arg_max(raw, line_no) AS raw_before FROM rawlines JOIN ends USING (page_no) WHERE kind = 'index' AND line_no < last GROUP BY page_no, last),
records AS (SELECT r.* FROM rawlines r LEFT JOIN gaps g ON r.page_no = g.page_no AND g.raw_before = ''
  WHERE NOT coalesce(r.kind = 'index' AND (r.line_no = g.last OR r.line_no = g.gap), false)),
shaped AS (SELECT line_id, kind, raw,
  kind = 'index' OR regexp_full_match(raw, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS sound,
  CASE WHEN kind = 'index' THEN len(string_split(raw, ' ')) = 6 ELSE regexp_full_match(raw, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*)){6}') END AS wide
  FROM records),
valued AS (SELECT *, CASE WHEN NOT wide THEN NULL WHEN kind = 'index' THEN string_split(raw, ' ')[1] ELSE regexp_extract(raw, '(?s)^("(?:[^"]|"")*"|[^",]*)', 1) END AS f1,
  CASE WHEN NOT wide THEN NULL WHEN kind = 'index' THEN string_split(raw, ' ')[6] ELSE regexp_extract(raw, '(?s)^(?:(?:"(?:[^"]|"")*"|[^",]*),){5}("(?:[^"]|"")*"|[^",]*)', 1) END AS f6
  FROM shaped),
clean AS (SELECT *, CASE WHEN f1 LIKE '"%' THEN replace(substr(f1, 2, length(f1) - 2), '""', '"') ELSE f1 END AS url, CASE WHEN f6 LIKE '"%' THEN replace(substr(f6, 2, length(f6) - 2), '""', '"') ELSE f6 END AS len6 FROM valued),
judged AS (SELECT line_id, CASE WHEN NOT sound THEN 'quoting' WHEN NOT wide THEN 'columns'
  WHEN NOT regexp_full_match(url, '(?is)https?://([^/?#@\\s]*@)?(\\[[0-9a-f:.]+\\]|[^/?#:@\\s\\[\\]]+)(:[0-9]*)?([/?#].*)?')
    OR NOT coalesce(try_cast(nullif(regexp_extract(url, '(?is)^https?://(?:[^/?#@\\s]*@)?(?:\\[[0-9a-f:.]+\\]|[^/?#:@\\s\\[\\]]+):([0-9]*)', 1), '') AS HUGEINT) BETWEEN 1 AND 65535, true) THEN 'value'
  WHEN NOT (len6 IN ('', '-') OR (regexp_full_match(len6, '[0-9]+') AND coalesce(try_cast(len6 AS HUGEINT) <= 9223372036854775807, false))) THEN 'value' END AS reason FROM clean)"""

SQL: dict[str, str] = {"p7_found": f"WITH {RECORDS_SQL} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"}
