"""Queries of the content parsers: files are built from the tables' rows and read back, so SQL knows the answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.content import binary, builders, html
from tidemark.operators import captures as C
from tidemark.plans import capture_queries
from tidemark.plans import sql_parts as Q
from tidemark.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@F.pandas_udf(T.BinaryType())
def _pdf(author: pd.Series, title: pd.Series, company: pd.Series) -> pd.Series:
    return pd.Series([builders.pdf({"Author": a, "Title": t, "Company": c}) for a, t, c in zip(author, title, company)])


@F.pandas_udf(T.BinaryType())
def _office(author: pd.Series, title: pd.Series, company: pd.Series) -> pd.Series:
    return pd.Series([builders.office({"dc:creator": a, "dc:title": t}, {"Company": c}) for a, t, c in zip(author, title, company)])


@F.pandas_udf(T.BinaryType())
def _jpeg(make: pd.Series, model: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
    return pd.Series([builders.jpeg({0x010F: a, 0x0110: b}, x, y) for a, b, x, y in zip(make, model, lat, lon)])


def _documents(spark: SparkSession, d: str, kind: str) -> DataFrame:
    build = _pdf if kind == "pdf" else _office
    # entities are part of the XML text that comes back, so only PDF keeps them apart
    docs = table(spark, d, "docmeta").select("meta_id", "author", "title", "company")
    made = docs.withColumn("content", build("author", "title", "company"))
    read = made.select("meta_id", binary.document_metadata(F.col("content"), F.lit(kind)).alias("r"))
    return read.select("meta_id", *[F.try_element_at("r.meta", F.lit(k)).alias(k.lower()) for k in ("Author", "Title", "Company")], "r.reason")


def _fields_sql(escaped: bool) -> str:
    value = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')" if escaped else "{c}"
    value = f"trim(regexp_replace({value}, '^\\s+|\\s+$', '', 'g'))"
    cut = "200" if escaped else "500"
    named = {c: f"CASE WHEN length({value.format(c=c)}) BETWEEN 1 AND 500 THEN substr({value.format(c=c)}, 1, {cut}) END" for c in ("author", "title", "company")}
    return f"SELECT meta_id, author, title, company, CASE WHEN coalesce(author, title, company) IS NULL THEN 'metadata not found' END AS reason FROM (SELECT meta_id, {', '.join(f'{v} AS {c}' for c, v in named.items())} FROM docmeta)"


@query(_fields_sql(False))
def pdf_metadata(spark, d):
    return _documents(spark, d, "pdf")


@query(_fields_sql(True))
def office_metadata(spark, d):
    return _documents(spark, d, "docx")


@query("SELECT photo_id, nullif(make, '') AS make, nullif(model, '') AS model, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN round(lat, 4) END AS lat, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN round(lon, 4) END AS lon FROM photoexif")
def exif_gps(spark, d):
    photos = table(spark, d, "photoexif").select("photo_id", _jpeg("make", "model", "lat", "lon").alias("content"))
    read = photos.select("photo_id", binary.photo_metadata(F.col("content")).alias("r"))
    return read.select("photo_id", "r.make", "r.model", F.round("r.lat", 4).alias("lat"), F.round("r.lon", 4).alias("lon"))


@query("SELECT blob_id, md5(body) AS md5 FROM blobs")
def decode_html(spark, d):
    """Bodies as bytes of an undeclared encoding, decoded again."""
    blobs = table(spark, d, "blobs").select("blob_id", F.encode("body", "UTF-8").alias("raw"))
    return blobs.select("blob_id", F.md5(html.decoded(F.col("raw")).cast("binary")).alias("md5"))


_HEAD = "lower(substr(body, 1, 16))"


@query(f"""WITH c AS (SELECT store_path, first(original_url ORDER BY row_ord) AS original_url, first(mimetype ORDER BY row_ord) AS mimetype FROM captures WHERE store_path IS NOT NULL GROUP BY store_path),
j AS (SELECT blob_id, body, {Q.extension("original_url")} AS ext, lower(trim(regexp_extract(coalesce(mimetype, ''), '^([^;]*)', 1))) AS mime FROM blobs JOIN c USING (store_path))
SELECT blob_id, CASE WHEN coalesce(body, '') = '' THEN 'BROKEN' WHEN ext = 'pdf' OR mime = 'application/pdf' OR body LIKE '%PDF-%' AND starts_with(body, '%PDF-') THEN 'BROKEN'
  WHEN ext IN ('jpg', 'jpeg', 'png', 'gif', 'tif', 'tiff', 'zip', 'docx', 'xlsx', 'pptx', 'odt', 'ods', 'odp') OR mime IN ('image/jpeg', 'image/png', 'image/gif', 'image/tiff', 'application/zip') THEN 'BROKEN'
  WHEN starts_with(mime, 'text/html') OR ext IN ('html', 'htm', 'xhtml', 'php', 'asp', 'aspx', 'jsp', 'shtml') THEN CASE WHEN regexp_matches({_HEAD}, '<html|<!doctype|<head|<body') THEN 'OK' ELSE 'WARNING' END ELSE 'OK' END AS status FROM j""")
def structure_status(spark, d):
    """Structure check of the stored texts, which are no PDF, image or ZIP bytes whatever their type says."""
    paths = C.first_per(table(spark, d, "captures").filter("store_path is not null").select("store_path", "original_url", "mimetype", "row_ord"), ["store_path"], ["row_ord"])
    joined = table(spark, d, "blobs").select("blob_id", "store_path", F.col("body").cast("binary").alias("content")).join(paths, "store_path")
    return joined.select("blob_id", binary.structure(F.col("content"), "original_url", "mimetype").getField("status").alias("status"))


@query()
def rewrite_html(spark, d):
    """Demo pages with their internal links made relative."""
    from tidemark.functions import urls

    pages = capture_queries.demo_pages(spark, d).select(F.lit("latest").alias("group_id"), "url", urls.relative_path("url").alias("path"), "html")
    addresses = pages.select("group_id", F.explode(urls.registry_keys("url")).alias("key"), "path").groupBy("group_id", "key").agg(F.min("path").alias("path"))
    return html.rewrite(pages, addresses)


@query(f"SELECT CASE WHEN b.store_path IS NULL THEN 'MISSING' ELSE 'STORED' END AS status, count(DISTINCT c.digest) AS digests FROM (SELECT digest, first(store_path ORDER BY row_ord) AS store_path FROM captures GROUP BY digest) c LEFT JOIN blobs b USING (store_path) GROUP BY 1")
def integrity_counts(spark, d):
    """How many digests have their file."""
    one = C.dedup_by_digest(table(spark, d, "captures")).select("digest", "store_path")
    stored = table(spark, d, "blobs").select("store_path", F.lit(True).alias("hit"))
    status = F.when(F.col("hit"), "STORED").otherwise("MISSING")
    return one.join(stored, "store_path", "left").groupBy(status.alias("status")).agg(F.count_distinct("digest").alias("digests"))
