"""Queries of groups, scans, reports and checks over the driver's tables, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema
from tidemark.content import binary, builders, html
from tidemark.functions import times, urls, values
from tidemark.operators import captures as C
from tidemark.plans import capture_queries as CQ
from tidemark.plans import content_queries, data_queries
from tidemark.plans import sql_parts as Q
from tidemark.runtime import new_dir, table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


U, M = "original_url", "mimetype"
FOLDER = f"coalesce(strftime({Q.parsed('timestamp')}, '%Y-%m-%d_%H-%M-%S'), {Q.sanitized('timestamp')})"
EXT = Q.document_extension(U, M)


# -- which files are scanned, and where they go ---------------------------------------------------------------


@query(f"""SELECT row_ord, coalesce({Q.extension(U)} IN ({Q.quoted(schema.HTML_EXTENSIONS)}), false) OR coalesce(starts_with(lower(mimetype), 'text/html'), false) AS for_links,
  coalesce({Q.extension(U)} = 'css' OR starts_with(lower(mimetype), 'text/css'), false) AS for_styles, coalesce({Q.extension(U)} IN ({Q.quoted((*schema.HTML_EXTENSIONS, 'txt', 'xml', 'json'))}), false) AS for_contacts,
  coalesce(regexp_matches({Q.path(U)}, '(?i)(sitemap[^/]*[.]xml|robots[.]txt)$'), false) AS for_lists, coalesce({EXT} IN ({Q.quoted(schema.METADATA_EXTENSIONS)}), false) AS for_metadata, coalesce({EXT} IN ({Q.quoted(schema.PHOTO_EXTENSIONS)}), false) AS for_photos FROM captures""")
def scan_targets(spark, d):
    """Which captures each scan looks at."""
    return C.scan_targets(table(spark, d, "captures")).select("row_ord", "for_links", "for_styles", "for_contacts", "for_lists", "for_metadata", "for_photos")


@query(f"SELECT count_if({EXT} IN ({Q.quoted(schema.DOCUMENT_EXTENSIONS)})) AS documents, count_if({EXT} IN ({Q.quoted(schema.IMAGE_EXTENSIONS)})) AS photos FROM captures WHERE store_path IN (SELECT store_path FROM blobs)")
def placed_files(spark, d):
    """Documents and photos whose file is stored."""
    return C.placed(table(spark, d, "captures"), table(spark, d, "blobs"))


@query(f"WITH wanted AS ({CQ.FETCH}) SELECT count(*) AS files, CAST(coalesce(sum({Q.digits_or_zero('size_bytes')}), 0) AS BIGINT) AS bytes FROM wanted JOIN incoming USING (arrival_id)")
def download_estimate(spark, d):
    """Number and bytes of the incoming files that a download would fetch."""
    return C.estimate(CQ._to_fetch(spark, d), "size_bytes")


@query(f"WITH {CQ.FAILED_SQL} SELECT line_id FROM queue WHERE NOT {Q.is_permanent('f7')}")
def retry_rows(spark, d):
    """Queued failures worth another try."""
    return C.retry_rows(CQ.failures(spark, d)).select(F.col("row_ord").alias("line_id"))


@query(f"SELECT version, captures FROM (SELECT {FOLDER} AS version, count(*) AS captures FROM captures GROUP BY 1) ORDER BY version DESC LIMIT 100")
def newest_versions(spark, d):
    return C.newest_versions(table(spark, d, "captures"))


@query(f"SELECT row_ord, original_url, timestamp, doc_ext FROM (SELECT row_ord, original_url, timestamp, {EXT} AS doc_ext FROM captures) WHERE doc_ext IN ({Q.quoted(schema.DOCUMENT_EXTENSIONS)}) ORDER BY timestamp DESC, row_ord LIMIT 200")
def newest_documents(spark, d):
    return C.newest_documents(table(spark, d, "captures"))


@query(f"SELECT row_ord, CASE WHEN length(p) <= 120 THEN p ELSE 'versions/' || folder || '/' || substr(sha1(original_url), 1, 12) || regexp_extract(p, '([.][^./]*)$', 1) END AS version_path FROM (SELECT row_ord, original_url, {FOLDER} AS folder, 'versions/' || {FOLDER} || '/' || {Q.relative_path(U)} AS p FROM captures)")
def version_paths(spark, d):
    """Where each capture's file lies below its snapshot, long paths hashed (here from 120 characters)."""
    rows = table(spark, d, "captures")
    folder = F.concat(F.lit("versions/"), times.folder("timestamp"))
    return rows.select("row_ord", urls.guarded_path(F.concat(folder, F.lit("/"), urls.relative_path(U)), folder, U, 120).alias("version_path"))


_H = f"regexp_replace({Q.host(U)}, '[.]+$', '')"
_P = f"try_cast({Q.port(U)} AS INTEGER)"


@query(f"SELECT row_ord, CASE WHEN NOT {Q.port_ok(U)} THEN lower({Q.raw_authority(U)}) WHEN {_P} IS NULL OR {_P} IN (80, 443) THEN {_H} ELSE {_H} || ':' || CAST({_P} AS VARCHAR) END AS host_key FROM captures")
def scope_host_keys(spark, d):
    return table(spark, d, "captures").select("row_ord", urls.scope_host_key(U).alias("host_key"))


# -- groups and links ------------------------------------------------------------------------------------------

GROUPS = f"""grouped AS (SELECT row_ord, original_url, {FOLDER} AS group_id, {Q.relative_path(U)} AS path FROM captures UNION ALL
  SELECT row_ord, original_url, 'latest', path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY timestamp DESC, row_ord) AS rn FROM (SELECT row_ord, original_url, timestamp, {Q.relative_path(U)} AS path FROM captures)) WHERE rn = 1),
regs AS (SELECT DISTINCT group_id, key, row_ord, path FROM grouped JOIN ({CQ._registry_sql(U)}) k USING (original_url))"""


@query(f"WITH {GROUPS} SELECT group_id, key, first(path ORDER BY row_ord) AS path FROM regs GROUP BY group_id, key")
def page_registry(spark, d):
    """For every key of a group the file of its first page."""
    rows = table(spark, d, "captures").filter(F.col(U).isNotNull())
    return C.registry(C.page_groups(rows))


LINKED = f"""{GROUPS}, html_pages AS (SELECT DISTINCT group_id, original_url AS url FROM grouped WHERE {Q.raw_authority(U)} <> '' AND {Q.extension(U)} IN ({Q.quoted(schema.HTML_EXTENSIONS)})),
links AS (SELECT group_id, url AS source, t AS target FROM html_pages, LATERAL (SELECT unnest([{Q.scheme("url")} || '://' || {Q.raw_authority("url")} || '/', url || '#top', 'http://mirror.' || {Q.host("url")} || '/x']) AS t)),
keys AS (SELECT DISTINCT group_id, key FROM regs),
edges AS (SELECT l.group_id, source, target, k.key IS NOT NULL AS is_internal FROM links l LEFT JOIN keys k ON k.group_id = l.group_id AND k.key = {Q.link_key("target")})"""


def group_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all groups. The pages of a capture are read once and fanned out to its groups."""
    rows = table(spark, d, "captures").filter(F.col(U).isNotNull()).select("row_ord", U, "timestamp")
    groups = written(C.page_groups(rows).select("group_id", F.col(U).alias("url")).distinct(), new_dir(spark, "groups"))
    found = html.links(CQ.demo_pages(spark, d)).select("url", "target")
    links = groups.join(found, "url").select("group_id", F.col("url").alias("source"), "target")
    return C.edges(links, groups)


@query(f"WITH {LINKED} SELECT group_id, source, target, is_internal FROM edges")
def version_link_edges(spark, d):
    """Links of every snapshot and of the latest pages, resolved within their group."""
    return group_edges(spark, d)


@query(f"WITH {LINKED} SELECT group_id, count(*) AS links, count_if(is_internal) AS internal FROM edges GROUP BY group_id")
def links_by_version(spark, d):
    return group_edges(spark, d).groupBy("group_id").agg(F.count("*").alias("links"), F.count_if("is_internal").alias("internal"))


@query(f"WITH {CQ.PAGES_SQL} SELECT DISTINCT original_url AS url FROM captures WHERE original_url NOT IN (SELECT target FROM graph) ORDER BY url LIMIT 100")
def first_isolated(spark, d):
    """The first hundred pages nothing links to."""
    known = table(spark, d, "captures").filter("original_url is not null").select(F.col(U).alias("url"))
    return C.isolated(known, CQ.graph(spark, d)).orderBy("url").limit(100)


@query(f"WITH {CQ.PAGES_SQL}, pages_in AS (SELECT url FROM pages) SELECT source AS url, count(*) AS changed FROM (SELECT DISTINCT g.source, g.target FROM graph g WHERE is_internal) GROUP BY source")
def rewrite_counts(spark, d):
    """How many links of each page become relative: those to captured files, where every address stands once."""
    pages = CQ.demo_pages(spark, d).select(F.lit("latest").alias("group_id"), "url", urls.relative_path("url").alias("path"), "html")
    known = table(spark, d, "captures").filter(F.col(U).isNotNull()).select(F.lit("latest").alias("group_id"), F.col("row_ord"), F.col(U), urls.relative_path(U).alias("path"))
    out = html.rewrite(pages, C.registry(known))
    return out.filter("changed > 0").select("url", F.col("changed").cast("bigint").alias("changed"))


@query("""SELECT p_partkey AS id, 'x{a:url(../i/' || p_partkey || '.png);b:url(data:q);c:url("http://other.test/z.png")}' AS css, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS changed FROM part""")
def rewrite_css(spark, d):
    """Style sheets of a made-up site whose picture is known: root-relative addresses become relative ones."""
    k = F.col("p_partkey").cast("string")
    address = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("../i/"), k, F.lit(".png"))).otherwise(F.concat(F.lit("/i/"), k, F.lit(".png")))
    css = F.concat(F.lit("x{a:url("), address, F.lit(');b:url(data:q);c:url("http://other.test/z.png")}'))
    files = table(spark, d, "part").select(F.lit("latest").alias("group_id"), F.concat(F.lit("http://s.test/css/"), k, F.lit(".css")).alias("url"), F.concat(F.lit("s.test/css/"), k, F.lit(".css")).alias("path"), css.alias("css"), F.col("p_partkey"))
    pictures = files.select("group_id", urls.link_key(F.concat(F.lit("http://s.test/i/"), k, F.lit(".png"))).alias("key"), F.concat(F.lit("s.test/i/"), k, F.lit(".png")).alias("path"))
    out = html.rewrite_styles(files, pictures)
    return out.select(F.regexp_extract("url", r"(\d+)\.css$", 1).cast("bigint").alias("id"), "css", "changed")


# -- contacts --------------------------------------------------------------------------------------------------

#: A page per document, with every way a contact may stand on it; one network each by turns.
NETWORK_LINKS = {
    "VK": "https://vk.com/team", "Telegram": "https://t.me/team", "Instagram": "https://instagram.com/team", "Facebook": "https://www.facebook.com/team", "Twitter/X": "https://x.com/team",
    "YouTube": "https://youtu.be/team", "LinkedIn": "https://linkedin.com/company/team", "OK": "https://ok.ru/team", "WhatsApp": "https://wa.me/79",
}
_NAMES, _LINKS = list(NETWORK_LINKS), list(NETWORK_LINKS.values())
_AT = f"original_url || ' @ ' || strftime(fetched_at, '%Y-%m-%d %H:%M')"
PAGE_CONTACTS = f"""SELECT type, value, CASE WHEN type = 'phone' THEN CASE WHEN max(sure) = 1 THEN 'high' ELSE 'low' END END AS confidence, count(DISTINCT source) AS pages, min(source) AS example FROM (
  SELECT 'email' AS type, 'desk' || (doc_id % 97) || '@mail.test' AS value, 0 AS sure, {_AT} AS source FROM documents WHERE original_url IS NOT NULL AND fetched_at IS NOT NULL UNION ALL
  SELECT 'phone', '7912345' || lpad(CAST(1000 + doc_id % 53 AS VARCHAR), 4, '0'), 1, {_AT} FROM documents WHERE original_url IS NOT NULL AND fetched_at IS NOT NULL UNION ALL
  SELECT 'phone', '7498765' || lpad(CAST(2000 + doc_id % 31 AS VARCHAR), 4, '0'), 0, {_AT} FROM documents WHERE original_url IS NOT NULL AND fetched_at IS NOT NULL UNION ALL
  SELECT [{Q.quoted(_NAMES)}][doc_id % 9 + 1], [{Q.quoted(_LINKS)}][doc_id % 9 + 1] || (doc_id % 7), 0, {_AT} FROM documents WHERE original_url IS NOT NULL AND fetched_at IS NOT NULL) GROUP BY type, value"""


def contact_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages made of documents' ids, with contacts in links, in text, and hidden ones in scripts; and where they stand."""
    k = lambda n, base=0, width=0: F.lpad((F.lit(base) + F.col("doc_id") % n).cast("string"), width, "0") if width else (F.lit(base) + F.col("doc_id") % n).cast("string")
    docs = table(spark, d, "documents").filter("original_url is not null and fetched_at is not null").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("store_path"), "original_url", F.date_format("fetched_at", "yyyyMMddHHmmss").alias("timestamp"))
    link = F.concat(F.get(F.array(*map(F.lit, _LINKS)), F.col("doc_id") % 9), k(7))
    page = F.concat(
        F.lit("<html><script>var x = 'hidden@script.test 8 (999) 111-22-33';</script><body><a href=\"MAILTO:Desk"), k(97), F.lit('@mail.test?subject=x">write</a> <a href="tel:8 912 345 '), k(53, 1000, 4), F.lit('">call</a><p>Logo <img src="a@2x.png"> +7498765'), k(31, 2000, 4), F.lit(' <a href="'), link, F.lit('/">us</a></body></html>'),
    )
    return docs.select("store_path", page.alias("html")), docs.select("store_path", C.seen_at("original_url", "timestamp").alias("source"))


@query(PAGE_CONTACTS)
def page_contacts(spark, d):
    """Contacts of HTML pages: visible text, mailto and tel links, profiles of all networks."""
    pages, where = contact_pages(spark, d)
    return C.contacts(html.visible(pages), where)


@query(f"SELECT type AS network, count(*) AS profiles, CAST(sum(pages) AS BIGINT) AS pages FROM ({PAGE_CONTACTS}) WHERE type NOT IN ('email', 'phone') GROUP BY type")
def contacts_by_network(spark, d):
    return C.by_network(page_contacts(spark, d))


# -- metadata --------------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT trim(n)) AS people FROM (SELECT unnest([author, lastmodifiedby, manager]) AS n FROM docmeta) WHERE length(trim(n)) > 0")
def distinct_people(spark, d):
    return C.distinct_people(table(spark, d, "docmeta"))


@F.pandas_udf(T.BinaryType())
def _file(author: pd.Series, title: pd.Series, k: pd.Series) -> pd.Series:
    """A PDF, an Office package, a PDF without fields, a damaged package and no document, by turns."""
    make = (
        lambda a, t: builders.pdf({"Author": "x" + a, "Title": t}), lambda a, t: builders.office({"dc:creator": "x" + a}, {}), lambda a, t: builders.pdf({}), lambda a, t: b"PK\x03\x04" + a.encode(), lambda a, t: b"plain " + t.encode(),
    )
    return pd.Series([make[n % 5](a or "", t or "") for a, t, n in zip(author, title, k)])


@query("""SELECT ['', '', 'metadata not found', 'file is damaged', 'does not look like a PDF'][k + 1] AS reason, CAST(sum(n) AS BIGINT) AS appearances
FROM (SELECT digest, min(meta_id) % 5 AS k, count(*) AS n FROM docmeta GROUP BY digest) WHERE k >= 2 AND digest IS NOT NULL GROUP BY 1""")
def skip_reasons(spark, d):
    """Why documents give no metadata, counted over all appearances of their files."""
    rows = table(spark, d, "docmeta").select("meta_id", "digest", "author", "title")
    one = C.first_per(rows, ["digest"], ["meta_id"]).withColumn("content", _file("author", "title", "meta_id"))
    kind = F.when(F.col("meta_id") % 5 % 2 == 0, "pdf").otherwise("docx")
    return C.skip_reasons(rows, one.select("digest", binary.document_metadata(F.col("content"), kind).getField("reason").alias("reason")))


@query(f"""WITH c AS (SELECT digest, first(original_url ORDER BY photo_id) AS u, first(make ORDER BY photo_id) AS make, count(*) AS n FROM photoexif GROUP BY digest)
SELECT p.photo_id, nullif(c.make, '') AS make FROM photoexif p JOIN c USING (digest)""")
def photo_appearances(spark, d):
    """EXIF is read once a file and given to all its appearances."""
    photos = table(spark, d, "photoexif")
    one = C.first_per(photos.select("photo_id", "digest", "make", "model", "lat", "lon"), ["digest"], ["photo_id"])
    read = one.select("digest", binary.photo_metadata(content_queries._jpeg("make", "model", "lat", "lon")).getField("make").alias("make"))
    return C.fan_out(photos.select("photo_id", "digest"), read).select("photo_id", "make")


# -- structure and integrity -----------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def _built(text: pd.Series, k: pd.Series) -> pd.Series:
    """Sound and damaged files of each kind by turns: PDF, JPEG, package, page."""
    out = []
    for t, n in zip(text, k):
        t = t or ""
        pdf, jpeg, office = builders.pdf({"Title": t}), builders.jpeg({0x010F: t}), builders.office({"dc:title": t}, {})
        kinds = (pdf, pdf[:-6], b"x" + pdf, jpeg, jpeg[:-2], jpeg[2:], office, office[: len(office) // 2], b"<html>" + t.encode(), t.encode() or b"-", b"")
        out.append(kinds[n % 11])
    return pd.Series(out)


_EXTS = ("pdf", "pdf", "pdf", "jpg", "jpg", "jpg", "docx", "docx", "html", "html", "html")
_STATES = ("OK", "WARNING", "BROKEN", "OK", "WARNING", "BROKEN", "OK", "BROKEN", "OK", "WARNING", "BROKEN")


@query(f"SELECT meta_id, [{Q.quoted(_STATES)}][meta_id % 11 + 1] AS status FROM docmeta")
def structure_built(spark, d):
    """Structure check of built files, sound, cut off and damaged."""
    rows = table(spark, d, "docmeta").select("meta_id", _built("title", "meta_id").alias("content"), F.concat(F.lit("http://s.test/f."), F.get(F.array(*map(F.lit, _EXTS)), F.col("meta_id") % 11)).alias("url"))
    return rows.select("meta_id", binary.structure(F.col("content"), "url", F.lit("")).getField("status").alias("status"))


_CHECKED = """SELECT status, count(*) AS files, CAST(sum(n) AS BIGINT) AS appearances FROM (
  SELECT b.digest, b.n, CASE WHEN b.k % 5 = 0 THEN 'MISSING' WHEN coalesce(b.body, '') = '' THEN 'BROKEN' WHEN b.k % 5 = 1 THEN 'MODIFIED' ELSE 'OK' END AS status
  FROM (SELECT store_path AS digest, min(blob_id) AS k, first(body ORDER BY blob_id) AS body, 2 * count(*) AS n FROM blobs GROUP BY store_path) b) GROUP BY status"""


@query(_CHECKED)
def verify_counts(spark, d):
    """The verification of a made-up archive: each stored text twice captured, a fifth of the files lost, a fifth changed."""
    blobs = table(spark, d, "blobs").select("blob_id", F.col("store_path").alias("digest"), F.col("body").cast("binary").alias("content"))
    twice = blobs.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    sha = F.when(F.col("blob_id") % 5 == 1, F.lit("0" * 64)).otherwise(F.sha2("content", 256))
    rows = twice.select((F.col("blob_id") * 2 + F.col("i")).alias("row_ord"), "digest", F.lit("http://s.test/f.txt").alias(U), F.lit("1").alias("timestamp"), F.lit("text/plain").alias(M), F.upper(sha).alias("sha256"))
    return C.integrity_summary(binary.integrity(rows, blobs.filter("blob_id % 5 <> 0").select("digest", "content")))


# -- oracles of parsers ----------------------------------------------------------------------------------------


def _fields_sql() -> str:
    field = "(\"(?:[^\"]|\"\")*\"|[^\",]*)"
    cols = []
    for i, name in enumerate(("original_url", "timestamp", "digest", "mimetype", "statuscode", "length", "reason"), 1):
        raw = f"CASE WHEN kind = 'index' THEN string_split(raw, ' ')[{i}] ELSE regexp_extract(raw, '(?s)^(?:(?:\"(?:[^\"]|\"\")*\"|[^\",]*),){{{i - 1}}}{field}', 1) END"
        cols.append(f"CASE WHEN ({raw}) LIKE '\"%' AND kind = 'queue' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END AS {name}")
    return ", ".join(cols)


SQL["p7_loaded"] = f"""WITH {data_queries.RECORDS_SQL} SELECT line_id, kind, original_url, timestamp, digest, mimetype, statuscode, CAST(nullif(nullif(length, ''), '-') AS BIGINT) AS length, reason
FROM (SELECT line_id, kind, {_fields_sql()} FROM records JOIN (SELECT line_id FROM judged WHERE reason IS NULL) USING (line_id))"""

_SIGNS = "abcdefghijklmnopqrstuvwxyz234567"
_BASE32 = " || ".join(f"substr('{_SIGNS}', CAST((CAST('0x' || substr(h, {10 * g + 1}, 10) AS BIGINT) >> {35 - 5 * j}) & 31 AS INTEGER) + 1, 1)" for g in range(4) for j in range(8))
SQL["blob_base32"] = f"SELECT blob_id, {_BASE32} AS digest FROM (SELECT blob_id, sha1(body) AS h FROM blobs)"
