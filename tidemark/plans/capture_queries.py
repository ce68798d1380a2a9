"""Queries of the capture operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import times, urls, values
from tidemark.operators import captures as C
from tidemark.operators import error_parse
from tidemark.plans import data_queries
from tidemark.plans import sql_parts as Q
from tidemark.runtime import join_small, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


SIZE = Q.number_or_zero("size_bytes")
TIMELINE = f"""SELECT original_url, count(*) AS versions, min(timestamp) AS first, max(timestamp) AS last,
  first({SIZE} ORDER BY timestamp, row_ord) AS first_size, first({SIZE} ORDER BY timestamp DESC, row_ord) AS last_size FROM captures GROUP BY original_url"""


@query(TIMELINE)
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return C.timeline(table(spark, d, "captures"))


@query(f"SELECT original_url, first FROM ({TIMELINE}) WHERE versions = 1")
def single_capture_urls(spark, d):
    return C.timeline(table(spark, d, "captures")).filter("versions = 1").select("original_url", "first")


@query(f"SELECT original_url, last_size - first_size AS delta FROM ({TIMELINE}) WHERE versions > 1 AND first_size <> 0 AND last_size <> 0")
def size_change(spark, d):
    return C.size_change(C.timeline(table(spark, d, "captures")))


@query("SELECT digest, min(row_ord) AS row_ord, first(original_url ORDER BY row_ord) AS original_url FROM captures GROUP BY digest")
def dedup_by_digest(spark, d):
    return C.dedup_by_digest(table(spark, d, "captures")).select("digest", "row_ord", "original_url")


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS capture_count, count(*) AS unique_blob_count, CAST(sum(a) AS BIGINT) AS total_capture_bytes, CAST(sum(f) AS BIGINT) AS unique_storage_bytes
FROM (SELECT digest, count(*) AS n, sum({Q.digits_or_zero("size_bytes")}) AS a, first({Q.digits_or_zero("size_bytes")} ORDER BY row_ord) AS f FROM captures GROUP BY digest)""")
def manifest_totals(spark, d):
    return C.totals(table(spark, d, "captures"))


@query(f"""WITH p AS (SELECT *, {Q.relative_path("original_url")} AS rel_path FROM captures)
SELECT rel_path, first(row_ord ORDER BY timestamp DESC, row_ord) AS row_ord, max(timestamp) AS timestamp FROM p GROUP BY rel_path""")
def latest_site(spark, d):
    return C.latest_site(table(spark, d, "captures")).select("rel_path", "row_ord", "timestamp")


@query(f"""SELECT coalesce(strftime({Q.parsed("timestamp")}, '%Y-%m-%d_%H-%M-%S'), {Q.sanitized("timestamp")}) AS version, count(*) AS captures FROM captures GROUP BY 1""")
def versions_by_date(spark, d):
    return C.versions(table(spark, d, "captures"))


@query(f"SELECT ext, captures FROM (SELECT {Q.extension('original_url')} AS ext, count(*) AS captures FROM captures GROUP BY 1) ORDER BY captures DESC, ext LIMIT 25")
def ext_histogram(spark, d):
    """The 25 most frequent extensions."""
    return C.extensions(table(spark, d, "captures")).orderBy(F.desc("captures"), "ext").limit(25)


COLUMNS = ", ".join(schema.CAPTURE_COLUMNS)


@query(f"""SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY original_url, timestamp ORDER BY g DESC, row_ord DESC) AS rn
FROM (SELECT row_ord, {COLUMNS}, 0 AS g FROM captures UNION ALL SELECT arrival_id, {COLUMNS}, 1 FROM incoming)) WHERE rn = 1""")
def upsert_captures(spark, d):
    new = table(spark, d, "incoming").withColumnRenamed("arrival_id", "row_ord")
    return C.upsert(table(spark, d, "captures"), new).select(*schema.CAPTURE_COLUMNS)


FAILED_SQL = f"""{data_queries.RECORDS_SQL}, queue AS (SELECT c.line_id, {", ".join(
    f"CASE WHEN v LIKE '\"%' THEN replace(substr(v, 2, length(v) - 2), '\"\"', '\"') ELSE v END AS f{i}".replace("v ", f"v{i} ").replace("(v,", f"(v{i},").replace("length(v)", f"length(v{i})").replace("ELSE v ", f"ELSE v{i} ")
    for i in (1, 2, 3, 7))}
  FROM (SELECT line_id, {", ".join(f'''regexp_extract(raw, '(?s)^(?:(?:"(?:[^"]|"")*"|[^",]*),){{{i - 1}}}("(?:[^"]|"")*"|[^",]*)', 1) AS v{i}''' for i in (1, 2, 3, 7))} FROM clean WHERE kind = 'queue') c
  JOIN judged j ON j.line_id = c.line_id AND j.reason IS NULL)"""


def failures(spark, d) -> DataFrame:
    """Good records of the failure queue."""
    lines = table(spark, d, "rawlines").filter("kind = 'queue'")
    good = error_parse.parse_lines(lines).filter("reason is null")
    return good.select(F.col("line_id").alias("row_ord"), *[F.get("fields", i).alias(n) for i, n in enumerate(schema.FAILURE_COLUMNS)])


def index_rows(spark, d) -> DataFrame:
    """Good records of the index pages."""
    good = error_parse.parse_lines(table(spark, d, "rawlines")).filter("reason is null and kind = 'index'")
    return good.select(F.col("line_id").alias("row_ord"), *[F.get("fields", i).alias(n) for i, n in enumerate(schema.INDEX_COLUMNS)])


@query(f"WITH {FAILED_SQL} SELECT {Q.is_permanent('f7')} AS permanent, count(*) AS failures FROM queue GROUP BY 1")
def failure_summary(spark, d):
    return failures(spark, d).groupBy(C.is_permanent(F.col("reason")).alias("permanent")).agg(F.count("*").alias("failures"))


@query(f"""WITH {FAILED_SQL} SELECT f1 AS original_url, f2 AS timestamp, f3 AS digest, CASE WHEN {Q.is_permanent('f7')} AND NOT starts_with(ltrim(substr(f7, 1, 300)), '[PERMANENT]') THEN '[PERMANENT] ' || substr(f7, 1, 300) ELSE substr(f7, 1, 300) END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY f1, f2, lower(trim(f3)) ORDER BY line_id) AS rn FROM queue) WHERE rn = 1""")
def failure_queue(spark, d):
    """The queue with one row per failure and marked reasons."""
    rows = failures(spark, d)
    merged = C.merge_failures(rows, rows.filter("false"))
    return merged.select("original_url", "timestamp", "digest", C.marked_reason(F.col("reason")).alias("reason"))


FETCH = f"""WITH good AS (SELECT store_path FROM blobs WHERE length > 0),
seen AS (SELECT original_url, timestamp, bool_or(g.store_path IS NOT NULL) AS ok FROM captures LEFT JOIN good g USING (store_path) GROUP BY 1, 2),
sha AS (SELECT digest, first(sha256 ORDER BY row_ord) AS expected_sha256 FROM captures GROUP BY digest)
SELECT arrival_id, s.ok IS NOT NULL AS repair, expected_sha256 FROM incoming i LEFT JOIN seen s USING (original_url, timestamp) LEFT JOIN sha ON sha.digest = i.digest WHERE s.ok IS NULL OR NOT s.ok"""


def _to_fetch(spark, d):
    good = table(spark, d, "blobs").filter("length > 0").select("store_path")
    return C.to_fetch(table(spark, d, "incoming"), table(spark, d, "captures"), good)


@query(FETCH)
def fresh_captures(spark, d):
    """Incoming rows that are new, or whose stored file is missing."""
    return _to_fetch(spark, d).select("arrival_id", "repair", "expected_sha256")


@query(f"""SELECT arrival_id FROM incoming i WHERE NOT EXISTS (WITH {FAILED_SQL} SELECT 1 FROM queue q WHERE {Q.is_permanent('q.f7')} AND q.f1 = i.original_url AND q.f2 = i.timestamp AND lower(trim(q.f3)) = lower(trim(i.digest)))""")
def skip_permanent(spark, d):
    """Incoming rows that didn't fail for good before."""
    return C.without_permanent(table(spark, d, "incoming"), failures(spark, d)).select("arrival_id")


@query(f"""SELECT row_ord, doc_ext FROM (SELECT row_ord, {Q.document_extension("original_url", "mimetype")} AS doc_ext FROM captures) WHERE doc_ext IN ('pdf', 'docx', 'xlsx', 'jpg') AND doc_ext NOT IN ('xlsx')""")
def type_filter(spark, d):
    return C.of_types(table(spark, d, "captures"), (".PDF", "docx", "xlsx", "jpg"), ("xlsx",)).select("row_ord", "doc_ext")


@query(f"SELECT row_ord, {Q.domain('original_url')} AS domain, {Q.extension('original_url')} AS ext, {Q.site('original_url')} AS site, {Q.link_key('original_url')} AS link_key FROM captures")
def url_parts(spark, d):
    u = "original_url"
    return table(spark, d, "captures").select("row_ord", urls.domain(u).alias("domain"), urls.extension(u).alias("ext"), urls.site(u).alias("site"), urls.link_key(u).alias("link_key"))


def _registry_sql(u: str) -> str:
    full = f"CASE WHEN {Q.path(u)} = '' THEN '/' ELSE {Q.path(u)} END"
    head = f"{Q.scheme(u)} || '://' || lower({Q.raw_authority(u)})"
    tail = f"CASE WHEN {Q.query(u)} = '' THEN '' ELSE '?' || {Q.query(u)} END"
    return f"""SELECT DISTINCT original_url, {Q.link_key("k")} AS key FROM (
  SELECT original_url, {u} AS k FROM captures UNION ALL
  SELECT original_url, {head} || regexp_replace({full}, '/+$', '') || '/index.html' || {tail} FROM captures WHERE ({full}) LIKE '%/' OR NOT regexp_matches(regexp_extract({full}, '([^/]*)$', 1), '^[.]*[^.].*[.]') UNION ALL
  SELECT original_url, {head} || regexp_replace({full}, 'index[.]html$', '') || {tail} FROM captures WHERE ({full}) LIKE '%/index.html') WHERE {Q.link_key("k")} IS NOT NULL"""


@query(_registry_sql("original_url"))
def registry_keys(spark, d):
    pages = table(spark, d, "captures").select("original_url").distinct()
    return pages.select("original_url", F.explode(urls.registry_keys("original_url")).alias("key"))


@query(f"""SELECT row_ord, coalesce(strftime({Q.parsed("timestamp")}, '%Y-%m-%d %H:%M'), timestamp) AS pretty, {Q.date_only("timestamp")} AS day, {Q.human_size("size_bytes")} AS size FROM captures""")
def rendered(spark, d):
    return table(spark, d, "captures").select("row_ord", times.pretty("timestamp").alias("pretty"), times.date_only("timestamp").alias("day"), values.human_size("size_bytes").alias("size"))


@query(f"SELECT row_ord, {Q.store_digest('original_url', 'timestamp', 'digest')} AS store_digest FROM captures")
def store_digests(spark, d):
    return table(spark, d, "captures").select("row_ord", values.store_digest("original_url", "timestamp", "digest").alias("store_digest"))


@query("SELECT blob_id, sha256(body) AS sha256, CAST(octet_length(encode(body)) AS BIGINT) AS bytes FROM blobs")
def blob_hashes(spark, d):
    body = F.col("body").cast("binary")
    return table(spark, d, "blobs").select("blob_id", F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("bigint").alias("bytes"))


@query()
def blob_base32(spark, d):
    """Base32 SHA-1 of every body, as the archive's digests are spelled."""
    return table(spark, d, "blobs").select("blob_id", values.sha1_base32(F.col("body").cast("binary")).alias("digest"))


HISTORY = "SELECT DISTINCT '/u/' || user_id AS original, strftime(ts, '%Y%m%d%H%M%S') AS timestamp, CASE event_type WHEN 'error' THEN '404' WHEN 'signup' THEN '301' ELSE '200' END AS statuscode FROM events"


def status_history(spark, d) -> DataFrame:
    """The events table in the shape of a status history."""
    status = F.when(F.col("event_type") == "error", "404").when(F.col("event_type") == "signup", "301").otherwise("200")
    return table(spark, d, "events").select(F.concat(F.lit("/u/"), "user_id").alias("original"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), status.alias("statuscode"))


@query(f"""WITH h AS ({HISTORY}) SELECT original, max(CASE WHEN statuscode = '200' THEN timestamp END) AS last_ok, max(timestamp) AS died_at, first(statuscode ORDER BY timestamp DESC, statuscode DESC) AS last_status
FROM h GROUP BY original HAVING max(CASE WHEN statuscode = '200' THEN timestamp END) IS NOT NULL AND regexp_matches(first(statuscode ORDER BY timestamp DESC, statuscode DESC), '^[45]')""")
def removed_pages(spark, d):
    return C.removed(status_history(spark, d))


STEM = "CASE WHEN {q} = '' THEN 'file' ELSE {q} END"
_BASE = STEM.format(q=Q.basename("original_url"))
_CLEAN = Q.sanitized(f"url_decode(replace({_BASE}, '+', '%2B'))")
_EXT = f"regexp_extract({_CLEAN}, '^[.]*[^.].*([.][^.]*)$', 1)"
DESTINATIONS = f"""WITH docs AS (SELECT row_ord, timestamp, {Q.document_extension("original_url", "mimetype")} AS doc_ext, {Q.store_digest("original_url", "timestamp", "digest")} AS digest, {_CLEAN} AS base, {_EXT} AS ext FROM captures),
named AS (SELECT row_ord, doc_ext, digest, {Q.date_only("timestamp")} || '_' || substr(base, 1, length(base) - length(ext)) || CASE WHEN lower(regexp_replace(ext, '^[.]', '')) <> lower(doc_ext) THEN '.' || doc_ext ELSE ext END AS name
  FROM docs WHERE doc_ext IN ({Q.quoted(schema.DOCUMENT_EXTENSIONS)})),
owned AS (SELECT *, first_value(digest) OVER (PARTITION BY lower(name) ORDER BY row_ord) AS owner FROM named)
SELECT row_ord, doc_ext, digest, CASE WHEN digest = owner THEN name ELSE regexp_extract(name, '^(.*?)([.][^.]*)?$', 1) || '_' || substr(digest, 1, 6) || regexp_extract(name, '([.][^.]*)$', 1) END AS destination FROM owned"""


@query(DESTINATIONS)
def dest_collisions(spark, d):
    return C.destinations(table(spark, d, "captures"))


# -- contacts, people, photos -------------------------------------------------------------------------------

CONTACT_ROWS = """SELECT doc_id, text || ' tel 8 (9' || lpad(CAST(doc_id % 90 AS VARCHAR), 2, '0') || ') 345-67-' || lpad(CAST(doc_id % 89 AS VARCHAR), 2, '0') || ' write Desk' || (doc_id % 97) || '@mail.test or https://t.me/desk' || (doc_id % 13) || '/' AS text, original_url FROM documents WHERE text IS NOT NULL"""


def contact_texts(spark, d) -> DataFrame:
    """Documents with a made-up signature line, since the texts hold no contacts of their own."""
    two = lambda n: F.lpad((F.col("doc_id") % n).cast("string"), 2, "0")
    sign = F.concat(F.lit(" tel 8 (9"), two(90), F.lit(") 345-67-"), two(89), F.lit(" write Desk"), (F.col("doc_id") % 97).cast("string"), F.lit("@mail.test or https://t.me/desk"), (F.col("doc_id") % 13).cast("string"), F.lit("/"))
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select(F.col("doc_id").cast("string").alias("store_path"), F.concat("text", sign).alias("text"), F.col("original_url").alias("source"))


_PHONE = values.PHONE.replace("\\-", "-")
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_PHONE_SQL = f"CASE WHEN length({_DIGITS}) = 11 AND {_DIGITS} LIKE '8%' THEN '7' || substr({_DIGITS}, 2) ELSE {_DIGITS} END"


@query(f"""WITH t AS ({CONTACT_ROWS}), hits AS (
  SELECT 'email' AS type, lower(unnest(regexp_extract_all(text, '{values.EMAIL}'))) AS value, 0 AS sure, original_url FROM t UNION ALL
  SELECT 'phone', {_PHONE_SQL}, CASE WHEN regexp_matches(hit, '[\\s()-]') THEN 1 ELSE 0 END, original_url FROM (SELECT unnest(regexp_extract_all(text, '{_PHONE}')) AS hit, original_url FROM t) UNION ALL
  SELECT 'Telegram', regexp_replace(unnest(regexp_extract_all(text, '(?i)https?://(?:www\\.)?(?:t\\.me|telegram\\.me)/[A-Za-z0-9_]+')), '/+$', ''), 0, original_url FROM t)
SELECT type, value, CASE WHEN type = 'phone' THEN CASE WHEN max(sure) = 1 THEN 'high' ELSE 'low' END END AS confidence, count(DISTINCT original_url) AS pages, min(original_url) AS example FROM hits
WHERE (type <> 'email' OR NOT ({" OR ".join(f"contains(value, '{p}')" for p in values.JUNK_EMAIL_PARTS)}))
  AND (type <> 'phone' OR (length(value) BETWEEN 10 AND 15 AND len(list_distinct(string_split(value, ''))) > 2)) GROUP BY type, value""")
def contacts(spark, d):
    texts = contact_texts(spark, d)
    return C.contacts(texts.select("store_path", "text"), texts.select("store_path", "source"))


@query("""WITH f AS (SELECT 'person' AS kind, trim(author) AS name FROM docmeta UNION ALL SELECT 'person', trim(lastmodifiedby) FROM docmeta UNION ALL SELECT 'person', trim(manager) FROM docmeta UNION ALL SELECT 'organisation', trim(company) FROM docmeta)
SELECT kind, name, count(*) AS mentions FROM f WHERE length(name) > 0 AND (kind <> 'person' OR length(name) < 100) GROUP BY kind, name""")
def people_orgs(spark, d):
    return C.people(table(spark, d, "docmeta"))


@query("SELECT make, model, count(*) AS photos, count(lat) AS with_gps FROM photoexif GROUP BY make, model")
def cameras(spark, d):
    return table(spark, d, "photoexif").groupBy("make", "model").agg(F.count("*").alias("photos"), F.count("lat").alias("with_gps"))


# -- link graph, sitemaps, robots -----------------------------------------------------------------------------

PAGES_SQL = f"""pages AS (SELECT DISTINCT original_url AS url FROM captures WHERE {Q.raw_authority("original_url")} <> '' AND {Q.extension("original_url")} IN ({Q.quoted(schema.HTML_EXTENSIONS)})),
links AS (SELECT url AS source, t AS target FROM pages, LATERAL (SELECT unnest([{Q.scheme("url")} || '://' || {Q.raw_authority("url")} || '/', url || '#top', 'http://mirror.' || {Q.host("url")} || '/x']) AS t)),
keys AS (SELECT DISTINCT key FROM ({_registry_sql("original_url")})),
graph AS (SELECT source, target, k.key IS NOT NULL AS is_internal FROM links LEFT JOIN keys k ON k.key = {Q.link_key("target")})"""


def demo_pages(spark, d) -> DataFrame:
    """HTML pages with three links each, made from the captured URLs (the stored texts carry no markup)."""
    u = F.col("original_url")
    pages = table(spark, d, "captures").filter((urls.raw_authority(u) != "") & urls.extension(u).isin(*schema.HTML_EXTENSIONS)).select(u.alias("url")).distinct()
    html = F.concat(F.lit('<html><body><a href="/">home</a><p><a href="'), F.regexp_replace(F.concat("url", F.lit("#top")), "&", "&amp;"), F.lit('">up</a> <a href="http://mirror.'), urls.hostname("url"), F.lit('/x">mirror</a> <a href="mailto:x@y.test">m</a></body></html>'))
    return pages.select("url", html.alias("html"))


def graph(spark, d) -> DataFrame:
    from tidemark.content import html

    links = html.links(demo_pages(spark, d)).select(F.lit("latest").alias("group_id"), F.col("url").alias("source"), "target")
    registry = table(spark, d, "captures").select(F.lit("latest").alias("group_id"), F.col("original_url").alias("url")).distinct()
    return C.edges(links, registry)


@query(f"WITH {PAGES_SQL} SELECT source, target, is_internal FROM graph")
def link_edges(spark, d):
    return graph(spark, d).select("source", "target", "is_internal")


@query(f"WITH {PAGES_SQL} SELECT target, count(DISTINCT source) AS sources FROM graph WHERE is_internal GROUP BY target ORDER BY sources DESC, target LIMIT 30")
def most_linked(spark, d):
    return C.most_linked(graph(spark, d))


@query(f"WITH {PAGES_SQL} SELECT lower({Q.raw_authority('target')}) AS host, count(*) AS links FROM graph WHERE NOT is_internal AND {Q.raw_authority('target')} <> '' GROUP BY 1 ORDER BY links DESC, host LIMIT 50")
def external_domains(spark, d):
    return C.external_domains(graph(spark, d))


@query(f"WITH {PAGES_SQL} SELECT DISTINCT original_url AS url FROM captures WHERE original_url NOT IN (SELECT target FROM graph)")
def isolated_pages(spark, d):
    known = table(spark, d, "captures").filter("original_url is not null").select(F.col("original_url").alias("url"))
    return C.isolated(known, graph(spark, d))


def sitemap_texts(spark, d) -> DataFrame:
    """One sitemap or robots text per incoming URL."""
    rows = table(spark, d, "incoming").filter("original_url is not null")
    text = F.concat(F.lit("User-agent: *\nDISALLOW: /private"), (F.col("arrival_id") % 7).cast("string"), F.lit("\nallow: /open\nSitemap: http://maps.test/a.xml\n<url><LOC>\n "), "original_url", F.lit(" </LOC></url>"))
    return rows.select(F.col("original_url").alias("source"), text.alias("text"))


@query(f"""SELECT DISTINCT original_url AS url FROM incoming i WHERE original_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {Q.link_key("original_url")} AS k FROM captures) c WHERE c.k = {Q.link_key("i.original_url")})""")
def sitemap_missing(spark, d):
    listed = C.sitemap_urls(sitemap_texts(spark, d)).select("url")
    return C.missing_from(listed, table(spark, d, "captures").select(F.col("original_url").alias("url")))


@query("""SELECT rule, value, count(*) AS sources FROM (
  SELECT DISTINCT original_url, 'disallow' AS rule, '/private' || (arrival_id % 7) AS value FROM incoming WHERE original_url IS NOT NULL UNION ALL
  SELECT DISTINCT original_url, 'allow', '/open' FROM incoming WHERE original_url IS NOT NULL UNION ALL
  SELECT DISTINCT original_url, 'sitemap', 'http://maps.test/a.xml' FROM incoming WHERE original_url IS NOT NULL) GROUP BY rule, value""")
def robots_rules(spark, d):
    return C.robots_rules(sitemap_texts(spark, d)).groupBy("rule", "value").agg(F.count("*").alias("sources"))


# -- overview --------------------------------------------------------------------------------------------------


@query(f"""SELECT 'captures' AS metric, count(*) AS n FROM captures UNION ALL SELECT 'digests', count(DISTINCT digest) FROM captures UNION ALL SELECT 'urls', count(DISTINCT original_url) FROM captures
UNION ALL SELECT 'sites', count(DISTINCT {Q.site("original_url")}) FROM captures UNION ALL SELECT 'versions', count(DISTINCT timestamp) FROM captures
UNION ALL SELECT 'documents', count(*) FROM captures WHERE {Q.document_extension("original_url", "mimetype")} IN ({Q.quoted(schema.DOCUMENT_EXTENSIONS)})
UNION ALL SELECT 'images', count(*) FROM captures WHERE {Q.document_extension("original_url", "mimetype")} IN ({Q.quoted(schema.IMAGE_EXTENSIONS)})""")
def dashboard_metrics(spark, d):
    """The counts on the overview page, in one pass over the captures."""
    kind = urls.document_extension("original_url", "mimetype")
    one = table(spark, d, "captures").agg(
        F.count("*").alias("captures"), F.count_distinct("digest").alias("digests"), F.count_distinct("original_url").alias("urls"), F.count_distinct(urls.site("original_url")).alias("sites"),
        F.count_distinct("timestamp").alias("versions"), F.count_if(kind.isin(*schema.DOCUMENT_EXTENSIONS)).alias("documents"), F.count_if(kind.isin(*schema.IMAGE_EXTENSIONS)).alias("images"),
    )
    return one.unpivot([], one.columns, "metric", "n")


@query(f"SELECT {Q.site('original_url')} AS site, count(*) AS captures, count(DISTINCT digest) AS files FROM captures GROUP BY 1")
def site_summary(spark, d):
    return table(spark, d, "captures").groupBy(urls.site("original_url").alias("site")).agg(F.count("*").alias("captures"), F.count_distinct("digest").alias("files"))


@query(f"""SELECT c.row_ord, b.blob_id IS NOT NULL AS stored FROM captures c LEFT JOIN blobs b USING (store_path)""")
def stored_captures(spark, d):
    """Which captures have a stored text."""
    blobs = table(spark, d, "blobs").select("store_path", F.lit(True).alias("hit"))
    return join_small(table(spark, d, "captures").select("row_ord", "store_path"), blobs, ["store_path"], "left").select("row_ord", F.coalesce("hit", F.lit(False)).alias("stored"))
