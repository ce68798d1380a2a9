"""Relational operators over captures: dedup, upsert, differences, views, timelines.

'First' and 'last' always mean by row_ord, the order rows were written in; Spark's row order means nothing.
Groups are aggregated with min_by / max_by, which combine before the shuffle, so a URL or digest that holds a
third of the rows is one partial result per map task, never one sorted group in a window.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import times, urls, values
from tidemark.runtime import join_small, new_dir, written


def first_per(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the order. NULL keys form a group of their own."""
    rest = [c for c in rows.columns if c not in keys]
    picked = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order)).alias("__row")
    return rows.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def dedup_by_digest(captures: DataFrame) -> DataFrame:
    """The first capture of every digest (raw spelling; NULL is a value)."""
    return first_per(captures, ["digest"], ["row_ord"])


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("original_url", "timestamp")) -> DataFrame:
    """old with rows replaced by new ones of the same key; the last of several new rows counts.

    Both need row_ord. Only the columns of old are kept; those new lacks become NULL.
    """
    cols = old.columns
    fresh = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in cols])
    both = old.withColumn("__gen", F.lit(0)).unionByName(fresh.withColumn("__gen", F.lit(1)))
    return first_per(both, list(keys), ["__gen", "row_ord"], last=True).drop("__gen")


def timeline(captures: DataFrame) -> DataFrame:
    """Versions, first and last time and size of every URL."""
    at = F.struct("timestamp", "row_ord")
    size = values.number_or_zero("size_bytes")
    return captures.groupBy("original_url").agg(
        F.count("*").alias("versions"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
        F.min_by(size, at).alias("first_size"),
        F.max_by(size, F.struct("timestamp", -F.col("row_ord"))).alias("last_size"),
    )


def size_change(times_line: DataFrame) -> DataFrame:
    """Change of size of URLs with several versions of known size."""
    some = times_line.filter((F.col("versions") > 1) & (F.col("first_size") != 0) & (F.col("last_size") != 0))
    return some.select("original_url", (F.col("last_size") - F.col("first_size")).alias("delta"))


def removed(history: DataFrame) -> DataFrame:
    """URLs seen with status 200 whose last status is 4xx or 5xx. history: original, timestamp, statuscode."""
    distinct = history.select("original", "timestamp", "statuscode").distinct()
    by = distinct.groupBy("original").agg(
        F.max(F.when(F.col("statuscode") == "200", F.col("timestamp"))).alias("last_ok"),
        F.max("timestamp").alias("died_at"),
        F.max_by("statuscode", F.struct("timestamp", "statuscode")).alias("last_status"),
    )
    return by.filter(F.col("last_ok").isNotNull() & F.col("last_status").rlike("^[45]"))


def totals(captures: DataFrame) -> DataFrame:
    """Rows, distinct digests, bytes of all rows and of the first row of each digest."""
    size = values.digits_or_zero("size_bytes")
    per = captures.groupBy("digest").agg(F.count("*").alias("n"), F.sum(size).alias("all_bytes"), F.min_by(size, "row_ord").alias("first_bytes"))
    zero = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n)
    return per.agg(zero("n", "capture_count"), F.count("*").alias("unique_blob_count"), zero("all_bytes", "total_capture_bytes"), zero("first_bytes", "unique_storage_bytes"))


def latest_site(captures: DataFrame) -> DataFrame:
    """The newest capture of every relative path; the earliest row wins ties."""
    placed = captures.withColumn("rel_path", urls.relative_path("original_url")).withColumn("__late", -F.col("row_ord"))
    return first_per(placed, ["rel_path"], ["timestamp", "__late"], last=True).drop("__late")


def versions(captures: DataFrame) -> DataFrame:
    return captures.groupBy(times.folder("timestamp").alias("version")).agg(F.count("*").alias("captures"))


def extensions(captures: DataFrame) -> DataFrame:
    return captures.groupBy(urls.extension("original_url").alias("ext")).agg(F.count("*").alias("captures"))


def of_types(captures: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Captures by document type; exclusion wins, dots and case don't matter."""
    norm = lambda x: [t.strip().lstrip(".").lower() for t in x]
    kind = urls.document_extension("original_url", "mimetype")
    out = captures.withColumn("doc_ext", kind)
    if include:
        out = out.filter(F.col("doc_ext").isin(norm(include)))
    return out.filter(~F.col("doc_ext").isin(norm(exclude))) if exclude else out


def is_permanent(reason: Column) -> Column:
    """Failures that a retry won't mend: marked ones, HTTP 4xx but 408 and 429, wrong or empty content."""
    low = F.lower(reason)
    http = low.rlike(r"http error 4\d\d") & ~low.rlike(r"http error (408|429)")
    content = low.contains("sha-1 digest mismatch") | low.contains("file exceeds size limit") | low.contains("server returned an empty file")
    return F.coalesce(F.ltrim(reason).startswith(schema.PERMANENT_MARKER) | http | content, F.lit(False))


def marked_reason(reason: Column) -> Column:
    """At most 300 characters, with one permanence marker where it belongs."""
    short = F.substring(reason, 1, 300)
    marked = F.ltrim(short).startswith(schema.PERMANENT_MARKER)
    return F.when(is_permanent(reason) & ~marked, F.concat(F.lit(schema.PERMANENT_MARKER + " "), short)).otherwise(short)


def without_permanent(rows: DataFrame, failures: DataFrame, url: str = "original_url") -> DataFrame:
    """rows without those whose URL, time and digest the queue holds as failed for good. url: their column of addresses."""
    gone = failure_key(failures.filter(is_permanent(F.col("reason"))), "original_url").select(F.col("original_url").alias(url), "timestamp", "__digest").distinct()
    return failure_key(rows, url).join(gone, [url, "timestamp", "__digest"], "left_anti").drop("__digest")


def failure_key(rows: DataFrame, url: str) -> DataFrame:
    """rows plus the key of the failure queue: URL, time and the digest in lower case."""
    return rows.withColumn("__digest", F.lower(F.trim(F.coalesce("digest", F.lit("")))))


def merge_failures(old: DataFrame, new: DataFrame, recovered: DataFrame | None = None) -> DataFrame:
    """Failure queue after a run: first row per key, old rows before new ones, without what was recovered."""
    both = failure_key(old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1))), "original_url")
    one = first_per(both, ["original_url", "timestamp", "__digest"], ["__gen", "row_ord"])
    if recovered is not None:
        one = one.join(recovered.select("original_url", "timestamp").distinct(), ["original_url", "timestamp"], "left_anti")
    return one.drop("__gen", "__digest")


def to_fetch(index: DataFrame, captures: DataFrame, good_paths: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Index rows worth fetching, with repair BOOLEAN and the SHA-256 to expect.

    index: original_url, timestamp, digest (and more); captures: with store_path; good_paths: store_path of
    sound blobs. A row is fetched if its (URL, time) is unseen or its blob is missing or damaged; rows that
    failed for good are left out first.
    """
    rows = index if failures is None else without_permanent(index, failures)
    state = captures.join(good_paths.select("store_path").distinct().withColumn("__good", F.lit(True)), "store_path", "left")
    seen = state.groupBy("original_url", "timestamp").agg(F.coalesce(F.max("__good"), F.lit(False)).alias("__good"))
    sha = captures.groupBy("digest").agg(F.min_by("sha256", "row_ord").alias("expected_sha256"))
    out = rows.join(seen, ["original_url", "timestamp"], "left").filter(F.col("__good").isNull() | ~F.col("__good"))
    out = out.withColumn("repair", F.col("__good").isNotNull()).drop("__good")
    return out.join(sha, "digest", "left")


def repaired(captures: DataFrame, found: DataFrame) -> DataFrame:
    """Captures whose database row disagrees with their sound file, with sha256 and size_bytes set to the file's.

    captures: with blob, the name of their file; found: (digest, sha256, sha1, size) of the files. A file whose SHA-1
    isn't the one its name gives is damaged and repairs nothing.
    """
    names = F.col("blob").rlike("^[A-Za-z2-7]{32}$")
    files = found.filter(F.col("sha256").isNotNull()).groupBy("digest").agg(*(F.first(c).alias(f"__{c}") for c in ("sha256", "sha1", "size"))).withColumnRenamed("digest", "blob")
    both = captures.join(files, "blob").filter(~names | (F.lower("blob") == F.col("__sha1")))
    same = F.coalesce((F.lower(F.trim("sha256")) == F.col("__sha256")) & (values.digits_or_zero("size_bytes") == F.col("__size")), F.lit(False))
    # a different SHA-256 without a SHA-1 to vouch for the file means that the file changed
    unknown = (F.coalesce(F.trim("sha256"), F.lit("")) == "") | names
    fixed = both.filter(~same & unknown).withColumns({"sha256": F.col("__sha256"), "size_bytes": F.col("__size").cast("string")})
    return fixed.select(*[c for c in captures.columns if c != "blob"])


def destinations(captures: DataFrame) -> DataFrame:
    """Names in the document view: the first digest owns a name, others get a suffix of their digest."""
    kind = urls.document_extension("original_url", "mimetype")
    docs = captures.withColumn("doc_ext", kind).filter(F.col("doc_ext").isin(*schema.DOCUMENT_EXTENSIONS))
    # step by step: as one expression the plan outgrows what code generation compiles
    named = docs.withColumn("__base", urls.clean_basename("original_url")).withColumn("name", urls.dated_name(F.col("__base"), F.col("timestamp"), F.col("doc_ext"))).drop("__base")
    named = named.withColumn("digest", values.store_digest("original_url", "timestamp", "digest"))
    named = written(named.withColumn("__key", F.lower("name")), new_dir(captures.sparkSession, "named"))  # names are long expressions, used twice
    owner = named.groupBy("__key").agg(F.min_by("digest", "row_ord").alias("owner"), F.count_distinct("digest").alias("__n")).filter("__n > 1").drop("__n")
    # only contested names need their owner; a name everybody has is salted
    joined = join_small(named, owner, ["__key"], "left", salt=16).withColumn("owner", F.coalesce("owner", "digest"))
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    dest = F.when(F.col("digest") == F.col("owner"), F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.substring("digest", 1, 6), ext))
    return joined.select("row_ord", "doc_ext", "digest", dest.alias("destination"))


def _profile(kind: Column, address: Column) -> Column:
    return F.struct(kind, F.regexp_replace(address, "/+$", "").alias("value"), F.lit(0).alias("sure"))


def _first_match(pattern: str, text: Column) -> Column:
    return F.regexp_extract(text, pattern, 1)


def seen_at(url: Column | str, timestamp: Column | str) -> Column:
    """A page as a contact's source: its address and the minute of its capture."""
    return F.concat(urls.col(url), F.lit(" @ "), times.pretty(timestamp))


def contacts(texts: DataFrame, appearances: DataFrame) -> DataFrame:
    """E-mail addresses, phones and profiles with their pages.

    texts: (store_path, text[, addresses]), scanned once a file; addresses are the href and src of a page, in which
    mailto: and tel: count, and profiles. appearances: (store_path, source), fanned out after.
    Returns (type, value, confidence, pages, example).
    """
    hits = []
    text = F.coalesce("text", F.lit(""))
    links = F.coalesce("addresses", F.array().cast("array<string>")) if "addresses" in texts.columns else F.array().cast("array<string>")
    mail = lambda m: F.struct(F.lit("email").alias("type"), F.lower(m).alias("value"), F.lit(0).alias("sure"))
    phone = lambda m, sure: F.struct(F.lit("phone").alias("type"), values.clean_phone(m).alias("value"), sure.cast("int").alias("sure"))
    hits.append(F.transform(F.regexp_extract_all(text, F.lit(f"({values.EMAIL})")), mail))
    hits.append(F.transform(F.regexp_extract_all(text, F.lit(f"({values.PHONE})")), lambda m: phone(m, values.phone_confidence(m) == "high")))
    with_start = lambda start: F.filter(links, lambda x: F.lower(F.trim(x)).startswith(start))
    rest = lambda x: F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)
    hits.append(F.transform(with_start("mailto:"), lambda x: mail(F.nullif(F.trim(F.regexp_extract(rest(x), r"^([^?]*)", 1)), F.lit("")))))
    hits.append(F.transform(with_start("tel:"), lambda x: phone(rest(x), F.lit(True))))
    for network, pattern in values.NETWORKS.items():
        kind = F.lit(network).alias("type")
        hits.append(F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({pattern})")), partial(_profile, kind)))
        first = F.filter(F.transform(links, partial(_first_match, f"(?i)({pattern})")), lambda v: v != "")
        hits.append(F.transform(first, partial(_profile, kind)))
    found = texts.select("store_path", F.explode(F.flatten(F.array(*hits))).alias("h")).select("store_path", "h.*").filter(F.col("value").isNotNull())
    found = found.filter((F.col("type") != "email") | ~values.is_junk_email(F.col("value")))
    per_file = found.groupBy("store_path", "type", "value").agg(F.max("sure").alias("sure"))
    spread = per_file.join(appearances.select("store_path", "source").distinct(), "store_path")
    out = spread.groupBy("type", "value").agg(F.max("sure").alias("sure"), F.count_distinct("source").alias("pages"), F.min("source").alias("example"))
    sure = F.when(F.col("type") == "phone", F.when(F.col("sure") == 1, "high").otherwise("low"))
    return out.select("type", "value", sure.alias("confidence"), "pages", "example")


def by_network(found: DataFrame) -> DataFrame:
    """Profiles of contacts() by network: (network, profiles, pages), pages summed over its profiles."""
    return found.filter(F.col("type").isin(*values.NETWORKS)).groupBy(F.col("type").alias("network")).agg(F.count("*").alias("profiles"), F.sum("pages").alias("pages"))


def fan_out(captures: DataFrame, scanned: DataFrame) -> DataFrame:
    """Captures with what the scan of their file found: scanned has one row per digest, every appearance gets it."""
    return captures.join(scanned, "digest")


def skip_reasons(captures: DataFrame, scanned: DataFrame) -> DataFrame:
    """(reason, appearances) of files without metadata; scanned: (digest, reason), reason NULL where some was found."""
    one = scanned.filter(F.col("reason").isNotNull()).select("digest", "reason")
    per_digest = captures.groupBy("digest").agg(F.count("*").alias("n"))
    return per_digest.join(one, "digest").groupBy("reason").agg(F.sum("n").alias("appearances"))


def distinct_people(docs: DataFrame) -> DataFrame:
    """One row (people): different names in author, last editor and manager fields, of any length."""
    names = docs.select(F.explode(F.array("author", "lastmodifiedby", "manager")).alias("name")).select(F.trim("name").alias("name"))
    return names.filter(F.length("name") > 0).agg(F.count_distinct("name").alias("people"))


def people(docs: DataFrame) -> DataFrame:
    """Names in author, last editor and manager fields (shorter than 100 characters) and companies, with counts."""
    fields = F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(F.col(c)).alias("name")) for k, c in (("person", "author"), ("person", "lastmodifiedby"), ("person", "manager"), ("organisation", "company"))])
    named = docs.select(F.explode(fields).alias("f")).select("f.*").filter(F.length("name") > 0)
    return named.filter((F.col("kind") != "person") | (F.length("name") < 100)).groupBy("kind", "name").agg(F.count("*").alias("mentions"))


# -- which files are scanned for what ----


def is_css(url: Column | str, mimetype: Column | str) -> Column:
    return F.coalesce((urls.extension(url) == "css") | F.lower(urls.col(mimetype)).startswith("text/css"), F.lit(False))


def is_contact_source(url: Column | str) -> Column:
    """By the URL's extension alone, whatever the MIME type says."""
    return F.coalesce(urls.extension(url).isin(*schema.HTML_EXTENSIONS, "txt", "xml", "json"), F.lit(False))


def is_site_list(url: Column | str) -> Column:
    """Sitemaps and robots files."""
    return F.coalesce(urls.path(url).rlike(r"(?i)(sitemap[^/]*\.xml|robots\.txt)$"), F.lit(False))


def scan_targets(captures: DataFrame) -> DataFrame:
    """captures plus for_links, for_styles, for_contacts, for_lists, for_metadata and for_photos BOOLEAN."""
    u, m = "original_url", "mimetype"
    ext = urls.document_extension(u, m)
    html = F.coalesce(urls.is_html(u, m), F.lit(False))
    sets = {"for_links": html, "for_styles": is_css(u, m), "for_contacts": is_contact_source(u), "for_lists": is_site_list(u), "for_metadata": F.coalesce(ext.isin(*schema.METADATA_EXTENSIONS), F.lit(False)), "for_photos": F.coalesce(ext.isin(*schema.PHOTO_EXTENSIONS), F.lit(False))}
    return captures.withColumns(sets)


def estimate(fresh: DataFrame, size: str = "length") -> DataFrame:
    """(files, bytes): what a download of these rows would take, as far as sizes are known."""
    return fresh.agg(F.count("*").alias("files"), F.coalesce(F.sum(values.digits_or_zero(size)), F.lit(0)).cast("bigint").alias("bytes"))


def placed(captures: DataFrame, stored: DataFrame) -> DataFrame:
    """(documents, photos): appearances whose file is stored, by where their type puts them. stored: store_path."""
    have = captures.join(stored.select("store_path").distinct(), "store_path", "left_semi")
    kind = urls.document_extension("original_url", "mimetype")
    return have.agg(F.count_if(kind.isin(*schema.DOCUMENT_EXTENSIONS)).alias("documents"), F.count_if(kind.isin(*schema.IMAGE_EXTENSIONS)).alias("photos"))


def newest_versions(captures: DataFrame, k: int = 100) -> DataFrame:
    """The k newest snapshot folders with their numbers of captures."""
    return versions(captures).orderBy(F.desc("version")).limit(k)


def newest_documents(captures: DataFrame, k: int = 200) -> DataFrame:
    """The k newest captures of documents; equal times go by row order."""
    kind = urls.document_extension("original_url", "mimetype")
    docs = captures.withColumn("doc_ext", kind).filter(F.col("doc_ext").isin(*schema.DOCUMENT_EXTENSIONS))
    return docs.select("row_ord", "original_url", "timestamp", "doc_ext").orderBy(F.desc("timestamp"), "row_ord").limit(k)


def retry_rows(failures: DataFrame) -> DataFrame:
    """Failures worth another try: those that aren't permanent."""
    return failures.filter(~is_permanent(F.col("reason")))


def integrity_summary(checked: DataFrame) -> DataFrame:
    """(status, files, appearances) of binary.integrity()."""
    return checked.groupBy("status").agg(F.count("*").alias("files"), F.sum("appearances").alias("appearances"))


# -- link graph -------------------------------------------------------------------------------------------


def page_groups(captures: DataFrame) -> DataFrame:
    """Captures by group: each in its snapshot folder, and the newest of every path once more as 'latest'.

    Adds group_id and path. The newest row of a path in a group stands for it.
    """
    by_folder = captures.withColumn("group_id", times.folder("timestamp"))
    newest = latest_site(captures).withColumn("group_id", F.lit("latest")).withColumnRenamed("rel_path", "path")
    return by_folder.withColumn("path", urls.relative_path("original_url")).unionByName(newest.select(*captures.columns, "group_id", "path"))


def registry(pages: DataFrame) -> DataFrame:
    """(group_id, key, path): for every key of a group the file of its first page by row_ord."""
    keyed = pages.select("group_id", "path", "row_ord", F.explode(urls.registry_keys("original_url")).alias("key"))
    return keyed.groupBy("group_id", "key").agg(F.min_by("path", "row_ord").alias("path"))


def edges(links: DataFrame, registry: DataFrame) -> DataFrame:
    """links (group_id, source, target) with is_internal: whether the target is a page of the same group.

    registry: (group_id, url). Duplicate links stay; a target with a bad port is external.
    """
    keys = registry.select("group_id", F.explode(urls.registry_keys("url")).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    links = written(links.select("group_id", "source", "target"), new_dir(links.sparkSession, "links"))  # pages are parsed once
    # a group's distinct targets meet the registry first: a site's root is one row then, however many pages name it
    targets = links.select("group_id", "target").distinct().withColumn("__key", urls.link_key("target")).join(keys, ["group_id", "__key"], "left_semi").select("group_id", "target", F.lit(True).alias("__hit"))
    targets = written(targets, new_dir(links.sparkSession, "targets"))
    out = join_small(links, targets, ["group_id", "target"], "left", salt=16)
    return out.select("group_id", "source", "target", F.coalesce("__hit", F.lit(False)).alias("is_internal"))


def most_linked(graph: DataFrame, k: int = 30) -> DataFrame:
    inner = graph.filter("is_internal").groupBy("target").agg(F.count_distinct("source").alias("sources"))
    return inner.orderBy(F.desc("sources"), "target").limit(k)


def external_domains(graph: DataFrame, k: int = 50) -> DataFrame:
    host = F.lower(urls.raw_authority("target"))
    outer = graph.filter("not is_internal").groupBy(host.alias("host")).agg(F.count("*").alias("links")).filter(F.col("host") != "")
    return outer.orderBy(F.desc("links"), "host").limit(k)


def isolated(known: DataFrame, graph: DataFrame) -> DataFrame:
    """Known URLs that no link names, by raw spelling."""
    return known.select("url").distinct().join(graph.select(F.col("target").alias("url")).distinct(), "url", "left_anti")


def missing_from(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed URLs (sitemaps) whose link key no capture has."""
    have = known.select(urls.link_key("url").alias("__key")).filter(F.col("__key").isNotNull()).distinct()
    return listed.select("url").distinct().withColumn("__key", urls.link_key("url")).join(have, "__key", "left_anti").select("url")


def robots_rules(texts: DataFrame) -> DataFrame:
    """(source, rule, value) of robots files: allow, disallow and sitemap lines in any case."""
    lines = texts.select("source", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    form = r"(?i)^\s*(allow|disallow|sitemap)\s*:\s*(\S+)"
    return lines.filter(F.col("line").rlike(form)).select("source", F.lower(F.regexp_extract("line", form, 1)).alias("rule"), F.regexp_extract("line", form, 2).alias("value")).distinct()


def sitemap_urls(texts: DataFrame) -> DataFrame:
    """(source, url) of the <loc> elements of sitemaps."""
    locs = F.regexp_extract_all("text", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"))
    return texts.select("source", F.explode(locs).alias("url")).distinct()


