"""Reports as text: thin renderers over DataFrames, which stream to the driver row by row.

Every report is a small aggregate or a sorted listing; the work is in operators.captures. write() puts lines into
a file by way of a temporary one. Sort orders are those users know: most versions first, newest first, most pages
first, names in order.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterable, Iterator
from html import escape
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times, values
from tidemark.operators import captures as C

RULE = "=" * 78
LISTED_ISOLATED, LISTED_VERSIONS, LISTED_DOCUMENTS, LISTED_EXTENSIONS = 100, 100, 200, 25


def write(path: str, lines: Iterable[str]) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        for line in lines:
            f.write(line + "\n")
    os.replace(f"{path}.part", path)


def rows(df: DataFrame) -> Iterator:
    return df.toLocalIterator()


def table(header: list[str], df: DataFrame) -> Iterator[str]:
    """Lines of a CSV table with a header; NULL is empty."""
    yield _csv_line(header)
    for r in rows(df):
        yield _csv_line(["" if v is None else v for v in r])


def _csv_line(values_: list) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values_)
    return out.getvalue()


def timeline(captures: DataFrame) -> Iterator[str]:
    """URLs by number of versions, with first and last appearance and the change of size."""
    found = C.timeline(captures)
    shown = found.select(
        "original_url", "versions", times.pretty("first").alias("first"), times.pretty("last").alias("last"), values.human_size("first_size").alias("a"), values.human_size("last_size").alias("b"),
        F.when((F.col("versions") > 1) & (F.col("first_size") != 0) & (F.col("last_size") != 0), F.col("last_size") - F.col("first_size")).alias("delta"),
    )
    shown = shown.withColumn("change", F.concat(F.when(F.col("delta") > 0, "+").otherwise("-"), values.human_size(F.abs("delta"))))
    yield from ("CHANGE TIMELINE", f"Unique URLs: {found.count()}", RULE, "")
    for r in rows(shown.orderBy(F.desc("versions"), "original_url")):
        yield from (r.original_url or "", f"  versions: {r.versions}", f"  first: {r.first} ({r.a})", f"  latest: {r.last} ({r.b})")
        if r.change is not None:
            yield f"  size change: {r.change}"
        yield ""


def single_captures(captures: DataFrame) -> Iterator[str]:
    once = C.timeline(captures).filter("versions = 1")
    yield from ("URLS CAPTURED ONCE", f"Total: {once.count()}", RULE, "")
    for r in rows(once.orderBy(F.desc("first"), "original_url").select(times.pretty("first").alias("t"), values.human_size("first_size").alias("s"), "original_url")):
        yield f"{r.t} ({r.s}) {r.original_url}"


def removed_pages(history: DataFrame) -> Iterator[str]:
    gone = C.removed(history)
    yield from ("REMOVED PAGES", f"URLs checked: {history.select('original').distinct().count()}, removed: {gone.count()}", RULE, "")
    for r in rows(gone.orderBy(F.desc("died_at"), "original").select("original", times.pretty("last_ok").alias("ok"), times.pretty("died_at").alias("died"), "last_status")):
        yield from (r.original, f"  last good capture: {r.ok}", f"  unavailable ({r.last_status}) since: {r.died}", "")


def link_graph(graph: DataFrame, pages: DataFrame, documents: DataFrame) -> Iterator[str]:
    """graph: of captures.edges(); pages and documents: url of the known ones."""
    yield from ("LINK GRAPH", f"Links: {graph.count()}", RULE, "", "MOST LINKED:")
    for r in rows(C.most_linked(graph)):
        yield f"  {r.sources:>4} {r.target}"
    for title, known in (("PAGES WITHOUT INCOMING LINKS", pages), ("DOCUMENTS WITHOUT INCOMING LINKS", documents)):
        alone = C.isolated(known, graph)
        n = alone.count()
        yield from ("", f"{title} ({n}):")
        for r in rows(alone.orderBy("url").limit(LISTED_ISOLATED)):
            yield f"  {r.url}"
        if n > LISTED_ISOLATED:
            yield f"  ... and {n - LISTED_ISOLATED} more"
    yield from ("", "EXTERNAL DOMAINS:")
    for r in rows(C.external_domains(graph)):
        yield f"  {r.links:>4} {r.host}"


def contacts(found: DataFrame) -> Iterator[str]:
    """found: of captures.contacts()."""
    for title, want in (("EMAIL", F.col("type") == "email"), ("PHONES", (F.col("type") == "phone") & (F.col("confidence") == "high")), ("POSSIBLE PHONES", (F.col("type") == "phone") & (F.col("confidence") == "low"))):
        part = found.filter(want)
        yield f"{title} ({part.count()}):"
        for r in rows(part.orderBy(F.desc("pages"), "value")):
            yield f"  {'+' if r.type == 'phone' else ''}{r.value} (on {r.pages} pages)"
        yield ""
    last = None
    for r in rows(found.filter(F.col("type").isin(*values.NETWORKS)).orderBy("type", F.desc("pages"), "value")):
        if r.type != last:
            yield f"--- {r.type} ---"
            last = r.type
        yield f"  {r.value} (on {r.pages} pages)"


def contacts_table(found: DataFrame) -> Iterator[str]:
    kind = F.when(F.col("type").isin("email", "phone"), F.col("type")).otherwise(F.concat(F.lit("network:"), "type"))
    value = F.when(F.col("type") == "phone", F.concat(F.lit("+"), "value")).otherwise(F.col("value"))
    order = F.when(F.col("type") == "email", 0).when(F.col("type") == "phone", 1).otherwise(2)
    out = found.orderBy(order, "type", "value").select(kind, value, F.coalesce("confidence", F.lit("high")), "pages", "example")
    return table(["type", "value", "confidence", "pages", "example"], out)


def documents(captures: DataFrame, scanned: DataFrame, people: DataFrame) -> Iterator[str]:
    """captures of documents; scanned: (digest, meta MAP, reason) one row a file; people: of captures.people()."""
    found = C.fan_out(captures, scanned.filter(F.size("meta") > 0).select("digest", "meta"))
    yield from ("DOCUMENT METADATA", f"With metadata: {found.count()} of {captures.count()}")
    for r in rows(C.skip_reasons(captures, scanned).orderBy(F.desc("appearances"), "reason")):
        yield f"  {r.appearances} {r.reason}"
    yield from (RULE, "")
    for title, kind in (("PEOPLE", "person"), ("ORGANISATIONS", "organisation")):
        yield f"{title}:"
        for r in rows(people.filter(F.col("kind") == kind).orderBy(F.desc("mentions"), "name")):
            yield f"  {r.name} (in {r.mentions} documents)"
        yield ""
    for r in rows(found.orderBy("row_ord").select("original_url", times.pretty("timestamp").alias("t"), F.array_sort(F.map_entries("meta")).alias("m"))):
        yield f"{r.original_url} ({r.t})"
        yield from (f"    {k}: {v}" for k, v in r.m)
        yield ""


def photos(captures: DataFrame, scanned: DataFrame) -> Iterator[str]:
    """captures of photos; scanned: (digest, make, model, software, date_time, date_time_original, lat, lon)."""
    some = scanned.filter(F.coalesce("make", "model", "software", "date_time", "date_time_original", F.col("lat").cast("string")).isNotNull())
    found = C.fan_out(captures, some)
    located = found.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    yield from ("PHOTO METADATA", f"With metadata: {found.count()} of {captures.count()}", f"With a position: {located.count()}", RULE, "")
    for r in rows(found.orderBy("row_ord")):
        yield f"{r.original_url}"
        yield from (f"    {k}: {r[k]}" for k in ("make", "model", "software", "date_time_original", "date_time", "lat", "lon") if r[k] is not None)
        yield ""


def site_lists(listed: DataFrame, rules: DataFrame, known: DataFrame) -> Iterator[str]:
    """listed: url of sitemaps; rules: of captures.robots_rules(); known: url of captures."""
    missing = C.missing_from(listed, known)
    declared = rules.filter("rule = 'sitemap'").select(F.col("value").alias("url")).distinct()
    unknown = C.missing_from(declared, known)
    disallowed = rules.filter("rule = 'disallow'").select("value").distinct()
    yield from ("SITEMAPS AND ROBOTS", f"Listed URLs: {listed.select('url').distinct().count()}", f"Not captured: {missing.count()}", f"Disallowed paths: {disallowed.count()}", f"Declared sitemaps: {declared.count()}", RULE, "")
    for title, part in (("DECLARED SITEMAPS NOT CAPTURED", unknown), ("DISALLOWED", disallowed), ("LISTED BUT NOT CAPTURED", missing), ("ALL LISTED", listed.select("url").distinct())):
        yield f"{title}:"
        yield from (f"  {r[0]}" for r in rows(part.orderBy(part.columns[0])))
        yield ""


def integrity(checked: DataFrame) -> Iterator[str]:
    """checked: of binary.integrity()."""
    yield from ("INTEGRITY", *(f"{r.status}: {r.files} files, {r.appearances} captures" for r in rows(C.integrity_summary(checked).orderBy("status"))), RULE)
    for r in rows(checked.filter("status <> 'OK'").orderBy("status", "digest")):
        yield f"{r.status} {r.digest} {r.detail}"


def relative_link(folder: str, target: str) -> str:
    """A link from a page in folder to target, with forward slashes and escapes."""
    return quote(os.path.relpath(target, folder or ".").replace(os.sep, "/"))


def entry_page(folder: str, host: str) -> str:
    """The page a snapshot opens with: the host's index, any host's, one at the top, else the folder."""
    names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    for candidate in [os.path.join(folder, host, "index.html"), *(os.path.join(folder, n, "index.html") for n in names), os.path.join(folder, "index.html")]:
        if os.path.isfile(candidate):
            return candidate
    return folder


def dashboard(captures: DataFrame, host: str, folder: str, reports: list[str]) -> Iterator[str]:
    """The overview page in folder: counts, links to reports that exist, newest versions and documents, frequent types."""
    t = C.totals(captures).first()
    urls_, sites = captures.select("original_url").distinct().count(), C.versions(captures).count()
    cards = {"Captures": t.capture_count, "Pages and files": urls_, "Stored files": t.unique_blob_count, "Snapshots": sites, "Bytes captured": t.total_capture_bytes, "Bytes stored": t.unique_storage_bytes}
    yield f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{escape(host)}</title></head><body><h1>{escape(host)}</h1><ul>"
    yield from (f"<li>{escape(k)}: {v}</li>" for k, v in cards.items())
    yield "</ul><ul>"
    yield from (f"<li><a href=\"{escape(relative_link(folder, r))}\">{escape(os.path.basename(r))}</a></li>" for r in reports if os.path.exists(r))
    yield "</ul><h2>Versions</h2><ul>"
    for r in rows(C.newest_versions(captures, LISTED_VERSIONS)):
        page = entry_page(os.path.join(folder, "versions", r.version), host)
        yield f"<li><a href=\"{escape(relative_link(folder, page))}\">{escape(r.version)}</a> ({r.captures})</li>"
    yield "</ul><h2>Documents</h2><ul>"
    for r in rows(C.newest_documents(captures, LISTED_DOCUMENTS)):
        yield f"<li>{escape(r.original_url)} ({escape(r.doc_ext)})</li>"
    yield "</ul><h2>Types</h2><table>"
    for r in rows(C.extensions(captures).orderBy(F.desc("captures"), "ext").limit(LISTED_EXTENSIONS)):
        yield f"<tr><td>{escape(r.ext or '')}</td><td>{r.captures}</td></tr>"
    yield "</table></body></html>"


def is_document(captures: DataFrame) -> DataFrame:
    """The captures whose metadata can be read."""
    return C.scan_targets(captures).filter("for_metadata").select(*captures.columns)


METADATA_TABLE = ("url", "capture_date", *(f.lower() for f in ("Author", "LastModifiedBy", "Company", "Manager", "Creator", "Producer", "Title", "Subject", "CreationDate", "ModDate")))


def documents_table(captures: DataFrame, scanned: DataFrame) -> Iterator[str]:
    found = C.fan_out(captures, scanned.filter(F.size("meta") > 0).select("digest", "meta"))
    names = ("Author", "LastModifiedBy", "Company", "Manager", "Creator", "Producer", "Title", "Subject", "CreationDate", "ModDate")
    return table(list(METADATA_TABLE), found.orderBy("row_ord").select("original_url", "timestamp", *(F.try_element_at("meta", F.lit(n)) for n in names)))

