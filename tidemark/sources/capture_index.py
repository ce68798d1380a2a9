"""The capture index as a source: request planning, paging, and a Python data source with an injectable transport.

    capture_index.register(spark)
    spark.read.format("capture_index").options(domain="a.test", endpoint="https://…", transport="module:function").load()

The transport is a function url -> text; without one urllib is used. Filters on statuscode and timestamp are
pushed into the request. Pages follow a resume key, so one scope is one sequential partition; several date
slices give several partitions. Rows carry row_ord, their place in the scan.

An incomplete scan never passes for a whole one: it raises ScanError, or with option partial=keep gives the rows
read and a last row whose scan_error holds the code (TIMEOUT, NETWORK, HTTP_nnn, FORMAT) and whose other columns
are NULL. Option kind=status reads the status history of a target instead: all statuses, no dates, one page.
"""

from __future__ import annotations

import importlib
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, IsNotNull, LessThanOrEqual

from tidemark import schema
from tidemark.operators.captures import first_per

PAGE_ROWS = 100_000
RETRYABLE = frozenset((408, 425, 500, 502, 503, 504))
#: Where sites keep their sitemaps, and names that subdomains often have.
WELL_KNOWN = ("robots.txt", "sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap1.xml", "wp-sitemap.xml", "sitemap/sitemap.xml")
SUBDOMAIN_NAMES = ("www", "mail", "webmail", "shop", "blog", "news", "api", "cdn", "static", "m", "mobile", "support", "help", "docs", "portal", "intranet", "corp", "login", "admin", "cabinet", "old", "test", "dev", "en", "ru")
MOST_SUBDOMAINS = 80
STATUS_COLUMNS = ("original", "timestamp", "statuscode")


class ScanError(Exception):
    """A scan that ended early; code says why."""

    def __init__(self, code: str):
        super().__init__(f"the scan is incomplete: {code}")
        self.code = code


def error_code(e: Exception) -> str:
    code = getattr(e, "code", None)
    if isinstance(code, int):
        return f"HTTP_{code}"
    if isinstance(e, ValueError):
        return "FORMAT"
    late = isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError) or "timed out" in str(e).lower()
    return "TIMEOUT" if late else "NETWORK"


def retry_after(header: str | None, default: int = 30, now: datetime | None = None) -> int:
    """Seconds a Retry-After header asks for, given as a number or a date: 600 at most, default if it is unreadable."""
    text = (header or "").strip()
    if text.isdigit():
        return min(int(text), 600)
    try:
        when = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return default
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return max(1, min(600, int((when - (now or datetime.now(timezone.utc))).total_seconds())))


@dataclass(frozen=True)
class Scope:
    """What to ask for: a domain, host, exact URL or prefix, and dates as YYYYMMDD prefixes."""

    target: str
    match: str = "domain"
    start: str | None = None
    end: str | None = None
    status: str | None = "200"

    @staticmethod
    def parse(text: str) -> Scope:
        """Scope of an address as typed; anything with a path or query is that page, else the whole domain."""
        raw = text.strip()
        url = urllib.parse.urlsplit(raw if "://" in raw else f"http://{raw}")
        if url.scheme not in ("http", "https") or not url.hostname or url.username:
            raise ValueError(f"not an http address: {text!r}")
        if url.path.strip("/") or url.query:
            return Scope(url.geturl(), "exact")
        return Scope(url.hostname)

    def narrower(self) -> Scope | None:
        """The next smaller scope after a time-out."""
        smaller = {"domain": "host", "host": "exact"}.get(self.match)
        if smaller is None:
            return None
        return replace(self, match=smaller, target=f"{self.target}/" if smaller == "exact" else self.target)

    def plan(self) -> list[Scope]:
        """The scopes whose union answers a page's address: itself, and what lies below it unless it is a file."""
        if self.match != "exact":
            return [self]
        path = urllib.parse.urlsplit(self.target)
        is_file = "." in path.path.rsplit("/", 1)[-1]
        return [self] if is_file or path.query else [self, replace(self, match="prefix", target=self.target.rstrip("/") + "/")]


def request_url(endpoint: str, scope: Scope, fields: tuple[str, ...] = schema.INDEX_COLUMNS, resume: str | None = None, limit: int = PAGE_ROWS) -> str:
    params = [("url", scope.target), ("fl", ",".join(fields))]
    if scope.status:
        params += [("filter", f"statuscode:{scope.status}"), ("collapse", "digest")]
    params += [("limit", str(limit)), ("showResumeKey", "true")]
    if scope.match != "exact":
        params.append(("matchType", scope.match))
    params += [(k, v) for k, v in (("from", scope.start), ("to", scope.end), ("resumeKey", resume)) if v]
    return f"{endpoint}?{urllib.parse.urlencode(params)}"


def parse_page(text: str, width: int = 6) -> tuple[list[list[str]], str | None, list[str]]:
    """(records, resume key, malformed lines) of one page. A last line after an empty one is the resume key."""
    lines = text.split("\n")
    while lines and not lines[-1].strip():
        lines.pop()
    resume = None
    if len(lines) >= 2 and not lines[-2].strip():
        resume = lines[-1].strip()
        lines = lines[:-2]
    good, bad = [], []
    for line in lines:
        parts = line.split(" ")
        if len(parts) == width:
            good.append(parts)
        elif line.strip():
            bad.append(line)
    if bad and not good and resume is None:
        raise ValueError("the answer holds no valid record")
    return good, resume, bad


def fetch(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310 - address given by the user
        return r.read().decode("utf-8", "replace")


def pages(scope: Scope, endpoint: str, get: Callable[[str], str] = fetch, fields: tuple[str, ...] = schema.INDEX_COLUMNS, attempts: int = 2, pause: float = 3.0) -> Iterator[list[list[str]]]:
    """Records page by page. Transient errors are tried again, 429 isn't; a repeated resume key ends the scan.

    An error that stays raises ScanError, on whatever page: the pages before it were given already.
    """
    resume, seen = None, set()
    while True:
        for attempt in range(1, attempts + 1):
            try:
                rows, nxt, _ = parse_page(get(request_url(endpoint, scope, fields, resume)), len(fields))
                break
            except (urllib.error.URLError, TimeoutError, OSError, ValueError) as e:
                code = getattr(e, "code", None)
                if attempt == attempts or isinstance(e, ValueError) or (code is not None and code not in RETRYABLE):
                    raise ScanError(error_code(e)) from e
                time.sleep(pause * attempt)
        yield rows
        if not nxt or nxt in seen:
            return
        seen.add(nxt)
        resume = nxt


def scan(scope: Scope, endpoint: str, get: Callable[[str], str] = fetch, **how) -> Iterator[list[list[str]]]:
    """Records of a scope. A domain that times out before its first page is asked for as a host, then as its front page only."""
    while True:
        given = False
        try:
            for rows in pages(scope, endpoint, get, **how):
                given = True
                yield rows
            return
        except ScanError as e:
            smaller = scope.narrower()
            if given or smaller is None or scope.match not in ("domain", "host") or e.code not in ("TIMEOUT", "HTTP_504"):
                raise
            scope = smaller


def status_history(target: str, match: str, endpoint: str, get: Callable[[str], str] = fetch) -> list[list[str]]:
    """(original, timestamp, statuscode) of a target in all statuses and times: one request, not tried again."""
    try:
        rows, _, _ = parse_page(get(request_url(endpoint, Scope(target, match, status=None), STATUS_COLUMNS)), len(STATUS_COLUMNS))
    except (urllib.error.URLError, TimeoutError, OSError, ValueError) as e:
        raise ScanError(error_code(e)) from e
    return rows


def well_known_scopes(scope: Scope) -> list[Scope]:
    """Exact scopes of the addresses where a host keeps its sitemaps."""
    return [replace(scope, target=f"{scope.target.rstrip('/')}/{p}", match="exact") for p in WELL_KNOWN]


def subdomain_scopes(base: str, names: list[str], scope: Scope, most: int = MOST_SUBDOMAINS) -> list[Scope]:
    """Scopes of subdomains from certificates, then of usual names, each once, at most so many (0: all)."""
    hosts = list(dict.fromkeys([*(n.lower() for n in names if n.lower().endswith(f".{base}")), *(f"{n}.{base}" for n in SUBDOMAIN_NAMES)]))
    return [replace(scope, target=f"{h}/", match="prefix") for h in (hosts[:most] if most else hosts)]


class Slice(InputPartition):
    def __init__(self, scope: Scope, place: int):
        self.scope, self.place = scope, place


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.history, self.settled = options.get("kind") == "status", []
        s = options.get("start"), options.get("end")
        self.scope = Scope(options["domain"], options.get("match", "domain"), *s, status=None)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on statuscode and timestamp shape the request and are settled in read(), which spares the marks of
        incomplete scans; Spark applies all others, to the marks as well."""
        for f in filters:
            if not self.history and isinstance(f, EqualTo) and f.attribute == ("statuscode",):
                self.scope = replace(self.scope, status=f.value)
            elif not self.history and isinstance(f, GreaterThanOrEqual) and f.attribute == ("timestamp",):
                self.scope = replace(self.scope, start=f.value)
            elif not self.history and isinstance(f, LessThanOrEqual) and f.attribute == ("timestamp",):
                self.scope = replace(self.scope, end=f.value)
            elif not self.history and isinstance(f, IsNotNull) and f.attribute in (("statuscode",), ("timestamp",)):
                continue  # comes with a comparison; every record has both
            else:
                yield f
                continue
            self.settled.append((("statuscode",) == f.attribute, type(f), f.value))

    def passes(self, row: list[str]) -> bool:
        for status, kind, value in self.settled:
            have = row[4] if status else row[1]
            if not (have == value if kind is EqualTo else have >= value if kind is GreaterThanOrEqual else have <= value):
                return False
        return True

    def partitions(self) -> list[Slice]:
        cuts = [c for c in self.options.get("slices", "").split(",") if c]
        edges = [self.scope.start, *cuts, self.scope.end]
        out = [replace(self.scope, start=a, end=b) for a, b in zip(edges, edges[1:])]
        if self.history:
            return [Slice(self.scope, 0)]
        scopes = [s for scope in out for s in scope.plan()]
        if self.options.get("well_known") == "true":
            scopes += well_known_scopes(self.scope)
        return [Slice(s, i) for i, s in enumerate(scopes)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        get = fetch
        if name := self.options.get("transport"):
            module, _, function = name.partition(":")
            get = getattr(importlib.import_module(module), function)
        at, scope, blank = partition.place << 40, partition.scope, [None] * len(schema.INDEX_COLUMNS)
        try:
            if self.history:
                batches = iter([[[o, t, None, None, c, None] for o, t, c in status_history(scope.target, scope.match, self.options["endpoint"], get)]])
            else:
                batches = scan(scope, self.options["endpoint"], get, pause=float(self.options.get("pause", "3")))
            for rows in batches:
                for r in filter(self.passes, rows):
                    yield (*r, at, None)
                    at += 1
        except ScanError as e:
            if self.options.get("partial") != "keep":
                raise
            yield (*blank, at, e.code)


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_index"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in schema.INDEX_COLUMNS) + ", row_ord bigint, scan_error string"

    def reader(self, schema) -> IndexReader:  # noqa: ARG002
        return IndexReader(dict(self.options))


def unique_records(records: DataFrame) -> DataFrame:
    """The first record, by row_ord, of every (original, timestamp): slices and scopes may overlap.

    Rows stay whole; marks of incomplete scans are left out.
    """
    whole = records.filter(F.col("scan_error").isNull()) if "scan_error" in records.columns else records
    return first_per(whole, ["original", "timestamp"], ["row_ord"])


def unseen_records(records: DataFrame, known: DataFrame) -> DataFrame:
    """unique_records that known (original, timestamp) lacks: what probes of well-known addresses or subdomains add."""
    return unique_records(records).join(known.select("original", "timestamp").distinct(), ["original", "timestamp"], "left_anti")


def subdomains(spark: SparkSession, certificates: DataFrame, base: str) -> DataFrame:
    """(name): host names below a domain in certificate log answers, column `json`."""
    rows = certificates.select(F.explode(F.from_json("json", "array<struct<name_value:string,common_name:string>>")).alias("e"))
    names = rows.select(F.explode(F.split(F.concat_ws("\n", "e.name_value", "e.common_name"), "\n")).alias("n"))
    clean = names.select(F.regexp_replace(F.lower(F.trim("n")), r"^[*.]+", "").alias("name"))
    return clean.filter(F.col("name").endswith(f".{base}") & ~F.col("name").rlike(r"[\s,@]")).distinct()


def register(spark: SparkSession) -> None:
    """Make format 'capture_index' known to a session, with filters pushed into its requests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexSource)
