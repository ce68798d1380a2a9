"""HTML and CSS: decoding, links, rewriting. Parsing is Python in Arrow batches; all lookups are joins."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from html import escape, unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import runtime

#: The attribute of each element that holds its address.
LINK_ATTRIBUTES = {"a": "href", "link": "href", "script": "src", "img": "src", "iframe": "src", "form": "action", "source": "src", "video": "src", "audio": "src", "embed": "src"}
SRCSET_TAGS = ("img", "source")
#: What is no address of a page, encodings tried in turn, elements whose text nobody sees.
NO_LINK = ("#", "mailto:", "tel:", "javascript:", "data:")
ENCODINGS = ("utf-8", "cp1251", "koi8-r", "cp866")
HIDDEN_TAGS = ("script", "style")
DECLARED = re.compile(rb"charset=[\"']?\s*([\w-]+)", re.IGNORECASE)
CSS_ADDRESS = re.compile(r"""url\(\s*(?:"([^"]+)"|'([^']+)'|([^"')\s][^"')]*?))\s*\)|@import\s+(?:"([^"]+)"|'([^']+)')""", re.IGNORECASE)


def decode(raw: bytes | None) -> str | None:
    """Text of a page: declared encoding, then the usual ones, then UTF-8 with replacement."""
    if raw is None:
        return None
    found = DECLARED.search(raw[:4096])
    declared = [found[1].decode("ascii", "ignore").lower()] if found else []
    for name in dict.fromkeys([*declared, *ENCODINGS]):
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


def with_utf8_meta(text: str) -> str:
    """The page with its charset declaration set to UTF-8, added if there is none."""
    meta = '<meta charset="utf-8">'
    out, n = re.subn(r"<meta[^>]+charset=[\"']?[\w-]+[\"']?[^>]*>", meta, text, count=1, flags=re.IGNORECASE)
    if n:
        return out
    out, n = re.subn(r"<head[^>]*>", lambda m: m[0] + meta, text, count=1, flags=re.IGNORECASE)
    return out if n else meta + text


class LinkReader(HTMLParser):
    """Collects (tag, attribute, value) of all addresses of a page, srcset candidates one by one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for name, value in attrs:
            if value and name == LINK_ATTRIBUTES.get(tag):
                self.found.append((tag, name, value.strip()))
            elif value and name == "srcset" and tag in SRCSET_TAGS:
                self.found += [(tag, name, c.split()[0]) for c in value.split(",") if c.split()]


def read_links(text: str | None) -> list[tuple[str, str, str]]:
    """Addresses of a page; what was read before a parser error stays."""
    reader = LinkReader()
    try:
        reader.feed(text or "")
        reader.close()
    except Exception:  # noqa: BLE001 - broken markup ends the page, not the job
        pass
    return reader.found


class VisibleReader(HTMLParser):
    """Collects the text a reader sees and the values of all href and src."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.addresses: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in HIDDEN_TAGS
        self.addresses += [value for name, value in attrs if name in ("href", "src") and value]

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def read_visible(text: str | None) -> tuple[str, list[str]]:
    """Visible text (pieces joined by spaces) and addresses of a page; a page the parser fails on loses its tags only."""
    reader = VisibleReader()
    try:
        reader.feed(text or "")
        reader.close()
    except Exception:  # noqa: BLE001 - broken markup costs the page its addresses, not the job
        return re.sub(r"<[^>]+>", " ", text or ""), []
    return " ".join(reader.text), reader.addresses


def visible(pages: DataFrame) -> DataFrame:
    """pages (store_path, html) to (store_path, text, addresses ARRAY<STRING>), one row per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [read_visible(h) for h in pdf["html"]]
            yield pd.DataFrame({"store_path": pdf["store_path"], "text": [r[0] for r in read], "addresses": [r[1] for r in read]})

    return pages.select("store_path", "html").mapInPandas(run, "store_path string, text string, addresses array<string>")


def resolved(base: str, value: str) -> str | None:
    """Absolute http(s) address of a link, None for what is none."""
    v = value.strip()
    if not v or v.lower().startswith(NO_LINK):
        return None
    try:
        target = urljoin(base, v)
    except ValueError:
        return None
    return target if target.lower().startswith(("http://", "https://")) else None


def links(pages: DataFrame) -> DataFrame:
    """pages (url, html) to (url, tag, value, target): one row per address that resolves to http(s)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(u, tag, v, t) for u, h in zip(pdf["url"], pdf["html"]) for tag, _, v in read_links(h) if (t := resolved(u, v))]
            yield pd.DataFrame(rows, columns=["url", "tag", "value", "target"])

    return pages.select("url", "html").mapInPandas(run, "url string, tag string, value string, target string")


def decoded(raw: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(decode)

    return run(raw)


def rewrite_css(css: str, new_address: Callable[[str], str | None]) -> tuple[str, int]:
    """CSS with addresses replaced where new_address gives one, and how many were."""
    changed = 0

    def put(m: re.Match) -> str:
        nonlocal changed
        old = next(g for g in m.groups() if g)
        new = None if old.strip().lower().startswith("data:") else new_address(old.strip())
        if not new or new == old:
            return m[0]
        changed += 1
        return m[0].replace(old, new, 1)

    return CSS_ADDRESS.sub(put, css), changed


TAG = re.compile(r"<([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(\s*=\s*)("[^"]*"|'[^']*'|[^\s"'=<>`]+)""")
STYLE = re.compile(r"(<style[^>]*>)(.*?)(</style>)", re.IGNORECASE | re.DOTALL)


def rewrite_page(text: str, new_address: Callable[[str], str | None]) -> tuple[str, int]:
    """HTML with its addresses replaced where new_address gives one; <base> goes; inline styles are rewritten."""
    changed = 0

    def value(raw: str, srcset: bool) -> str:
        nonlocal changed
        quote = raw[0] if raw[0] in "\"'" else ""
        old = unescape(raw.strip("\"'") if quote else raw)
        if srcset:
            pieces = []
            for c in old.split(","):
                first, *rest = c.split() or [""]
                pieces.append(" ".join([new_address(first) or first, *rest]))
            new = ", ".join(pieces)
            new = old if new.replace(" ", "") == old.replace(" ", "") else new
        else:
            new = None if old.strip().lower().startswith(NO_LINK) else new_address(old)
        if not new or new == old:
            return raw
        changed += 1
        q = quote or '"'
        return f"{q}{escape(new)}{q}"

    def tag(m: re.Match) -> str:
        name = m[1].lower()
        if name == "base":
            return ""
        want = LINK_ATTRIBUTES.get(name)

        def attribute(a: re.Match) -> str:
            key = a[1].lower()
            if key == want:
                return a[1] + a[2] + value(a[3], False)
            if key == "srcset" and name in SRCSET_TAGS:
                return a[1] + a[2] + value(a[3], True)
            return a[0]

        return f"<{m[1]}{ATTRIBUTE.sub(attribute, m[2])}>" if want or name in SRCSET_TAGS else m[0]

    def style(m: re.Match) -> str:
        nonlocal changed
        css, n = rewrite_css(m[2], new_address)
        changed += n
        return m[1] + css + m[3]

    return STYLE.sub(style, TAG.sub(tag, text)), changed


def css_links(files: DataFrame) -> DataFrame:
    """files (url, css) to (url, value, target): the addresses in style sheets that resolve to http(s)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u, css in zip(pdf["url"], pdf["css"]):
                for m in CSS_ADDRESS.finditer(css or ""):
                    v = next(g for g in m.groups() if g).strip()
                    if t := resolved(u, v):
                        rows.append((u, v, t))
            yield pd.DataFrame(rows, columns=["url", "value", "target"])

    return files.select("url", "css").mapInPandas(run, "url string, value string, target string")


def style_links(pages: DataFrame) -> DataFrame:
    """pages (url, html) to (url, value, target): the addresses in their inline styles."""
    inline = pages.select("url", F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<style[^>]*>(.*?)</style>")), " ").alias("css"))
    return css_links(inline.filter("css <> ''"))


def _rewritten(files: DataFrame, found: DataFrame, addresses: DataFrame, change: Callable) -> DataFrame:
    """files (group_id, url, path, text) with the addresses found (url, value, target) made relative by change(text, new)."""
    from tidemark.functions import urls

    # distinct targets meet the registry, so that an address every page holds is one row a group and not one a page
    keyed = files.select("group_id", "url").distinct().join(found.distinct(), "url").withColumn("key", urls.link_key("target"))
    keys = keyed.select("group_id", "key").distinct().join(addresses.withColumnRenamed("path", "to"), ["group_id", "key"])
    hits = runtime.join_small(keyed, keys, ["group_id", "key"], salt=16)
    packed = hits.groupBy("group_id", "url").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("value", "to")))).alias("to"))

    @F.pandas_udf("struct<text:string,changed:int>")
    def run(text: pd.Series, path: pd.Series, to: pd.Series) -> pd.DataFrame:
        out = []
        for h, p, m in zip(text, path, to):
            table = dict(m) if m is not None else {}
            folder = posixpath.dirname(p or "")

            def new(v: str, table: dict = table, folder: str = folder) -> str | None:
                return posixpath.relpath(table[v.strip()], folder or ".") if v.strip() in table else None

            out.append(change(h or "", new))
        return pd.DataFrame(out, columns=["text", "changed"])

    joined = files.join(packed, ["group_id", "url"], "left").withColumn("to", F.col("to").cast("map<string,string>"))
    return joined.withColumn("r", run("text", "path", "to"))


def rewrite(pages: DataFrame, addresses: DataFrame) -> DataFrame:
    """pages (group_id, url, path, html) rewritten to relative paths of their group's files.

    addresses: (group_id, key, path), one row per registered key. Links are read, resolved, joined to their
    files and packed per page as a map, so no task holds a group's registry. Inline styles are rewritten and the
    charset is declared as UTF-8, as what is written. Returns (group_id, url, html, changed).
    """
    once = pages.select("url", "html").dropDuplicates(["url", "html"])
    found = links(once).select("url", "value", "target").unionByName(style_links(once))
    files = pages.select("group_id", "url", "path", F.col("html").alias("text"))
    out = _rewritten(files, found, addresses, lambda text, new: ((r := rewrite_page(text, new))[0] and with_utf8_meta(r[0]), r[1]))
    return out.select("group_id", "url", F.col("r.text").alias("html"), "r.changed")


def rewrite_styles(files: DataFrame, addresses: DataFrame) -> DataFrame:
    """Style sheets (group_id, url, path, css) rewritten as pages are: (group_id, url, css, changed)."""
    found = css_links(files.select("url", "css").dropDuplicates(["url", "css"]))
    out = _rewritten(files.select("group_id", "url", "path", F.col("css").alias("text")), found, addresses, rewrite_css)
    return out.select("group_id", "url", F.col("r.text").alias("css"), "r.changed")
