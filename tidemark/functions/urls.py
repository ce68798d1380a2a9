"""URL and path expressions. All are NULL-safe; malformed URLs give NULL or the text itself, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema

DEFAULT_PORTS = {"http": "80", "https": "443"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_scheme(url: Column | str) -> Column:
    """Trimmed URL with 'http://' before it unless it is http or https already."""
    u = F.trim(col(url))
    return F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("http://"), u))


def scheme(url: Column | str) -> Column:
    """Lower-case scheme, '' if there is none."""
    return F.lower(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def raw_authority(url: Column | str) -> Column:
    """What stands between '//' and the path."""
    return F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def authority(url: Column | str) -> Column:
    """The authority without user and password."""
    return F.regexp_replace(raw_authority(url), r"^.*@", "")


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)


def port(url: Column | str) -> Column:
    """Digits of the port, '' if none is given."""
    return F.regexp_extract(authority(url), r":(\d*)$", 1)


def port_is_valid(url: Column | str) -> Column:
    """No port, or a number up to 65535."""
    tail = F.regexp_extract(authority(url), r"(?:\]|^[^:\[\]]*):(.*)$", 1)
    return (tail == "") | (tail.rlike(r"^\d{1,9}$") & F.coalesce(tail.try_cast("int") <= 65535, F.lit(False)))


def hostname(url: Column | str) -> Column:
    """Lower-case host without port and brackets' port, '' if there is none."""
    return F.lower(F.regexp_replace(authority(url), r":\d*$", ""))


def _default_port(url: Column | str) -> Column:
    s, p = scheme(url), port(url)
    return ((s == "http") & (p == "80")) | ((s == "https") & (p == "443"))


def domain(url: Column | str) -> Column:
    """Canonical host: lower case, no trailing dots, port only if it isn't the scheme's default."""
    host = F.regexp_replace(hostname(url), r"\.+$", "")
    shown = F.when((port(url) == "") | _default_port(url), host).otherwise(F.concat(host, F.lit(":"), port(url).try_cast("int").cast("string")))
    return F.when((host != "") & port_is_valid(url), shown).otherwise(F.lower(raw_authority(url)))


def scope_host_key(url: Column | str) -> Column:
    """Host and port by which an archive is told from others: without trailing dots, and without 80 and 443 whatever the scheme."""
    host, p = F.regexp_replace(hostname(url), r"\.+$", ""), port(url).try_cast("int")
    shown = F.when(p.isNull() | p.isin(80, 443), host).otherwise(F.concat(host, F.lit(":"), p.cast("string")))
    return F.when(port_is_valid(url), shown).otherwise(F.lower(raw_authority(url)))


def site(url: Column | str) -> Column:
    """Host in lower case, without user, port, leading 'www.' and trailing dot; NULL where there is no host."""
    host = F.regexp_replace(F.lower(authority(F.trim(col(url)))), r":\d*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", ""), F.lit(""))


def basename(url: Column | str) -> Column:
    return F.regexp_extract(path(url), r"([^/]*)$", 1)


def extension(url: Column | str) -> Column:
    """Lower-case extension of the path's last part, 'html' if there is none; dot files have none."""
    ext = F.lower(F.regexp_extract(basename(url), r"^\.*[^.].*\.([^.]*)$", 1))
    return F.when(col(url).isNotNull(), F.coalesce(F.nullif(ext, F.lit("")), F.lit("html")))


def document_extension(url: Column | str, mimetype: Column | str) -> Column:
    """The URL's extension if it is a document's or image's, else the MIME type's, else the URL's."""
    ext = extension(url)
    mime = F.lower(F.trim(F.regexp_extract(F.coalesce(col(mimetype), F.lit("")), r"^([^;]*)", 1)))
    table = F.create_map(*[F.lit(x) for kv in schema.MIME_EXTENSIONS.items() for x in kv])
    known = ext.isin(*schema.DOCUMENT_EXTENSIONS, *schema.IMAGE_EXTENSIONS)
    return F.when(known, ext).otherwise(F.coalesce(F.try_element_at(table, mime), ext))


def is_html(url: Column | str, mimetype: Column | str) -> Column:
    return extension(url).isin(*schema.HTML_EXTENSIONS) | F.coalesce(F.lower(col(mimetype)).startswith("text/html"), F.lit(False))


def link_key(url: Column | str) -> Column:
    """Key by which links are looked up: no fragment, user, default port or trailing slash; NULL for a bad port."""
    host = hostname(url)
    p = port(url).try_cast("int")
    shown = F.when(F.coalesce(p, F.lit(0)) == 0, host).when(_default_port(url), host).otherwise(F.concat(host, F.lit(":"), p.cast("string")))
    trimmed = F.regexp_replace(path(url), r"/+$", "")
    full_path = F.when(trimmed == "", "/").otherwise(trimmed)
    q = query(url)
    prefix = F.when(scheme(url) == "", "").otherwise(F.concat(scheme(url), F.lit("://")))
    return F.when(port_is_valid(url), F.concat(prefix, shown, full_path, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))


def registry_keys(url: Column | str) -> Column:
    """Keys under which a page is registered: its own, and its forms with and without index.html; sorted."""
    key = link_key(url)
    p, q = path(url), query(url)
    full = F.when(p == "", "/").otherwise(p)
    head = F.concat(scheme(url), F.lit("://"), F.lower(raw_authority(url)))
    tail = F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))
    at = lambda new: link_key(F.concat(head, new, tail))
    last = F.regexp_extract(full, r"([^/]*)$", 1)
    dotted = last.rlike(r"^\.*[^.].*\.")
    slash = full.endswith("/")
    index = F.concat(F.regexp_replace(full, r"/+$", ""), F.lit("/index.html"))
    options = F.array(
        key,
        F.when(slash | ~dotted, at(index)),
        F.when(full.endswith("/index.html"), at(F.regexp_replace(full, r"index\.html$", ""))),
    )
    return F.array_sort(F.array_distinct(F.array_compact(options)))


def sanitized(name: Column | str) -> Column:
    """A path segment that every file system takes."""
    s = F.regexp_replace(col(name), r'[<>:"|?*\x00-\x1f/\\]', "_")
    s = F.regexp_replace(s, r"^[. ]+|[. ]+$", "")
    # every step names its input once, so that nesting doesn't multiply the plan
    s = F.coalesce(F.nullif(s, F.lit("")), F.when(col(name).isNotNull(), F.lit("_")))
    s = F.regexp_replace(s, "(?i)^(" + "|".join(schema.RESERVED_NAMES) + r")(?=\.|$)", "_$1")
    return F.substring(s, 1, 120)


def relative_path(url: Column | str) -> Column:
    """Where a page's file goes: host/parts, index.html for directories, a hash of the query in the name."""
    host = sanitized(F.lower(raw_authority(url)))
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    clean = F.transform(parts, lambda x: sanitized(x))
    last = F.when(F.size(clean) > 0, F.element_at(clean, -1)).otherwise("")
    full = F.when(~last.contains("."), F.concat(clean, F.array(F.lit("index.html")))).otherwise(clean)
    name = F.element_at(full, -1)
    ext = F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    q = query(url)
    marked = F.when(q == "", name).otherwise(F.concat(stem, F.lit("__q_"), F.substring(F.sha1(q.cast("binary")), 1, 12), ext))
    front = F.slice(full, F.lit(1), F.size(full) - 1)
    return F.when(col(url).isNotNull(), F.array_join(F.concat(F.array(host), front, F.array(marked)), "/"))


def guarded_path(full: Column, folder: Column, url: Column | str, longest: int = 250) -> Column:
    """The path, or a hashed name in the folder if it is too long."""
    ext = F.regexp_extract(full, r"(\.[^./]*)$", 1)
    return F.when(F.length(full) <= longest, full).otherwise(F.concat(folder, F.lit("/"), F.substring(F.sha1(col(url).cast("binary")), 1, 12), ext))


def clean_basename(url: Column | str) -> Column:
    """Last part of the path, percent escapes decoded ('+' stays), as a safe name; 'file' if there is none."""
    base = F.coalesce(F.nullif(basename(url), F.lit("")), F.when(col(url).isNotNull(), F.lit("file")))
    return sanitized(F.coalesce(F.try_url_decode(F.regexp_replace(base, r"\+", "%2B")), base))


def dated_name(base: Column, timestamp: Column, forced: Column | None = None) -> Column:
    """'<date>_<name>' for document views; the forced extension replaces a different one."""
    from tidemark.functions import times

    ext = F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    if forced is not None:
        differs = F.lower(F.regexp_replace(ext, r"^\.", "")) != F.lower(forced)
        ext = F.when(differs, F.concat(F.lit("."), forced)).otherwise(ext)
    return F.concat(times.date_only(timestamp), F.lit("_"), stem, ext)
