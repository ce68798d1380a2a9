"""DuckDB spellings of the expressions in tidemark.functions, for the equivalent SQL of the queries."""

from __future__ import annotations

from tidemark import schema
from tidemark.functions import values


def quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def raw_authority(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def authority(u: str) -> str:
    return f"regexp_replace({raw_authority(u)}, '^.*@', '')"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def port(u: str) -> str:
    return f"regexp_extract({authority(u)}, ':([0-9]*)$', 1)"


def port_ok(u: str) -> str:
    tail = f"regexp_extract({authority(u)}, '(?:\\]|^[^:\\[\\]]*):(.*)$', 1)"
    return f"({tail} = '' OR (regexp_full_match({tail}, '[0-9]{{1,9}}') AND coalesce(try_cast({tail} AS INTEGER) <= 65535, false)))"


def host(u: str) -> str:
    return f"lower(regexp_replace({authority(u)}, ':[0-9]*$', ''))"


def default_port(u: str) -> str:
    return f"(({scheme(u)} = 'http' AND {port(u)} = '80') OR ({scheme(u)} = 'https' AND {port(u)} = '443'))"


def domain(u: str) -> str:
    h = f"regexp_replace({host(u)}, '[.]+$', '')"
    shown = f"CASE WHEN {port(u)} = '' OR {default_port(u)} THEN {h} ELSE {h} || ':' || CAST(try_cast({port(u)} AS INTEGER) AS VARCHAR) END"
    return f"CASE WHEN {h} <> '' AND {port_ok(u)} THEN {shown} ELSE lower({raw_authority(u)}) END"


def site(u: str) -> str:
    h = f"regexp_replace(lower(regexp_replace(regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', '')), ':[0-9]*$', '')"
    return f"nullif(regexp_replace(regexp_replace({h}, '[.]+$', ''), '^www[.]', ''), '')"


def basename(u: str) -> str:
    return f"regexp_extract({path(u)}, '([^/]*)$', 1)"


def extension(u: str) -> str:
    return f"CASE WHEN {u} IS NOT NULL THEN coalesce(nullif(lower(regexp_extract({basename(u)}, '^[.]*[^.].*[.]([^.]*)$', 1)), ''), 'html') END"


def document_extension(u: str, m: str) -> str:
    mime = f"lower(trim(regexp_extract(coalesce({m}, ''), '^([^;]*)', 1)))"
    whens = " ".join(f"WHEN {mime} = '{k}' THEN '{v}'" for k, v in schema.MIME_EXTENSIONS.items())
    known = quoted((*schema.DOCUMENT_EXTENSIONS, *schema.IMAGE_EXTENSIONS))
    return f"CASE WHEN ({extension(u)}) IN ({known}) THEN {extension(u)} {whens} ELSE {extension(u)} END"


def link_key(u: str) -> str:
    p = f"coalesce(try_cast({port(u)} AS INTEGER), 0)"
    shown = f"CASE WHEN {p} = 0 OR {default_port(u)} THEN {host(u)} ELSE {host(u)} || ':' || CAST({p} AS VARCHAR) END"
    full = f"CASE WHEN regexp_replace({path(u)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({path(u)}, '/+$', '') END"
    pre = f"CASE WHEN {scheme(u)} = '' THEN '' ELSE {scheme(u)} || '://' END"
    return f"CASE WHEN {port_ok(u)} THEN {pre} || {shown} || {full} || CASE WHEN {query(u)} = '' THEN '' ELSE '?' || {query(u)} END END"


def sanitized(s: str) -> str:
    clean = f"regexp_replace(regexp_replace({s}, '[<>:\"|?*\\x00-\\x1f/\\\\]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g')"
    full = f"CASE WHEN {clean} = '' THEN '_' ELSE {clean} END"
    return f"substr(CASE WHEN upper(regexp_extract({full}, '^([^.]*)', 1)) IN ({quoted(schema.RESERVED_NAMES)}) THEN '_' || {full} ELSE {full} END, 1, 120)"


def digits_or_zero(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '[0-9]+') THEN coalesce(try_cast({c} AS BIGINT), 0) ELSE 0 END"


def number_or_zero(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN coalesce(try_cast(trim({c}) AS BIGINT), 0) ELSE 0 END"


def parsed(ts: str) -> str:
    return f"CASE WHEN regexp_full_match(substr({ts}, 1, 14), '[0-9]{{14}}') THEN try_strptime(substr({ts}, 1, 14), '%Y%m%d%H%M%S') END"


def date_only(ts: str) -> str:
    return f"coalesce(strftime({parsed(ts)}, '%Y-%m-%d'), '0000-00-00')"


def store_digest(u: str, ts: str, d: str) -> str:
    return f"CASE WHEN length(trim(coalesce({d}, ''))) < 8 THEN 'local_' || sha1({u} || '|' || {ts}) ELSE trim({d}) END"


def human_size(n: str) -> str:
    v = f"try_cast({n} AS DOUBLE)"
    whens = " ".join(f"WHEN {v} < {1024 ** (i + 1)}.0 THEN printf('%.1f', {v} / {1024**i}.0) || ' {unit}'" for i, unit in enumerate(values.UNITS[:-1]))
    return f"CASE WHEN {v} IS NULL THEN '?' {whens} ELSE printf('%.1f', {v} / {1024**4}.0) || ' TB' END"


def is_permanent(r: str) -> str:
    low = f"lower({r})"
    return (
        f"coalesce(starts_with(ltrim({r}), '[PERMANENT]') OR (regexp_matches({low}, 'http error 4[0-9][0-9]') AND NOT regexp_matches({low}, 'http error (408|429)')) "
        f"OR contains({low}, 'sha-1 digest mismatch') OR contains({low}, 'file exceeds size limit') OR contains({low}, 'server returned an empty file'), false)"
    )


def relative_path(u: str) -> str:
    """As a lateral-free expression over lists."""
    parts = f"list_transform(list_filter(string_split({path(u)}, '/'), lambda x: x <> ''), lambda x: {sanitized('x')})"
    full = f"CASE WHEN contains(coalesce(list_extract({parts}, -1), ''), '.') THEN {parts} ELSE list_append({parts}, 'index.html') END"
    name = f"list_extract({full}, -1)"
    ext = f"regexp_extract({name}, '^[.]*[^.].*([.][^.]*)$', 1)"
    marked = f"CASE WHEN {query(u)} = '' THEN {name} ELSE substr({name}, 1, length({name}) - length({ext})) || '__q_' || substr(sha1({query(u)}), 1, 12) || {ext} END"
    return f"array_to_string(list_concat(list_concat([{sanitized(f'lower({raw_authority(u)})')}], list_slice({full}, 1, len({full}) - 1)), [{marked}]), '/')"
