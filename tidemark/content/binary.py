"""Bytes of stored files: gzip wrappers, structure checks, integrity, and the metadata of PDF, Office and photos.

Column expressions where the JVM can look at the bytes; Arrow functions only for parsers. Callers dedup by
digest before scanning and fan out after (operators.captures), since no optimizer moves a Python function below
a join.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import urls, values

MAX_BYTES = 2 * 1024**3
#: Limits of what is inflated, and the fields and types the formats have.
MAX_STREAM_IN, MAX_STREAM_OUT = 400_000, 2_000_000
PDF_FIELDS = ("Author", "Creator", "Producer", "Title", "Subject", "Company", "CreationDate", "ModDate")
#: Element of the package's property parts to field.
OFFICE_FIELDS = {"dc:creator": "Author", "cp:lastModifiedBy": "LastModifiedBy", "dc:title": "Title", "dcterms:created": "CreationDate", "dcterms:modified": "ModDate", "Company": "Company", "Application": "Creator", "Manager": "Manager"}
XMP_FIELDS = {"Author": "dc:creator", "Title": "dc:title", "Creator": "xmp:CreatorTool", "Producer": "pdf:Producer"}
#: EXIF tags.
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "date_time", 0x9003: "date_time_original", 0x8298: "copyright", 0x013B: "artist"}
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


# -- gzip wrappers ------------------------------------------------------------------------------------------


def is_wrapped(content: Column, url: Column | str, mimetype: Column | str) -> Column:
    """Gzip bytes that are a transfer encoding, not a gzip file."""
    mime = F.lower(F.coalesce(urls.col(mimetype), F.lit("")))
    gzip_mime = mime.rlike(r"^\s*application/(x-)?gzip|^\s*application/x-tgz")
    return content.startswith(F.lit(b"\x1f\x8b")) & ~urls.extension(url).isin(*schema.GZIP_EXTENSIONS) & ~gzip_mime


def inflate(raw: bytes | None, limit: int = MAX_BYTES) -> bytes | None:
    """Content of a gzip file up to the limit; None for damaged files."""
    if raw is None:
        return None
    try:
        d = zlib.decompressobj(31)
        out = d.decompress(raw, limit)
        return out if d.eof else None
    except zlib.error:
        return None


def unwrapped(content: Column, url: Column | str, mimetype: Column | str) -> Column:
    """Content without its gzip transfer encoding; NULL if that is damaged."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(inflate)

    wrapped = is_wrapped(content, url, mimetype)
    return F.when(wrapped, run(F.when(wrapped, content))).otherwise(content)


# -- structure and integrity --------------------------------------------------------------------------------


def _zip_error(raw: bytes | None) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            bad = z.testzip()
        return f"ZIP CRC error: {bad}" if bad else None
    except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError, RuntimeError):
        return "invalid ZIP structure"


def structure(content: Column, url: Column | str, mimetype: Column | str) -> Column:
    """struct(status, detail): OK, WARNING or BROKEN by the signatures of the file's type."""

    @F.pandas_udf("string")
    def zip_error(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _zip_error(x) for x in s], dtype=object)

    ext = urls.extension(url)
    mime = F.lower(F.trim(F.regexp_extract(F.coalesce(urls.col(mimetype), F.lit("")), r"^([^;]*)", 1)))
    head, tail = F.substring(content, 1, 16), F.substring(content, F.greatest(F.lit(1), F.octet_length(content) - 4095), F.lit(4096))
    tail_text = F.decode(tail, "ISO-8859-1")
    head_text = F.lower(F.decode(head, "ISO-8859-1"))
    b = lambda x: F.lit(x)
    say = lambda status, detail="": F.struct(F.lit(status).alias("status"), F.lit(detail).alias("detail"))
    pdf = F.when(~head.startswith(b(b"%PDF-")), say("BROKEN", "missing %PDF- signature")).when(~tail_text.contains("%%EOF"), say("WARNING", "no %%EOF marker")).when(~tail_text.contains("startxref"), say("WARNING", "no startxref marker")).otherwise(say("OK"))
    jpeg = F.when(~head.startswith(b(b"\xff\xd8")), say("BROKEN", "missing JPEG start")).when(~content.endswith(b(b"\xff\xd9")), say("WARNING", "no JPEG end")).otherwise(say("OK"))
    png = F.when(~head.startswith(b(b"\x89PNG\r\n\x1a\n")), say("BROKEN", "missing PNG signature")).when(~tail_text.contains("IEND"), say("WARNING", "no IEND marker")).otherwise(say("OK"))
    gif = F.when(~(head.startswith(b(b"GIF87a")) | head.startswith(b(b"GIF89a"))), say("BROKEN", "missing GIF signature")).when(~content.endswith(b(b";")), say("WARNING", "no GIF trailer")).otherwise(say("OK"))
    tiff = F.when(head.startswith(b(b"II*\x00")) | head.startswith(b(b"MM\x00*")), say("OK")).otherwise(say("BROKEN", "missing TIFF signature"))
    is_zip = ext.isin("zip", "docx", "xlsx", "pptx", "odt", "ods", "odp") | (mime == "application/zip")
    zip_bad = zip_error(F.when(is_zip, content))
    archive = F.when(zip_bad.isNull(), say("OK")).otherwise(F.struct(F.lit("BROKEN").alias("status"), zip_bad.alias("detail")))
    page = F.when(head_text.rlike("<html|<!doctype|<head|<body"), say("OK")).otherwise(say("WARNING", "no HTML signature at start"))
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), say("BROKEN", "empty file"))
        .when((ext == "pdf") | (mime == "application/pdf") | head.startswith(b(b"%PDF-")), pdf)
        .when(ext.isin("jpg", "jpeg") | (mime == "image/jpeg"), jpeg)
        .when((ext == "png") | (mime == "image/png"), png)
        .when((ext == "gif") | (mime == "image/gif"), gif)
        .when(ext.isin("tif", "tiff") | (mime == "image/tiff"), tiff)
        .when(is_zip, archive)
        .when(mime.startswith("text/html") | ext.isin(*schema.HTML_EXTENSIONS), page)
        .otherwise(say("OK"))
    )


def integrity(captures: DataFrame, files: DataFrame) -> DataFrame:
    """One row per digest: (digest, status, detail, appearances).

    captures: digest, sha256, original_url, timestamp, mimetype, row_ord; files: (digest, content). MISSING
    without a file, MODIFIED if the SHA-256 or the SHA-1 in the digest differs, else the structure check.
    """
    from tidemark.operators.captures import dedup_by_digest

    count = captures.groupBy("digest").agg(F.count("*").alias("appearances"))
    one = dedup_by_digest(captures).join(files.select("digest", "content"), "digest", "left").join(count, "digest")
    content = F.col("content")
    hash_off = F.col("sha256").isNotNull() & (F.trim("sha256") != "") & (F.lower(F.trim("sha256")) != F.sha2(content, 256))
    sha1_off = F.col("digest").rlike("^[A-Za-z2-7]{32}$") & (F.lower("digest") != values.sha1_base32(content))
    found = one.withColumn("s", structure(content, "original_url", "mimetype"))
    status = F.when(content.isNull(), "MISSING").when(F.octet_length(content) == 0, "BROKEN").when(hash_off | sha1_off, "MODIFIED").otherwise(F.col("s.status"))
    detail = F.when(content.isNull(), "").when(hash_off, "SHA-256 differs").when(sha1_off, "SHA-1 differs").otherwise(F.col("s.detail"))
    return found.select("digest", status.alias("status"), detail.alias("detail"), "appearances")


# -- documents ----------------------------------------------------------------------------------------------


def looks_like_text(s: str, share: float = 0.85) -> bool:
    return bool(s) and len(s) <= 500 and sum(c.isprintable() for c in s) >= share * len(s)


def pdf_string(raw: bytes) -> str:
    """Text of a PDF string: UTF-16 with or without mark, UTF-8, else one byte a character."""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    if len(raw) >= 4 and len(raw) % 2 == 0 and raw[::2].count(0) > len(raw) // 3:
        return raw.decode("utf-16-be", "replace")
    for name in ("utf-8", "cp1251"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def literal_string(data: bytes, at: int) -> bytes:
    """Bytes of the literal string that opens at `at`: nested brackets, escapes and octal codes."""
    out, depth, i = bytearray(), 0, at
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            nxt = data[i + 1 : i + 2]
            octal = re.match(rb"[0-7]{1,3}", data[i + 1 : i + 4])
            if octal:
                out.append(int(octal[0], 8) & 255)
                i += 1 + len(octal[0])
                continue
            if nxt in b"\r\n" and nxt:
                i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                continue
            out += ESCAPES.get(nxt, nxt)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if depth == 0:
            break
        if not (c == b"(" and depth == 1):
            out += c
        i += 1
    return bytes(out)


def pdf_fields(data: bytes, found: dict[str, str]) -> None:
    for name in PDF_FIELDS:
        if name in found:
            continue
        m = re.search(rb"/" + name.encode() + rb"\s*(\(|<(?!<))", data)
        if m and m[1] == b"(":
            value = pdf_string(literal_string(data, m.end() - 1)).strip()
        elif m:
            digits = re.sub(rb"\s", b"", data[m.end() :].partition(b">")[0])
            try:
                value = pdf_string(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())).strip()
            except ValueError:
                continue
        elif name in XMP_FIELDS:
            tag = XMP_FIELDS[name].encode()
            x = re.search(rb"<" + tag + rb"[^>]*>(.*?)</" + tag + rb">", data, re.DOTALL)
            value = re.sub(r"<[^>]+>", " ", x[1].decode("utf-8", "replace")).strip() if x else ""
        else:
            continue
        if looks_like_text(value):
            found[name] = value


def pdf_metadata(data: bytes | None) -> tuple[dict[str, str], str | None]:
    """Fields of a PDF, and the reason if there are none. Streams are inflated only if the plain bytes tell little."""
    if not data or not data.lstrip()[:5] == b"%PDF-":
        return {}, "does not look like a PDF"
    found: dict[str, str] = {}
    pdf_fields(data, found)
    if len(found) < 2:
        for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.DOTALL):
            if len(m[1]) <= MAX_STREAM_IN:
                try:
                    pdf_fields(zlib.decompressobj().decompress(m[1], MAX_STREAM_OUT), found)
                except zlib.error:
                    continue
    return found, None if found else "metadata not found"


def office_metadata(data: bytes | None) -> tuple[dict[str, str], str | None]:
    """Fields of an Office package, and the reason if there are none."""
    if not data or data[:4] != b"PK\x03\x04":
        return {}, "does not look like an Office package"
    found: dict[str, str] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for part in ("docProps/core.xml", "docProps/app.xml"):
                if part not in z.namelist():
                    continue
                xml = z.read(part).decode("utf-8", "replace")
                for tag, name in OFFICE_FIELDS.items():
                    m = re.search(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", xml, re.DOTALL)
                    value = re.sub(r"<[^>]+>", " ", m[1]).strip() if m else ""
                    if looks_like_text(value):
                        found.setdefault(name, value[:200])
    except (zipfile.BadZipFile, OSError, KeyError, zlib.error, RuntimeError):
        return {}, "file is damaged"
    return found, None if found else "metadata not found"


def document_metadata(content: Column, ext: Column) -> Column:
    """struct(meta MAP, reason) by the document's type."""

    @F.pandas_udf("struct<meta:map<string,string>,reason:string>")
    def run(s: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = [(pdf_metadata if k == "pdf" else office_metadata)(c) for c, k in zip(s, kind)]
        return pd.DataFrame({"meta": [o[0] for o in out], "reason": [o[1] for o in out]})

    return run(content, ext)


# -- photos -------------------------------------------------------------------------------------------------


def _directory(data: bytes, at: int, order: str) -> dict[int, object]:
    """Entries of an image file directory; unreadable ones are left out."""
    out: dict[int, object] = {}
    if at + 2 > len(data):
        return out
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * i
        if entry + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        size = TYPE_SIZES.get(kind, 0) * count
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        raw = data[start : start + size]
        if not size or len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\x00")[0].decode("utf-8", "replace").strip()
        elif kind in (3, 4):
            numbers = struct.unpack(order + ("H" if kind == 3 else "I") * count, raw)
            out[tag] = numbers[0] if count == 1 else list(numbers)
        elif kind == 5:
            pairs = struct.unpack(order + "II" * count, raw)
            values_ = [n / d if d else 0.0 for n, d in zip(pairs[::2], pairs[1::2])]
            out[tag] = values_[0] if count == 1 else values_
    return out


def degrees(parts: object, ref: object) -> float | None:
    """Decimal degrees, south and west negative."""
    if not isinstance(parts, list) or len(parts) != 3:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return round(-value if ref in ("S", "W") else value, 6)


def exif(data: bytes | None) -> dict[str, object]:
    """Fields of a photo's EXIF block: JPEG segments or a bare TIFF file."""
    if not data:
        return {}
    block = data if data[:4] in (b"II*\x00", b"MM\x00*") else b""
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 4 <= len(data) and data[i] == 0xFF and data[i + 1] != 0xDA:
            length = struct.unpack_from(">H", data, i + 2)[0]
            if data[i + 1] == 0xE1 and data[i + 4 : i + 10] == b"Exif\x00\x00":
                block = data[i + 10 : i + 2 + length]
                break
            i += 2 + length
    if len(block) < 8 or block[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if block[:2] == b"II" else ">"
    first = _directory(block, struct.unpack_from(order + "I", block, 4)[0], order)
    more = _directory(block, first[EXIF_POINTER], order) if isinstance(first.get(EXIF_POINTER), int) else {}
    gps = _directory(block, first[GPS_POINTER], order) if isinstance(first.get(GPS_POINTER), int) else {}
    out: dict[str, object] = {name: v for tag, name in EXIF_TAGS.items() if isinstance(v := more.get(tag, first.get(tag)), str) and v}
    lat, lon = degrees(gps.get(2), gps.get(1)), degrees(gps.get(4), gps.get(3))
    return out | ({"lat": lat} if lat is not None else {}) | ({"lon": lon} if lon is not None else {})


EXIF_SCHEMA = ", ".join([*(f"{n} string" for n in EXIF_TAGS.values()), "lat double", "lon double"])


def photo_metadata(content: Column) -> Column:
    names = [*EXIF_TAGS.values(), "lat", "lon"]

    @F.pandas_udf(EXIF_SCHEMA)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [exif(c) for c in s]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype="float64" if n in ("lat", "lon") else object) for n in names})

    return run(content)
