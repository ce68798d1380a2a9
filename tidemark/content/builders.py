"""Small files with given metadata, for exact round trips through the parsers."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape


def pdf(fields: dict[str, str | None]) -> bytes:
    """A minimal PDF whose info dictionary holds the fields as UTF-16 literal strings."""
    parts = []
    for name, value in fields.items():
        if value:
            raw = ("﻿" + value).encode("utf-16-be")
            parts.append(b"/" + name.encode() + b" (" + b"".join(b"\\%03o" % c if c in b"()\\\r\n" or c < 32 or c > 126 else bytes([c]) for c in raw) + b")")
    return b"%PDF-1.4\n1 0 obj\n<< " + b" ".join(parts) + b" >>\nendobj\nstartxref\n0\n%%EOF"


def office(core: dict[str, str | None], app: dict[str, str | None]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, root, fields in (("docProps/core.xml", "cp:coreProperties", core), ("docProps/app.xml", "Properties", app)):
            z.writestr(part, f"<{root}>" + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in fields.items() if v) + f"</{root}>")
    return out.getvalue()


def _ratios(value: float) -> bytes:
    micro = round(abs(value) * 3600 * 10**4)
    return struct.pack("<IIIIII", micro // (3600 * 10**4), 1, micro // (60 * 10**4) % 60, 1, micro % (60 * 10**4), 10**4)


def jpeg(texts: dict[int, str | None], lat: float | None = None, lon: float | None = None) -> bytes:
    """A JPEG that is nothing but an EXIF block with the given text tags and position."""
    entries, heap = [], b""
    gps = lat is not None and lon is not None and lat == lat and lon == lon
    rows = [(t, v.encode() + b"\x00") for t, v in sorted(texts.items()) if v]
    base = 8 + 2 + 12 * (len(rows) + gps) + 4
    for tag, raw in rows:
        entries.append(struct.pack("<HHI", tag, 2, len(raw)) + (raw.ljust(4, b"\x00") if len(raw) <= 4 else struct.pack("<I", base + len(heap))))
        heap += raw if len(raw) > 4 else b""
    tail = b""
    if gps:
        at = base + len(heap)
        entries.append(struct.pack("<HHII", 0x8825, 4, 1, at))
        spot = at + 2 + 48 + 4
        ref = lambda tag, c: struct.pack("<HHI", tag, 2, 2) + c + b"\x00\x00\x00"
        tail = struct.pack("<H", 4) + ref(1, b"N" if lat >= 0 else b"S") + struct.pack("<HHII", 2, 5, 3, spot) + ref(3, b"E" if lon >= 0 else b"W") + struct.pack("<HHII", 4, 5, 3, spot + 24) + b"\x00" * 4 + _ratios(lat) + _ratios(lon)
    block = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + b"\x00" * 4 + heap + tail
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\x00\x00" + block + b"\xff\xd9"
