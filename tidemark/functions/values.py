"""Numbers kept as text, sizes, hashes and contact values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.urls import col

#: What counts as an address and as a phone number.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+7|\+3\d{2}|\+\d{1,3}|8)[\s\-()]*\d{2,4}[\s\-()]*\d{2,3}[\s\-()]*\d{2}[\s\-()]*\d{2}"
#: Parts of addresses that are no contacts.
JUNK_EMAIL_PARTS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".css", ".js", "example.com", "domain.com", "sentry.io", "@2x", "u003")
#: Profile addresses by network.
NETWORKS = {
    "VK": r"https?://(?:www\.)?vk\.com/[A-Za-z0-9_.\-]+(?:\?[^\s\"'<>]*)?",
    "Telegram": r"https?://(?:www\.)?(?:t\.me|telegram\.me)/[A-Za-z0-9_]+(?:\?[^\s\"'<>]*)?",
    "Instagram": r"https?://(?:www\.)?instagram\.com/[A-Za-z0-9_.]+(?:\?[^\s\"'<>]*)?",
    "Facebook": r"https?://(?:www\.)?facebook\.com/[A-Za-z0-9_.\-]+(?:\?[^\s\"'<>]*)?",
    "Twitter/X": r"https?://(?:www\.)?(?:twitter\.com|x\.com)/[A-Za-z0-9_]+(?:\?[^\s\"'<>]*)?",
    "YouTube": r"https?://(?:www\.)?(?:youtube\.com/(?:channel|user|c|@)[A-Za-z0-9_/\-]+|youtu\.be/[A-Za-z0-9_\-]+)(?:\?[^\s\"'<>]*)?",
    "LinkedIn": r"https?://(?:[a-z]{2}\.)?linkedin\.com/(?:in|company)/[A-Za-z0-9_\-]+(?:\?[^\s\"'<>]*)?",
    "OK": r"https?://(?:www\.)?ok\.ru/[A-Za-z0-9_./\-]+(?:\?[^\s\"'<>]*)?",
    "WhatsApp": r"https?://(?:wa\.me|api\.whatsapp\.com)/[A-Za-z0-9_?=/\-]+",
}
UNITS = ("B", "KB", "MB", "GB", "TB")


def digits_or_zero(c: Column | str) -> Column:
    """Whole number of a text of digits, 0 for everything else."""
    return F.when(col(c).rlike(r"^[0-9]+$"), F.coalesce(col(c).try_cast("bigint"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def number_or_zero(c: Column | str) -> Column:
    """Whole number of a trimmed text with or without sign, 0 for everything else."""
    t = F.trim(col(c))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), F.coalesce(t.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def human_size(n: Column | str) -> Column:
    """'1.2 KB' with one decimal, ties to even; '?' for what is no number."""
    v = col(n).try_cast("double")
    out = F.lit(None).cast("string")
    for i in reversed(range(len(UNITS))):
        scaled = F.bround(v / F.lit(float(1024**i)), 1)
        text = F.concat(F.format_string("%.1f", scaled), F.lit(f" {UNITS[i]}"))
        out = text if i == len(UNITS) - 1 else F.when(v < float(1024 ** (i + 1)), text).otherwise(out)
    return F.when(v.isNull(), "?").otherwise(out)


def store_digest(url: Column | str, timestamp: Column | str, digest: Column | str) -> Column:
    """The trimmed digest, or 'local_' and a hash of URL and time for placeholders."""
    d = F.trim(F.coalesce(col(digest), F.lit("")))
    local = F.concat(F.lit("local_"), F.sha1(F.concat_ws("|", col(url), col(timestamp)).cast("binary")))
    return F.when((F.length(d) < 8), local).otherwise(d)


def sha1_base32(content: Column | str) -> Column:
    """Base32 of the SHA-1, lower case, from four groups of 40 bits."""
    h = F.sha1(col(content))
    groups = [F.lpad(F.conv(F.substring(h, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567")


def clean_phone(raw: Column | str) -> Column:
    """Digits of a phone number, 8 as country code read as 7; NULL if it can't be one."""
    d = F.regexp_replace(col(raw), r"\D", "")
    d = F.when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 20))).otherwise(d)
    varied = F.size(F.array_distinct(F.split(d, ""))) > 2
    return F.when(F.length(d).between(10, 15) & varied, d)


def phone_confidence(raw: Column | str) -> Column:
    return F.when(col(raw).rlike(r"[\s\-()]"), "high").otherwise("low")


def is_junk_email(address: Column) -> Column:
    out = F.lit(False)
    for part in JUNK_EMAIL_PARTS:
        out = out | address.contains(part)
    return out
