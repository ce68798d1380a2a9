"""Timestamps of many forms and zones as UTC seconds (problem 4).

All forms are one regular expression with named groups. It runs once over a value; its parts are checked against
the calendar and put together by integer day arithmetic. The zone rules make this an Arrow function: as JVM
expressions the plan outgrows what code generation compiles.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their minutes from UTC, only those with one common meaning.
ABBREVIATIONS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "BST": 60, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
WEEKDAY = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*"


def _forms() -> list[str]:
    """One expression per form."""
    zone = r"(?:\s*(?:(?P<abbr>" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + r")|(?:GMT|UTC)?(?P<sign>[+-])(?P<zh>\d{2}):?(?P<zm>\d{2})?))?"
    clock = r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2})(?:[.,]\d+)?)?(?:\s*(?P<half>[ap]m))?"
    month = rf"(?P<name>{FULL_MONTHS})\.?"
    return [
        # document dates: D:YYYYMMDD[hh[mm[ss]]] and Z, Z00'00' or +hh'mm'
        r"d:(?P<year>\d{4})(?P<month>\d{2})(?P<day>\d{2})(?:(?P<hour>\d{2})(?:(?P<minute>\d{2})(?P<second>\d{2})?)?)?"
        r"(?:(?P<abbr>Z)(?:0{2}'?(?:0{2}'?)?)?|(?P<sign>[+-])(?P<zh>\d{2})'?(?P<zm>\d{2})?'?)?",
        # year first, one separator throughout
        rf"(?P<year>\d{{4}})-(?P<month>\d{{1,2}})-(?P<day>\d{{1,2}})(?:[t\s]\s*{clock})?{zone}",
        rf"(?P<year>\d{{4}}):(?P<month>\d{{1,2}}):(?P<day>\d{{1,2}})(?:[t\s]\s*{clock})?{zone}",
        rf"(?P<year>\d{{4}})/(?P<month>\d{{1,2}})/(?P<day>\d{{1,2}})(?:[t\s]\s*{clock})?{zone}",
        # day, month name, year
        rf"(?:{WEEKDAY},?\s+)?(?P<day>\d{{1,2}})[ -]{month}[ -](?P<year>\d{{4}})(?:,?\s+{clock})?{zone}",
        # weekday, month name, day, time, year
        rf"(?:{WEEKDAY})\s+{month}\s+(?P<day>\d{{1,2}})\s+{clock}{zone}\s+(?P<year>\d{{4}})",
        # month name, day, year
        rf"{month}\s+(?P<day>\d{{1,2}}),?\s+(?P<year>\d{{4}})(?:,?\s+{clock})?{zone}",
        # dots: day first
        rf"(?P<day>\d{{1,2}})\.(?P<month>\d{{1,2}})\.(?P<year>\d{{4}})(?:,?\s+{clock})?{zone}",
        # slashes: day and month in either order
        rf"(?P<one>\d{{1,2}})/(?P<two>\d{{1,2}})/(?P<year>\d{{4}})(?:,?\s+{clock})?{zone}",
        r"(?P<epoch>\d{10}|\d{13})",
        r"(?P<year>\d{4})(?P<month>\d{2})(?P<day>\d{2})(?P<hour>\d{2})(?P<minute>\d{2})(?P<second>\d{2})",
    ]


def _alternation() -> re.Pattern:
    """All forms as one expression; the groups of form i carry its letter, as names must differ."""
    parts = [re.sub(r"\(\?P<(\w+)>", lambda m, t=chr(97 + i): f"(?P<{m[1]}_{t}>", form) for i, form in enumerate(_forms())]
    return re.compile(r"[\s\x00]*(?:" + "|".join(parts) + r")[\s\x00]*", re.IGNORECASE | re.ASCII)


PATTERN = _alternation()
OFFSET = re.compile(r"\s*(?:(Z)|([+-])(\d{2}):?(\d{2}))\s*", re.IGNORECASE | re.ASCII)
MONTH_NUMBERS = {m: i + 1 for i, m in enumerate(MONTHS)}


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days from 1970-01-01 by whole-number arithmetic; years count from March, so the leap day is the last."""
    y -= m <= 2
    era, yoe = divmod(y, 400)
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def civil_from_days(days: int) -> tuple[int, int, int]:
    """The inverse of days_from_civil."""
    era, doe = divmod(days + 719468, 146097)
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    m = mp + 3 if mp < 10 else mp - 9
    return yoe + era * 400 + (m <= 2), m, doy - (153 * mp + 2) // 5 + 1


def days_in_month(y: int, m: int) -> int:
    if m == 2:
        return 29 if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else 28
    return 30 if m in (4, 6, 9, 11) else 31


@lru_cache(maxsize=1024)
def zone_named(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name.strip())
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _offset(sign: str, hours: int, minutes: int) -> int | None:
    total = hours * 3600 + minutes * 60
    if minutes > 59 or total > 14 * 3600:
        return None
    return -total if sign == "-" else total


def utc_seconds(value: str | None, offset: str | None, zone: str | None) -> int | None:
    """Seconds from 1970 of the instant a value names; see with_utc_second."""
    match = PATTERN.fullmatch(value) if value else None
    if not match:
        return None
    part = {k[:-2]: v for k, v in match.groupdict().items() if v is not None}
    if epoch := part.get("epoch"):
        return int(epoch) // (1000 if len(epoch) == 13 else 1)
    y = int(part["year"])
    if "one" in part:
        one, two = int(part["one"]), int(part["two"])
        if one <= 12 and two <= 12 and one != two:
            return None  # day and month can be confused
        d, m = (one, two) if one > 12 else (two, one)
    else:
        d, m = int(part["day"]), int(part["month"]) if "month" in part else MONTH_NUMBERS[part["name"][:3].lower()]
    hour, minute, second = (int(part.get(k, 0)) for k in ("hour", "minute", "second"))
    if half := part.get("half"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half.lower() == "pm")
    if not (y >= 1 and 1 <= m <= 12 and 1 <= d <= days_in_month(y, m) and hour <= 23 and minute <= 59 and second <= 59):
        return None
    local = days_from_civil(y, m, d) * 86400 + hour * 3600 + minute * 60 + second
    if "abbr" in part:
        return local - ABBREVIATIONS[part["abbr"].upper()] * 60
    if "sign" in part:
        inner = _offset(part["sign"], int(part["zh"]), int(part.get("zm", 0)))
        return None if inner is None else local - inner
    if offset and (o := OFFSET.fullmatch(offset)):
        outer = 0 if o[1] else _offset(o[2], int(o[3]), int(o[4]))
        if outer is not None:
            return local - outer
    where = zone_named(zone) if zone else None
    if where is None:
        return None
    # fold 0: the first of two equal local times, and before a gap the offset that held until then
    return local - int(datetime(y, m, d, hour, minute, second, tzinfo=where, fold=0).utcoffset().total_seconds())


def utc_text(value: str | None, offset: str | None, zone: str | None) -> str | None:
    seconds = utc_seconds(value, offset, zone)
    if seconds is None:
        return None
    days, rest = divmod(seconds, 86400)
    y, m, d = civil_from_days(days)
    return f"{y:04d}-{m:02d}-{d:02d} {rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}" if 0 < y < 10000 else None


def with_utc_second(df: DataFrame, value: str, zone: str, offset: str | None = None, out: str = "utc_second") -> DataFrame:
    """df with the UTC second ('yyyy-MM-dd HH:mm:ss') of column `value`, NULL unless it names one instant.

    An offset or abbreviation in the value counts first, then column `offset` ('+hh:mm'), then the IANA zone in
    column `zone`. Missing parts of a time are zero, fractions are cut off. Of a local time that occurs twice
    the first is meant; a skipped one is read with the offset before the change. NULL, empty and unreadable
    values, impossible dates, ambiguous slashed dates and values without any zone give NULL; an unknown zone
    name or unreadable offset counts as none. One pass over Arrow batches, no shuffle.
    """

    @F.pandas_udf("string")
    def convert(v: pd.Series, o: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([utc_text(*x) for x in zip(v, o, z)], dtype="object")

    outer = F.col(offset) if offset is not None else F.lit(None)
    return df.withColumn(out, convert(F.col(value).cast("string"), outer.cast("string"), F.col(zone).cast("string")))
