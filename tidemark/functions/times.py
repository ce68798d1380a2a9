"""14-digit capture timestamps. They stay strings and sort as strings; these expressions render them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.urls import col, sanitized


def parsed(ts: Column | str) -> Column:
    """The instant of the first 14 digits, NULL if they are no date."""
    t = F.substring(col(ts), 1, 14)
    return F.when(t.rlike(r"^\d{14}$"), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))


def pretty(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(parsed(ts), "yyyy-MM-dd HH:mm"), col(ts))


def folder(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(parsed(ts), "yyyy-MM-dd_HH-mm-ss"), sanitized(ts))


def date_only(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(parsed(ts), "yyyy-MM-dd"), F.lit("0000-00-00"))
