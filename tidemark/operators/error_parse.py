"""Rows that fail to parse (problem 7): minimum-cost error parse of delimited records.

A record is a sequence of quotes, delimiters and text runs. Dynamic programming over (field, mode) finds the
cheapest insertions and deletions of quotes and delimiters that make it a row of the wanted width. Costs are
pairs (quoting repairs, delimiter repairs) in that order of weight, so a record whose quoting is sound is
never requoted to mend its width. A row of cost zero whose values have the right types loads; else the
repairs, or the value, are the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from ipaddress import IPv6Address

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import runtime

START, BARE, QUOTED, CLOSED = range(4)
MAX_INT64 = 2**63 - 1


@dataclass(frozen=True)
class Form:
    """A kind of record: its columns, delimiter and quote (None: no quoting)."""

    columns: tuple[str, ...]
    delimiter: str
    quote: str | None


INDEX = Form(("original", "timestamp", "digest", "mimetype", "statuscode", "length"), " ", None)
QUEUE = Form(("original_url", "timestamp", "digest", "mimetype", "statuscode", "length", "reason"), ",", '"')
FORMS = {"index": INDEX, "queue": QUEUE}
URL = re.compile(r"https?://(?:[^/?#@\s]*@)?(\[[^\]/?#\s]*\]|[^/?#:@\s\[\]]+)(?::(\d*))?(?:[/?#].*)?", re.IGNORECASE | re.DOTALL)


def tokens(raw: str, form: Form) -> list[tuple[str, str]]:
    """(kind, text): 'Q' quote, 'D' delimiter, 'T' run of other characters."""
    signs = re.escape(form.delimiter) + (re.escape(form.quote) if form.quote else "")
    out = []
    for piece in re.findall(f"[{signs}]|[^{signs}]+", raw):
        out.append(("D" if piece == form.delimiter else "Q" if piece == form.quote else "T", piece))
    return out


def sound_fields(toks: list[tuple[str, str]]) -> list[str] | None:
    """The fields of a record whose quoting is sound, whatever their number; None if it isn't."""
    fields, text, mode = [], [], START
    for kind, piece in toks:
        if kind == "D" and mode != QUOTED:
            fields.append("".join(text))
            text, mode = [], START
        elif kind == "Q":
            if mode == BARE:
                return None
            if mode == CLOSED:
                text.append(piece)
            mode = CLOSED if mode == QUOTED else QUOTED
        elif mode == CLOSED:
            return None
        else:
            text.append(piece)
            mode = BARE if mode == START else mode
    if mode == QUOTED:
        return None
    return [*fields, "".join(text)]


def _step(mode: int, kind: str) -> tuple[int, int] | None:
    """(mode, fields begun) after a token that the grammar allows."""
    if kind == "D":
        return (QUOTED, 0) if mode == QUOTED else (START, 1)
    if kind == "Q":
        return None if mode == BARE else (CLOSED, 0) if mode == QUOTED else (QUOTED, 0)
    return None if mode == CLOSED else (QUOTED, 0) if mode == QUOTED else (BARE, 0)


def cheapest_repair(toks: list[tuple[str, str]], width: int) -> tuple[tuple[int, int], list[str]]:
    """Cost (quoting repairs, delimiter repairs) and the repairs of the cheapest parse into `width` fields."""
    best = {(0, START): ((0, 0), ())}
    ahead = [*(k for k, _ in toks), None]

    def put(to: dict, state: tuple[int, int], cost: tuple[int, int], ops: tuple) -> bool:
        if state[0] < width and (state not in to or cost < to[state][0]):
            to[state] = (cost, ops)
            return True
        return False

    for i, nxt in enumerate(ahead):
        queue = list(best)
        while queue:  # insertions before the next token
            state = queue.pop()
            (q, d), ops = best[state]
            field, mode = state
            if mode != BARE and nxt is not None or mode == QUOTED:
                after = CLOSED if mode == QUOTED else QUOTED
                if put(best, (field, after), (q + 1, d), (*ops, f"insert quote at {i}")):
                    queue.append((field, after))
            if mode != QUOTED:
                # a delimiter that parts text from a closing quote, or opens a quoted field, mends the quoting
                mends = mode == CLOSED and nxt == "T" or mode == BARE and nxt == "Q"
                if put(best, (field + 1, START), (q + mends, d + 1), (*ops, f"insert delimiter at {i}")):
                    queue.append((field + 1, START))
        if nxt is None:
            break
        to: dict = {}
        for (field, mode), ((q, d), ops) in best.items():
            if step := _step(mode, nxt):
                put(to, (field + step[1], step[0]), (q, d), ops)
            if nxt == "Q":
                put(to, (field, mode), (q + 1, d), (*ops, f"delete quote at {i}"))
            elif nxt == "D":
                put(to, (field, mode), (q, d + 1), (*ops, f"delete delimiter at {i}"))
        best = to or best
    ends = [best[(width - 1, m)] for m in (START, BARE, CLOSED) if (width - 1, m) in best]
    cost, ops = min(ends) if ends else ((len(toks), 0), ("no repair",))
    return cost, list(ops)


def is_http_url(value: str) -> bool:
    """Absolute http or https URL with a host and, if given, a port from 1 to 65535."""
    m = URL.fullmatch(value)
    if not m:
        return False
    if m[1].startswith("["):
        try:
            IPv6Address(m[1][1:-1])
        except ValueError:
            return False
    return not m[2] or len(m[2]) < 10 and 1 <= int(m[2]) <= 65535


def is_length(value: str) -> bool:
    """Missing (empty or '-'), or decimal digits that fit a signed 64-bit integer."""
    if value in ("", "-"):
        return True
    return value.isascii() and value.isdigit() and int(value[-25:]) <= MAX_INT64 and not value[:-25].strip("0")


def parse(raw: str | None, form: Form) -> tuple[list[str] | None, str | None, str | None]:
    """(fields, reason, detail): fields of a good record, else the reason and the repairs or the bad value."""
    toks = tokens(raw or "", form)
    fields = sound_fields(toks)
    if fields is None or len(fields) != len(form.columns):
        # sound quoting makes it a wrong width, even where mending that takes quotes
        _, ops = cheapest_repair(toks, len(form.columns))
        return None, "quoting" if fields is None else "columns", "; ".join(ops)
    if not is_http_url(fields[0]):
        return None, "value", f"{form.columns[0]}: {fields[0]}"
    if not is_length(fields[5]):
        return None, "value", f"length: {fields[5]}"
    return fields, None, None


def records(lines: DataFrame) -> DataFrame:
    """Lines without the empty line and resume key that may end an index page.

    Two small aggregates by page tell the last line and the line before it: a page is a row per map task in the
    shuffle, however long it is.
    """
    index = lines.filter(F.col("kind") == "index")
    last = index.groupBy("page_no").agg(F.max("line_no").alias("last"))
    before = index.join(last, "page_no").filter(F.col("line_no") < F.col("last")).groupBy("page_no", "last")
    ends = before.agg(F.max(F.struct("line_no", (F.coalesce("raw", F.lit("")) == "").alias("empty"))).alias("b"))
    closing = ends.filter("b.empty").select("page_no", F.explode(F.array("last", "b.line_no")).alias("line_no"))
    # a page's two closing lines are found by their own key, so that a long page is never one task's; other kinds pass by
    closing = runtime.written(closing.distinct(), runtime.new_dir(lines.sparkSession, "closing"))
    kept = runtime.join_small(index, closing, ["page_no", "line_no"], "left_anti").select(*lines.columns)
    return kept.unionByName(lines.filter((F.col("kind") != "index") | F.col("kind").isNull()))


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (line_id, page_no, line_no, kind, raw) to (line_id, kind, fields ARRAY, reason, detail).

    One row per record: fields for good ones, reason ('quoting', 'columns' or 'value') and detail for others.
    A NULL raw is an empty record; records of an unknown or NULL kind get the reason 'kind'. Other columns are
    ignored, repeated rows stay repeated, an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(r, FORMS[k]) if k in FORMS else (None, "kind", k) for k, r in zip(pdf["kind"], pdf["raw"])]
            yield pd.DataFrame({
                "line_id": pdf["line_id"], "kind": pdf["kind"], "fields": pd.Series([r[0] for r in rows], dtype=object, index=pdf.index),
                "reason": pd.Series([r[1] for r in rows], dtype=object, index=pdf.index), "detail": pd.Series([r[2] for r in rows], dtype=object, index=pdf.index),
            })

    rows = records(lines.select("line_id", "page_no", "line_no", "kind", "raw")).select("line_id", "kind", "raw")
    return rows.mapInPandas(run, "line_id bigint, kind string, fields array<string>, reason string, detail string")
