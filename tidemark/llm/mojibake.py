"""Problem 5: text decoded with the wrong character encoding.

A value's characters are mapped back to the bytes they would have in a legacy charset. Two repairs follow.

Multibyte: an automaton over the byte structure of UTF-8 finds maximal spans of well-formed multibyte
sequences, and only those spans are decoded; values garbled twice are repaired twice.

Single byte: words that no language would spell so (inverted case, signs inside a word, nothing but accented
letters, two scripts in one word) are decoded with the charset that makes them well-formed words.

What is lost for good (replacement characters, question marks inside words) is named but not restored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULTIBYTE = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "cp1250", "mac_cyrillic", "iso8859_5")
#: (charset the text was shown in, charset it was written in)
SINGLE = (
    ("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp866"), ("cp866", "koi8-r"),
    ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("mac_roman", "cp1251"),
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1250", "cp1252"),
)
#: Times a value is repaired at most, once for each wrong decoding; what is garbled more often is restored in part.
ROUNDS = 3
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ſƒ]")
CYRILLIC = re.compile(r"[Ѐ-ԯ]")
RUSSIAN = re.compile(r"[А-Яа-яЁё]+")
LETTERS = re.compile(r"[^\W\d_]+")
LOST = re.compile(r"�|(?<=[^\W\d_])\?(?=[^\W\d_])|[^\W\d_]\?{2,}[^\W\d_]|\?{3,}")
VOWELS = frozenset("aeiouyаеёиоуыэюяàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ")
#: The more frequent half of the Russian alphabet.
COMMON = frozenset("оеаинтсрвлкмдпу")
EDGE = "«»\"'“”„‘’()[]{},.;:!?…–—-&/"


@lru_cache(maxsize=len(MULTIBYTE) + 16)
def byte_of(charset: str) -> dict[str, int]:
    """Character to byte; bytes a charset leaves undefined stand for the control character of their number."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=64)
def char_of(charset: str) -> dict[int, str]:
    return {b: c for c, b in byte_of(charset).items()}


def to_bytes(text: str, charset: str) -> list[int]:
    """Bytes of the characters, -1 where the charset has none."""
    table = byte_of(charset)
    return [table.get(c, -1) for c in text]


def utf8_spans(codes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, sequences) of maximal runs of well-formed multibyte sequences."""
    i, n = 0, len(codes)
    while i < n:
        start, count = i, 0
        while i < n:
            lead = codes[i]
            need = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
            if not need or i + need >= n or any(not 0x80 <= c <= 0xBF for c in codes[i + 1 : i + need + 1]):
                break
            if lead == 0xE0 and codes[i + 1] < 0xA0 or lead == 0xED and codes[i + 1] > 0x9F or lead == 0xF0 and codes[i + 1] < 0x90 or lead == 0xF4 and codes[i + 1] > 0x8F:
                break
            i += need + 1
            count += 1
        if count:
            yield start, i, count
        else:
            i += 1


def plausible(c: str) -> bool:
    """Characters that European text is likely to hold."""
    o = ord(c)
    return 0xA0 <= o <= 0x17F or 0x386 <= o <= 0x3CE or 0x401 <= o <= 0x45F or o in (0x490, 0x491, 0x192, 0x2C6, 0x2DC) or 0x2010 <= o <= 0x203A or o in (0x20AC, 0x2116, 0x2122, 0x153, 0x160)


def repair_multibyte(text: str) -> str | None:
    """The text with the spans of the charset that explains most of it decoded; None if there are none."""
    best, gain = None, 0
    for charset in MULTIBYTE:
        codes = to_bytes(text, charset)
        spans = []
        for start, end, count in utf8_spans(codes):
            decoded, source = bytes(codes[start:end]).decode("utf-8"), text[start:end]
            if not all(plausible(c) or charset in ("cp1252", "latin-1") and 0x80 <= ord(c) <= 0x9F for c in decoded):
                continue
            # a single pair proves nothing by itself if its second half is a letter or a sign that ends words
            weak = count == 1 and end - start == 2 and charset not in ("cp1252", "latin-1", "mac_roman") and (source.isalpha() or source[-1] in EDGE)
            spans.append((start, end, decoded, weak))
        if all(weak for *_, weak in spans):
            continue
        out, at, saved = [], 0, 0
        for start, end, decoded, _ in spans:
            out += [text[at:start], decoded]
            at, saved = end, saved + end - start - len(decoded)
        if saved > gain:
            best, gain = "".join(out) + text[at:], saved
    return best


def well_formed(word: str) -> bool:
    """Whether a language may spell a word so: one script, one pattern of case, no sign inside, a vowel."""
    w = word.strip(EDGE)
    if not w or w.isascii():
        return True
    letters = [c for c in w if c.isalpha()]
    if not letters:
        return all(c in EDGE or c.isdigit() or c in "№§©®°€£" for c in w)
    runs = LETTERS.findall(w)
    if len("".join(runs)) < len(w.replace("-", "").replace("'", "").replace("’", "").replace(".", "").replace("&", "")) and not any(c.isdigit() for c in w):
        return False
    for r in runs:
        latin, cyrillic = bool(LATIN.search(r)), bool(CYRILLIC.search(r))
        if latin and cyrillic or not (latin or cyrillic):
            return False
        if cyrillic and not RUSSIAN.fullmatch(r):
            return False
        if not (r.islower() or r.isupper() or r[0].isupper() and (len(r) == 1 or r[1:].islower())):
            return False
        accented = sum(1 for c in r if ord(c) > 127) if latin else 0
        if latin and len(r) >= 2 and accented == len(r) or len(r) >= 4 and accented * 4 >= len(r) * 3:
            return False
        if len(r) >= 4 and not VOWELS & set(r.lower()):
            return False
    return True


def ill_words(text: str) -> int:
    return sum(not well_formed(w) for w in text.split(" "))


def redecode(word: str, shown: str, written: str) -> str | None:
    codes = to_bytes(word, shown)
    if min(codes, default=0) < 0:
        return None
    table = char_of(written)
    return "".join(table.get(c, "�") for c in codes)


def repair_single(text: str) -> str | None:
    """The text with ill-formed words decoded by the pair of charsets that makes most of them well-formed."""
    words = text.split(" ")
    bad = [i for i, w in enumerate(words) if not well_formed(w)]
    if not bad:
        return None
    best, score = None, 0
    for shown, written in SINGLE:
        mended = {}
        for i in bad:
            r = redecode(words[i], shown, written)
            if r and r != words[i] and well_formed(r) and sum(map(str.isalpha, r)) >= 2 and (written == "cp1252" or "mac_roman" in (shown, written) or CYRILLIC.search(r) or "cp850" in (shown, written)):
                # into a western charset only single letters change, so that the word must be Latin otherwise
                western = not CYRILLIC.search(r)
                if western and not any(c.isascii() and c.isalpha() for c in words[i]):
                    continue
                mended[i] = r
        # of several charsets that give well-formed words the one with the likelier letters is right
        weight = sum(len(r) + sum(c in COMMON for c in r.lower()) for r in mended.values())
        if weight > score:
            score = weight
            out = list(words)
            for i, w in enumerate(words):
                if i in mended:
                    out[i] = mended[i]
                elif CYRILLIC.search("".join(mended.values())) and not w.isascii() and len(mended) * 2 >= len([x for x in words if len(x) > 2]):
                    r = redecode(w, shown, written)  # short words of a text that is garbled as a whole
                    out[i] = r if r and well_formed(r) else w
            best = " ".join(out)
    return best


def repair(text: str | None) -> tuple[bool, str | None]:
    """(garbled, restored text). The restored text is None where nothing could be given back."""
    if not text or text.isascii() and "?" not in text:
        return False, None
    restored = text
    for _ in range(ROUNDS):
        r = repair_multibyte(restored)
        if r is None:
            break
        restored = r
    if restored == text or ill_words(restored):
        single = repair_single(text) or text
        if restored == text or ill_words(single) < ill_words(restored):
            restored = single
    if restored != text:
        return True, restored
    return bool(LOST.search(text)), None


def find_garbled(rows: DataFrame, fields: list[str], key: str) -> DataFrame:
    """rows to (key, field, value, garbled BOOLEAN, restored): one row per row and non-null field.

    Distinct values are repaired once per batch. NULLs give no row, empty texts are not garbled, repeated rows
    stay repeated, very long texts cost time in proportion to their length. Other columns are ignored.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = rows.select(F.col(key), F.explode(pairs).alias("p")).select(key, "p.field", "p.value").filter(F.col("value").isNotNull())

    @F.pandas_udf("struct<garbled:boolean,restored:string>")
    def run(values: pd.Series) -> pd.DataFrame:
        known = {v: repair(v) for v in values.unique()}
        out = [known[v] for v in values]
        return pd.DataFrame({"garbled": [o[0] for o in out], "restored": [o[1] for o in out]})

    return long.withColumn("r", run("value")).select(key, "field", "value", "r.garbled", "r.restored")
