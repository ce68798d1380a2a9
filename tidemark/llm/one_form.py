"""Problem 10: texts that look the same in one form.

Compatibility normalisation (composed), look-alike letters to the script of their word's text, mapped white
space, no default-ignorable characters, full case folding. Every distinct value of a batch is worked on once,
and texts without a suspicious character (one regular expression) skip everything but case folding.
"""

from __future__ import annotations

import re
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look alike, as pairs of (other script, Latin).
CYRILLIC_LATIN = dict(zip("аеорсухіѕјһԁԛԝАВЕКМНОРСТУХІЅЈԌԚԜ", "aeopcyxisjhdqwABEKMHOPCTYXISJGQW"))
GREEK_LATIN = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX"))
#: Only letters of the Russian alphabet may be meant by a Latin letter in a Cyrillic word.
LATIN_CYRILLIC = dict(zip("aeopcyxABEKMHOPCTYX", "аеорсухАВЕКМНОРСТУХ"))
GREEK_CYRILLIC = dict(zip("οΑΒΕΗΚΜΟΡΤΥΧ", "оАВЕНКМОРТУХ"))

IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
SPACES = "\t   -   　"
BREAKS = re.compile(r"\r\n|[\r\x0b\x0c\x85  ]")
HIDDEN = re.compile(f"[{IGNORABLE}]")
SPACE = re.compile(f"[{SPACES}]")
LATIN, CYRILLIC, GREEK = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ", "Ѐ-ԯ", "Ͱ-Ͽἀ-῿"
COUNT = {"latin": re.compile(f"[{LATIN}]"), "cyrillic": re.compile(f"[{CYRILLIC}]"), "greek": re.compile(f"[{GREEK}]")}
WORD = re.compile(r"[^\W\d_]+")
WHOLE_WORD = 3  # letters from which a word written in look-alikes alone counts


def main_script(text: str) -> str:
    """The script most of the letters are in; Latin where there are none."""
    if text.isascii():
        return "latin"
    counts = {name: len(p.findall(text)) for name, p in COUNT.items()}
    return max(counts, key=lambda n: (counts[n], n == "latin"))


def _tables(main: str) -> dict[str, str]:
    if main == "latin":
        return CYRILLIC_LATIN | GREEK_LATIN
    return LATIN_CYRILLIC | GREEK_CYRILLIC if main == "cyrillic" else {}


def unmasked(word: str, main: str) -> str:
    """A word with the look-alikes of other scripts replaced by letters of the main script.

    Mixed words change where a look-alike exists; words wholly in another script change if they have at least
    three letters and all of them look like letters of the main script.
    """
    table, own = _tables(main), COUNT[main]
    base = normalize("NFD", word)
    foreign = [c for c in base if c.isalpha() and not own.match(c)]
    if not foreign:
        return word
    if len(foreign) == sum(map(str.isalpha, base)) and (len(foreign) < WHOLE_WORD or not all(c in table for c in foreign)):
        return word
    return normalize("NFC", "".join(table.get(c, c) if not own.match(c) else c for c in base))


def mixes(text: str, main: str) -> bool:
    """Whether letters of more than one script occur at all."""
    return any(p.search(text) for name, p in COUNT.items() if name != main)


def visible(text: str) -> tuple[str, bool]:
    """(text in one visible form with its case, whether anything but line breaks changed)."""
    if text.isascii():
        out = text.replace("\t", " ") if "\t" in text else text
        return BREAKS.sub("\n", out), out != text
    out = SPACE.sub(" ", HIDDEN.sub("", text))
    out = normalize("NFKC", out)
    # compatibility forms may unfold into spaces or ignorable characters of their own
    out = SPACE.sub(" ", HIDDEN.sub("", out))
    main = main_script(out)
    if mixes(out, main):
        out = WORD.sub(lambda m: unmasked(m[0], main), out)
    changed = out != text
    return BREAKS.sub("\n", out), changed


def one_form(text: str) -> str:
    """The form in which equal-looking texts are equal."""
    return normalize("NFKC", visible(text)[0].casefold())


def with_one_form(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts plus one_form STRING and changed BOOLEAN (characters of problem 10, not case or line breaks).

    NULL texts have a NULL form and are not changed; empty texts are their own form.
    """

    @F.pandas_udf("struct<one_form:string,changed:boolean>")
    def run(values: pd.Series) -> pd.DataFrame:
        known = {v: visible(v) for v in values.dropna().unique()}
        out = [known.get(v, (None, False)) for v in values]
        return pd.DataFrame({"one_form": [None if o[0] is None else normalize("NFKC", o[0].casefold()) for o in out], "changed": [o[1] for o in out]})

    return texts.withColumn("__r", run(F.col(column))).withColumns({"one_form": F.col("__r.one_form"), "changed": F.col("__r.changed")}).drop("__r")


def is_changed(column: Column) -> Column:
    """Whether a text holds characters that problem 10 is about."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        known = {v: visible(v)[1] for v in values.dropna().unique()}
        return pd.Series([known.get(v, False) for v in values])

    return run(column)
