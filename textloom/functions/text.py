"""Text functions as columns. What Java's regular expressions can say stays in the JVM. Normal form and full case folding go through
one Arrow function, for rows with characters outside ASCII only; repetition and script counts through another, which also
keeps the optimizer from computing them once for each of their many uses."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..profiles import BOILERPLATE, OTHER, SCRIPT_RANGES, Profile

#: The white space of the rules, and the patterns of addresses and links; W is a word character.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"[\p{L}\p{N}_]"
EMAIL = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?!{W})"
URL = rf"(?iu)(?:https?://|www\.|(?<!{W}){W}+\.(?:com|org|net|info|biz)(?!{W}))"
URL_PART = r"(?iu)://|www\.|\.(?:com|org|net|info|biz)"
MOJIBAKE = "�|Ã.|Â.|â€|ðŸ"
SYMBOLS = r"[\p{P}\p{S}]"
TOKENS = r"[\p{L}\p{M}\p{N}]+"

FORMS = T.StructType([T.StructField("norm", T.StringType()), T.StructField("folded", T.StringType())])
COUNTS = ("words", "distinct_words", "longest_run", "trigrams", "distinct_trigrams")
MEASURES = T.StructType([T.StructField(name, T.IntegerType()) for name in COUNTS] + [T.StructField("scripts", T.MapType(T.StringType(), T.LongType()))])
NAMES = (*SCRIPT_RANGES, OTHER)


def _forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        norm = [None if t is None else " ".join(unicodedata.normalize("NFC", t).split()) for t in texts]
        yield pd.DataFrame({"norm": norm, "folded": [None if t is None else t.casefold() for t in norm]})


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """For each code point the place of its script in ``NAMES``, or one more for what is no letter or mark."""
    table = np.full(sys.maxunicode + 1, len(NAMES), np.uint8)
    letters = np.fromiter((unicodedata.category(chr(code))[0] in "LM" for code in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    table[letters] = len(NAMES) - 1
    for at, name in enumerate(SCRIPT_RANGES):
        for low, high in SCRIPT_RANGES[name]:
            table[low : high + 1][letters[low : high + 1]] = at
    return table


def count_scripts(text: str) -> dict[str, int]:
    """The number of letters and marks of each script that occurs."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(script_table()[codes], minlength=len(NAMES) + 1)[: len(NAMES)]
    return {NAMES[k]: int(counts[k]) for k in counts.nonzero()[0]}


def repetition(folded: str) -> tuple[int, int, int, int, int]:
    """The counts of ``COUNTS`` for a folded text with single spaces."""
    words = folded.split(" ") if folded else []
    run = best = min(1, len(words))
    for one, two in zip(words, words[1:]):
        run = run + 1 if one == two else 1
        best = max(best, run)
    return len(words), len(set(words)), best, max(0, len(words) - 2), len(set(zip(words, words[1:], words[2:])))


def _measures(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for norms, foldeds in batches:
        rows = [(*repetition(folded or ""), count_scripts(norm or "")) for norm, folded in zip(norms, foldeds)]
        yield pd.DataFrame(rows, columns=[f.name for f in MEASURES.fields])


# The functions take iterators of batches: their annotations tell Spark so.
forms_udf = F.pandas_udf(_forms, FORMS)
measures_udf = F.pandas_udf(_measures, MEASURES)


def forms(text: Column) -> Column:
    """(norm, folded): composed text with single spaces, and its full case folding; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.trim(F.regexp_replace(text, SPACE + "+", " "))
    wide = text.rlike(r"[^\x00-\x7f]")
    made = forms_udf(F.when(wide, text))
    return F.when(wide, made).otherwise(F.struct(plain.alias("norm"), F.lower(plain).alias("folded")))


def share(counts: Column, names: tuple[str, ...]) -> Column:
    """The share of letters and marks in the named scripts; 0 without letters."""
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, b: a + b)
    part = sum((F.coalesce(F.try_element_at(counts, F.lit(name)), F.lit(0)) for name in names), F.lit(0).cast("long"))
    return F.when(total == 0, 0.0).otherwise(part / F.nullif(total, F.lit(0)))


def symbol_ratio(text: Column) -> Column:
    """Punctuation and symbols among the characters of a normalized text that aren't spaces; 0 for an empty one."""
    solid = F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(solid == 0, 0.0).otherwise(F.regexp_count(text, F.lit(SYMBOLS)) / F.nullif(solid, F.lit(0)))


def longest_character_run(text: Column, least: int) -> Column:
    """The length of the longest run of one character, of those of at least ``least``; 0 if there is none."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?s)((.)\2{{{max(least - 1, 1)},}})"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def marker_count(folded: Column, profile: Profile) -> Column:
    """How many of the boilerplate markers occur."""
    return sum((F.contains(folded, F.lit(marker)).cast("int") for marker in BOILERPLATE + profile.markers), F.lit(0))


def urls(text: Column) -> Column:
    """The matched beginnings of links; a text without the parts that every link has is not searched for them."""
    found = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    return F.when(text.rlike(URL_PART), found).otherwise(F.array().cast("array<string>"))


def has_email(text: Column) -> Column:
    return F.contains(text, F.lit("@")) & text.rlike(EMAIL)


def url_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(urls(text), F.lit(0), lambda a, u: a + F.length(u)) / F.nullif(F.length(text), F.lit(0)))


def mask(text: Column, profile: Profile) -> Column:
    """(masked, emails, phones): e-mail addresses first, then phone numbers by each pattern in turn."""
    sign = F.contains(text, F.lit("@"))
    emails = F.when(sign, F.regexp_count(text, F.lit(EMAIL))).otherwise(0)
    masked, phones = F.when(sign, F.regexp_replace(text, EMAIL, "<EMAIL>")).otherwise(text), F.lit(0)
    for pattern in profile.phones:
        phones = phones + F.regexp_count(masked, F.lit(pattern))
        masked = F.regexp_replace(masked, pattern, "<PHONE>")
    return F.struct(masked.alias("masked"), emails.alias("emails"), phones.alias("phones"))


def ratio_bucket(ratio: Column) -> Column:
    """The label of a ratio's tenth, as ``20-30%``; 1 belongs to the last."""
    upper = F.least(F.lit(100), (F.floor(ratio * 10) + 1) * 10).cast("int")
    return F.format_string("%02d-%02d%%", upper - 10, upper)
