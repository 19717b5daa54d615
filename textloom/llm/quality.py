"""Statistics of each text's quality, and what they tell apart: prose, lists, tables and junk.

Besides words, symbols, punctuation and common words, repetition is measured: shares of duplicate lines and paragraphs and the share of characters that
the most frequent sequences of two to four words cover. Combined rules tell the kinds apart; a kind needs evidence of its own
form (items, rows of like cells, no words), never only the absence of prose, and repetition alone is no evidence. Repetition speaks
against a kind: boilerplate whose lines, rows or items are mostly copies of one another is neither list nor table. Common words speak
for prose: pieces of which many are common are neither junk nor, without bullets, a list.

Defined cases: a null text has null statistics and no kind; an empty one has counts of zero and null ratios; a text under 40 characters has no kind; measurements
with a null value are ignored, exact copies count once; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Collection, Iterator
from functools import lru_cache
from statistics import median
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import FIELD, words
from ..session import spread
from .mojibake import REPLACEMENT, python_class, read_back

MIN_CHARS = 40
TOLERANCE = 0.01
#: Share of copies beyond which items or rows are boilerplate, and of common words beyond which pieces are read as words.
COPIED, READABLE = 0.5, 0.3
MEASURED = ("word_count", "mean_word_length", "symbol_ratio")
#: Marks that end a sentence, marks that begin an item.
ENDS = ".?!।॥。！？…"
CLOSERS = "\"'”’»)]」』"
BULLET = r"(?:[-*+•–—·▪◦‣●○■□►▸➢➤✓→]|\(?(?:\p{Nd}{1,3}|\p{L}\p{M}*|[ivxIVX]{1,4})[.)।:](?=\s)|[①-⑳])"
ITEM = regex.compile(rf"\s*{BULLET}\s+(?=\S)")
INLINE_ITEM = regex.compile(rf"(?:^|(?<=\s)){BULLET}\s+(?=\S)")
SYMBOL = regex.compile(r"[\p{P}\p{S}]")
LETTER = regex.compile(r"[\p{L}\p{M}]")
NOT_SPACE = regex.compile(r"\S")
LATIN, VOWEL = regex.compile("[A-Za-z]"), regex.compile("[aeiouyAEIOUY]")
LONG_RUN = regex.compile(r"(\S)\1{4,}")
TAG = regex.compile(r"</?[a-zA-Z][^<>]*>|&[a-zA-Z]+;|&#\d+;")
HIGH = regex.compile(r"[A-Za-z\x80-\U0010ffff]+")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
GARBLE = python_class("+")
END = regex.compile(rf"[{ENDS}][{regex.escape(CLOSERS)}]*(?=\s|$)")
ITEM_ENDS, ROW_ENDS = regex.compile(r"[\n;；,、，/|•·・]"), regex.compile(r"\n|\|\||;|\s//?\s")
DELIMITERS = ("|\t", ";", ",", "  ")


class Letters:
    """All characters that texts are written in."""

    def __contains__(self, char: str) -> bool:
        return unicodedata.category(char)[0] in "LMNPS"


def is_garbled(text: str) -> bool:
    """Whether wrongly decoded characters make up a good part of a text."""
    if text.isascii():
        return False
    if REPLACEMENT in text:
        return True
    runs = [run for run in HIGH.findall(text) if not run.isascii()]
    return sum(1 for run in runs if GARBLE.fullmatch(run) and read_back(run, Letters())) * 2 > len(runs)


def ends_sentence(piece: str) -> bool:
    stripped = piece.rstrip(CLOSERS)
    return bool(stripped) and stripped[-1] in ENDS


def _cells(row: str, delimiter: str) -> list[str]:
    if delimiter == "|\t":
        parts = regex.split(r"[|\t]", row.strip(" \n").strip("|"))
    else:
        parts = regex.split(r" {2,}|\t", row.strip()) if delimiter == "  " else row.strip("\n").split(delimiter)
    return [part.strip() for part in parts]


def _is_cell(cell: str) -> bool:
    return len(cell.split()) <= 3 and not (len(cell.split()) > 1 and ends_sentence(cell)) and len(cell) <= 40


def has_rows(rows: list[str]) -> bool:
    """Whether most rows fall into the same number of short cells, two at least."""
    rows = [row for row in rows if regex.search(r"[^\s|:+=-]", row)]
    if len(rows) < 3:
        return False
    for delimiter in DELIMITERS:
        cut = [_cells(row, delimiter) for row in rows]
        width, often = Counter(map(len, cut)).most_common(1)[0]
        if width >= 2 and often >= 0.7 * len(rows):
            cells = [cell for row in cut if len(row) == width for cell in row]
            if sum(map(_is_cell, cells)) >= 0.85 * len(cells):
                return True
    return False


def is_table(text: str) -> bool:
    """Rows of like cells, over lines or in one."""
    lines = [line for line in text.split("\n") if line.strip()]
    if has_rows(lines):
        return True
    if len(lines) > 3 and has_rows(lines[1:]):
        return True
    for row_end in (r"\s*\|\|\s*", r"\s+;\s+", r"\s+//?\s+", r"\s*;\s*"):
        parts = [part for part in regex.split(row_end, text) if part.strip()]
        if len(parts) >= 3 and any(x in text for x in ("|", "\t", ",", "  ")) and has_rows(parts):
            return True
    return False


def _is_item(item: str) -> bool:
    pieces = item.split()
    return 0 < len(pieces) <= 12 and not (len(pieces) >= 4 and ends_sentence(pieces[-1]))


def is_list(text: str) -> bool:
    """Mostly items of an enumeration, over lines or in one."""
    lines = [line for line in text.split("\n") if line.strip()]
    if len(lines) >= 3:
        items = [line for line in lines if ITEM.match(line) and _is_item(ITEM.sub("", line, 1))]
        size = sum(map(len, lines))
        if len(items) >= 3 and (len(items) >= 0.6 * len(lines) or sum(map(len, items)) >= 0.6 * size):
            return True
        short = [line for line in lines if len(line.split()) <= 6 and not ends_sentence(line.rstrip(" ;,"))]
        if len(lines) >= 5 and len(short) >= 0.8 * len(lines) and sum(len(LETTER.findall(x)) for x in short) > 0.5 * sum(len(NOT_SPACE.findall(x)) for x in short):
            return True
    marks = list(INLINE_ITEM.finditer(text))
    if len(marks) >= 3:
        items = [text[m.end() : n.start()] for m, n in zip(marks, [*marks[1:], None]) if n is not None] + [text[marks[-1].end() :]]
        good = [item for item in items if _is_item(item.strip(" ;,"))]
        if len(good) >= 0.7 * len(items) and sum(map(len, good)) >= 0.5 * len(text):
            return True
    for mark, least, most in ((";", 4, 6), ("；", 4, 6), (",", 6, 4), ("、", 6, 4), ("，", 6, 4), ("/", 6, 4), ("|", 5, 4), ("•", 4, 6), ("·", 4, 6), ("・", 4, 6)):
        if text.count(mark) >= least - 1:
            body = regex.sub(r"^[^:：\n]{1,80}[:：]", "", text, count=1) if regex.match(r"[^:：\n;,]{1,80}[:：]", text) else text
            items = [item.strip() for item in body.split(mark) if item.strip()]
            short = [item for item in items if len(item.split()) <= most and not (len(item.split()) >= 2 and ends_sentence(item)) and (mark not in "、，・" or len(item) <= 12)]
            if len(items) >= least and len(short) >= 0.85 * len(items) and sum(map(len, short)) >= 0.6 * len(text):
                return True
    return False


def sentences(text: str) -> int:
    """Readable sentences: at least three words (or ten letters of a script without spaces) up to a mark that ends one."""
    found, count = 0, 0
    for piece in text.split():
        bare = piece.strip(CLOSERS + ENDS + ",;:“‘«([")
        letters = len(LETTER.findall(bare))
        if letters and letters >= 0.7 * len(bare):
            count += 1 if len(bare) <= 30 and not CJK.search(bare) else letters / 4 if CJK.search(bare) else 0
        if ends_sentence(piece):
            found += count >= 2.5
            count = 0
    return found


def is_noise(text: str) -> bool:
    """Markup, runs of one character, endless tokens or letters of all scripts mixed: junk whatever its layout."""
    if "<" in text or "&" in text:
        bare = TAG.sub("", text)
        if len(bare) < 0.5 * len(text) and sentences(bare) == 0:
            return True
    pieces = text.split()
    solid = sum(map(len, pieces))
    if sum(len(m[0]) for m in LONG_RUN.finditer(text)) > 0.4 * solid:
        return True
    if sum(len(p) for p in pieces if len(p) > 40 and not CJK.search(p) and "://" not in p) > 0.6 * solid:
        return True
    return len({script(c) for c in set(text)} - {""}) > 2 and sum(map(is_mixed, pieces)) > 0.4 * len(pieces)


def is_junk(text: str) -> bool:
    """No readable sentences: hardly any letters, or pieces that are no words."""
    if len(LETTER.findall(text)) < 0.5 * len(NOT_SPACE.findall(text)):
        return sentences(text) == 0
    pieces = text.split()
    return sum(map(is_strange, pieces)) > 0.5 * len(pieces) and sentences(text) == 0


@lru_cache(maxsize=20_000)
def script(char: str) -> str:
    """The script of a letter, one for all that Japanese is written in; empty for other characters."""
    if not char.isalpha():
        return ""
    return "CJK" if CJK.match(char) else unicodedata.name(char, "?").split()[0]


def is_mixed(piece: str) -> bool:
    """A piece whose letters belong to several scripts, other than those that Japanese is written in."""
    return len({script(c) for c in piece} - {""}) > 1


def is_plain(text: str) -> bool:
    """Prose beyond doubt: mostly letters, sentence after sentence, and no layout of items or cells."""
    pieces = text.count(" ") + text.count("\n") + 1
    ends = len(END.findall(text))
    if ends * 25 < pieces or not ends:
        return False
    if text.count(";") + text.count("|") + text.count("\t") + text.count("•") + text.count("/") > 2 or text.count(",") * 4 > pieces:
        return False
    if text.count("\n") >= 2:
        lines = [line for line in text.split("\n") if line.strip()]
        if 2 * sum(1 for line in lines if END.search(line, max(0, len(line) - 4))) < len(lines) or sum(1 for line in lines if ITEM.match(line)) > 2:
            return False
    if len(LETTER.findall(text)) < 0.75 * len(NOT_SPACE.findall(text)):
        return False
    latin = len(LATIN.findall(text))
    return (2 * latin < len(text) or len(VOWEL.findall(text)) > 0.2 * latin) and (ends > 2 or sentences(text) > 0)


def is_strange(piece: str) -> bool:
    """A piece that is no word: case or kinds of characters change within, or Latin without a vowel."""
    bare = piece.strip(CLOSERS + ENDS + ",;:“‘«([-")
    if not bare or CJK.search(bare):
        return not bare
    if regex.search(r"\p{L}\p{M}*[\p{Nd}\p{S}_#@%&*+=/\\^~<>{}\[\]|]+|[\p{Nd}\p{S}]\p{L}|\p{Ll}\p{Lu}", bare):
        return True
    if regex.fullmatch(r"[A-Za-z]+", bare):
        return len(bare) > 3 and not regex.search(r"(?i)[aeiouy]", bare) or bool(regex.search(r"(?i)[bcdfghjklmnpqrstvwxz]{5}", bare))
    return not LETTER.search(bare)


class Shares(NamedTuple):
    """What of a text is common words or repeated."""

    common_words: float | None
    duplicate_lines: float
    duplicate_paragraphs: float
    dominant_ngram: float


def shares(text: str, found: list[str], lines: list[str], common: Collection[str]) -> Shares:
    """The shares of a text with the words ``found`` and these lines."""
    return Shares(
        sum(w in common for w in found) / len(found) if found else None,
        repeated_share(lines),
        repeated_share([p.strip() for p in regex.split(r"\n\s*\n", text) if p.strip()]),
        dominant_share(found),
    )


def lines_of(text: str) -> list[str]:
    return [line.strip() for line in text.split("\n") if line.strip()]


def is_copied(text: str, of: Shares, ends: regex.Pattern) -> bool:
    """Whether words in copies make up most of a text: of its lines, its paragraphs or the parts up to ``ends``, without their bullets."""
    if len(LETTER.findall(text)) < 0.5 * len(NOT_SPACE.findall(text)):
        return False
    if max(of.duplicate_lines, of.duplicate_paragraphs) > COPIED:
        return True
    parts = [part.strip() for piece in ends.split(text) for part in INLINE_ITEM.split(piece)]
    return repeated_share([part for part in parts if part]) > COPIED


def kind_of(text: str | None, of: Shares | None = None) -> str | None:
    """``list``, ``table``, ``junk`` or None; ``of`` are the shares of the text, if known."""
    if text is None or len(text) < MIN_CHARS or is_plain(text) or is_garbled(text):
        return None
    if is_noise(text):
        return "junk"
    parts = [p for p in (text.split("|") if "|" in text else text.split("\n")) if p.strip()]
    if len(parts) >= 3 and all(FIELD.match(p) for p in parts) and sentences(text) >= 0.5 * len(parts):
        return None
    pieces = text.split()
    enough = sentences(text) >= 3 and sum(map(ends_sentence, pieces)) * 25 >= len(pieces)
    of = of or shares(text, words(text), lines_of(text), ())
    if is_list(text) and not (enough and not any(ITEM.match(x) for x in text.split("\n"))):
        if is_table_like(text) and not is_copied(text, of, ROW_ENDS):
            return "table"
        prose = (of.common_words or 0) > READABLE and not INLINE_ITEM.search(text)
        if not prose and of.dominant_ngram <= COPIED and not is_copied(text, of, ITEM_ENDS):
            return "list"
    elif is_table(text) and not enough and not is_copied(text, of, ROW_ENDS):
        return "table"
    return "junk" if is_junk(text) and (of.common_words or 0) <= READABLE else None


def is_table_like(text: str) -> bool:
    """A text that also passes as a list is a table if its lines fall into like cells and don't begin as items."""
    lines = [line for line in text.split("\n") if line.strip()]
    return sum(bool(ITEM.match(x)) for x in lines) < 0.5 * len(lines) and not INLINE_ITEM.match(text) and is_table(text)


def measured(text: str) -> tuple[int, float | None, float | None]:
    """(pieces, mean code points of a piece, share of P and S among characters that aren't whitespace)."""
    pieces = text.split()
    solid = sum(map(len, pieces))
    return len(pieces), solid / len(pieces) if pieces else None, len(SYMBOL.findall(text)) / solid if solid else None


def dominant_share(found: list[str], sizes: tuple[int, ...] = (2, 3, 4)) -> float:
    """The largest share of characters that the most frequent sequence of words of some size covers, if it comes twice."""
    total = sum(map(len, found))
    best = 0.0
    for size in sizes:
        grams = Counter(zip(*(found[k:] for k in range(size))))
        if grams:
            gram, often = grams.most_common(1)[0]
            if often > 1:
                best = max(best, min(1.0, often * sum(map(len, gram)) / total))
    return best


def repeated_share(parts: list[str]) -> float:
    """The share of characters in parts that came before."""
    seen: set[str] = set()
    again = 0
    for part in parts:
        again += len(part) if part in seen else 0
        seen.add(part)
    total = sum(map(len, parts))
    return again / total if total else 0.0


STATISTICS = pa.schema(
    [("id", pa.int64()), ("word_count", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64())]
    + [(name, pa.float64()) for name in ("punctuated_lines", "common_words", "duplicate_lines", "duplicate_paragraphs", "dominant_ngram", "median_line")]
    + [("kind", pa.string())]
)
SCHEMA = "id long, word_count long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, duplicate_lines double, duplicate_paragraphs double, dominant_ngram double, median_line double, kind string"


def _statistics(common: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    rows.append((at, *[None] * 10))
                else:
                    lines = lines_of(text)
                    of = shares(text, words(text), lines, common)
                    punctuated = sum(map(ends_sentence, lines)) / len(lines) if lines else None
                    rows.append((at, *measured(text), punctuated, *of, float(median(map(len, lines))) if lines else None, kind_of(text, of)))
            columns = list(zip(*rows)) or [[]] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, STATISTICS)], schema=STATISTICS)

    return run


def statistics(df: DataFrame, common_words: DataFrame, id_col: str = "record", text_col: str = "text") -> DataFrame:
    """One row of statistics for each text.

    ``common_words`` must be a word list of fixed size: it is sent with the function; more than 100,000 words are refused.
    """
    common = {row.word.lower() for row in common_words.select("word").where("word is not null").distinct().limit(100_001).collect()}
    if len(common) > 100_000:
        raise ValueError("common_words must hold at most 100,000 words")
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_statistics(common), SCHEMA)


def kinds(df: DataFrame, common_words: DataFrame, findings: DataFrame, id_col: str = "record", text_col: str = "text") -> DataFrame:
    """(record, kind): the texts that aren't prose, and as ``wrong_value`` those that an earlier measurement doesn't fit.

    Findings are reduced to the extremes of each record and code before they are joined: a value is off if one of the two is.
    """
    stats = statistics(df, common_words, id_col, text_col)
    extremes = findings.where(F.col("code").isin(*MEASURED) & F.col("value").isNotNull()).groupBy("record", "code").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    wide = extremes.groupBy("record").pivot("code", list(MEASURED)).agg(F.struct(F.min("low").alias("low"), F.max("high").alias("high")))
    joined = stats.join(wide.select(F.col("record").alias("id"), *(F.col(code).alias(f"{code}_found") for code in MEASURED)), "id", "left")
    off = F.lit(False)
    for code in MEASURED:
        for end in ("low", "high"):
            off = off | F.coalesce(F.abs(F.col(f"{code}_found.{end}") - F.coalesce(F.col(code), F.lit(0.0))) > TOLERANCE, F.lit(False))
    found = F.array_compact(F.array(F.col("kind"), F.when(off & F.col("word_count").isNotNull(), F.lit("wrong_value"))))
    return joined.select(F.col("id").alias(id_col), F.explode(found).alias("kind"))
