"""Texts that look the same but are made of other characters, brought to one consistent form.

Wide and narrow forms get their plain width, split characters are composed, invisible characters go, and each kind of single space
becomes a space. In each token the scripts that can spell every letter are intersected: a letter stands for its own script and for
those in which a look-alike exists. A token that only one script can spell in whole is written in it, be it mixed or not. One that several
can spell takes, of these, that of the nearest token with one script, so a word of Russian stays one among Russian words; without such a token the first of
``SCRIPTS``. Where no script spells all letters, each takes the first look that it has. Of kana and Han characters that look alike, the script of the
characters beside them decides. As every choice depends on looks alone, texts that look the same get the same form.

Defined cases: null texts have a null form; texts whose form is blank are in no pair; equal texts are no pair; extra columns are
ignored. Case, accents, digits, raised digits and the number of spaces are kept.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, written
from .pairs import expand

#: Look-alike letters of other scripts, by the Latin letter that they look like.
LOOK_ALIKES = {
    "CYRILLIC": "а a е e о o р p с c у y х x і i ј j ѕ s һ h ԁ d ԛ q ԝ w ӏ l ү y А A В B Е E К K М M Н H О O Р P С C Т T У Y Х X І I Ј J Ѕ S Ԁ D Ԛ Q Ԝ W Ү Y Һ H Ӏ I",
    "GREEK": "ο o ν v α a ι i ρ p υ u τ t κ k γ y χ x ϲ c ϳ j Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X Ϲ C Ϳ J",
    "ARMENIAN": "օ o ս u հ h ո n ց g զ q ա w յ j Օ O Ս U Լ L",
    "COPTIC": "ⲟ o ⲥ c ⲣ p Ⲃ B Ⲉ E Ⲏ H Ⲓ I Ⲕ K Ⲙ M Ⲛ N Ⲟ O Ⲣ P Ⲥ C Ⲧ T Ⲭ X",
    "CHEROKEE": "Ꭺ A Ᏼ B Ꮯ C Ꭰ D Ꭼ E Ꮐ G Ꮋ H Ꭻ J Ꮶ K Ꮮ L Ꮇ M Ꮲ P Ꭱ R Ꮪ S Ꭲ T Ꮩ V Ꮃ W Ꮓ Z",
    "LISU": "ꓮ A ꓐ B ꓚ C ꓓ D ꓰ E ꓝ F ꓖ G ꓧ H ꓲ I ꓙ J ꓗ K ꓡ L ꓟ M ꓠ N ꓳ O ꓑ P ꓣ R ꓢ S ꓔ T ꓴ U ꓦ V ꓪ W ꓫ X ꓬ Y ꓜ Z",
}
SCRIPTS = ("LATIN", *LOOK_ALIKES)
#: Katakana and the hiragana or Han characters that they look like.
KANA_LIKE = dict(zip("ヘベペニロカエトタハ", "へべぺ二口力工卜夕八"))
KANA_BACK = {other: kana for kana, other in KANA_LIKE.items()}
KANA_TEXT, KANA_ANY = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}ー々]+"), regex.compile("[" + "".join([*KANA_LIKE, *KANA_BACK]) + "]")
WIDTH = regex.compile(r"[！-￮]+[゙゚ﾞﾟ]*")
SPACES = regex.compile(r"[\p{Zs}]")
INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠㅤ឴឵]")
ZERO_WIDTH_JOINERS = "‌‍"
TOKEN = regex.compile(r"[\p{L}\p{M}]+")

#: By script, each Latin letter's look in it, and back.
LOOKS = {script: dict(zip(line.split()[1::2], line.split()[::2])) for script, line in LOOK_ALIKES.items()}
TO_LATIN = {look: latin for table in LOOKS.values() for latin, look in table.items()} | {a: b for line in LOOK_ALIKES.values() for a, b in zip(line.split()[::2], line.split()[1::2])}
ALIEN = regex.compile("[Ͱ-ϿЀ-ԯԱ-֏" + "".join(TO_LATIN) + "]")


@lru_cache(maxsize=50_000)
def script_of(letter: str) -> str:
    """The script in a letter's name; marks have none."""
    return "" if unicodedata.category(letter)[0] == "M" else unicodedata.name(letter, "?").split()[0]


@lru_cache(maxsize=50_000)
def spellings(letter: str) -> dict[str, str]:
    """The scripts that can spell a letter, with its look in each: the resolved script set."""
    own = script_of(letter)
    latin = letter if own == "LATIN" else TO_LATIN.get(letter)
    found = {script: latin if script == "LATIN" else LOOKS[script][latin] for script in SCRIPTS if latin and (script == "LATIN" or latin in LOOKS[script])}
    return found or {own: letter}


@lru_cache(maxsize=100_000)
def scripts_of(token: str) -> frozenset[str]:
    """The scripts that can spell every letter of a token."""
    sets = [set(spellings(letter)) for letter in unicodedata.normalize("NFD", token) if script_of(letter)]
    return frozenset(set(sets[0]).intersection(*sets[1:])) if sets else frozenset()


def spelled(token: str, script: str | None) -> str:
    """A token in one script; without one, each letter in the first of its own."""
    letters = unicodedata.normalize("NFD", token)
    return unicodedata.normalize("NFC", "".join(x if not script_of(x) else spellings(x)[script] if script else next(iter(spellings(x).values())) for x in letters))


def respelled(text: str) -> str:
    """The text with each token in one script, by the token or its neighbours."""
    tokens = list(TOKEN.finditer(text))
    sets = [scripts_of(m[0]) for m in tokens]
    sure: dict[str, list[int]] = {}
    for at, found in enumerate(sets):
        if len(found) == 1:
            sure.setdefault(next(iter(found)), []).append(at)
    out, end = [], 0
    for at, (m, found) in enumerate(zip(tokens, sets)):
        out.append(text[end : m.start()])
        end = m.end()
        if len(found) == 1:
            out.append(spelled(m[0], next(iter(found))))
            continue
        best: tuple[int, int, int, str] | None = None
        for script in found:
            places = sure.get(script, [])
            k = bisect_left(places, at)
            near = [(abs(p - at), int(p > at), SCRIPTS.index(script), script) for p in places[max(0, k - 1) : k + 1]]
            best = min([*near, *([best] if best else [])], default=None)
        out.append(spelled(m[0], best[3] if best else next((s for s in SCRIPTS if s in found), None)))
    return "".join([*out, text[end:]])


def kana_spelled(match: regex.Match) -> str:
    """A run of Japanese in which each look-alike is of the script of the nearest character that has one look, the one before first."""
    chars = list(match[0])
    kind = ["" if KANA_ANY.match(c) else "kana" if regex.match(r"[\p{Katakana}ー]", c) else "other" for c in chars]
    after, left = [""] * len(chars), ""
    for at in range(len(chars) - 1, -1, -1):
        left = after[at] = kind[at] or left
    before = ""
    for at, c in enumerate(chars):
        before = kind[at] or before
        if not kind[at]:
            chars[at] = KANA_BACK.get(c, c) if (before or after[at]) == "kana" else KANA_LIKE.get(c, c)
    return "".join(chars)


def _seen(match: regex.Match) -> str:
    """A joiner stays where it changes what is seen: within emoji and after a virama."""
    if match[0] in ZERO_WIDTH_JOINERS and match.start():
        before = match.string[match.start() - 1]
        if unicodedata.category(before) in ("So", "Sk") or before == "️" or unicodedata.combining(before) == 9:
            return match[0]
    return ""


def consistent(text: str) -> str:
    """The one form of all texts that look like this one."""
    if text.isascii():
        return text
    text = WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = INVISIBLE.sub(_seen, SPACES.sub(" ", text))
    text = unicodedata.normalize("NFC", text)
    if ALIEN.search(text):
        text = respelled(text)
    return KANA_TEXT.sub(kana_spelled, text) if KANA_ANY.search(text) else text


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [None if text is None else consistent(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "form"])


def forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form): each text in its consistent form."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_forms, "id long, form string").select(F.col("id").alias(id_col), "form")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and not text.isspace():
                form = consistent(text)
                if form and not form.isspace():
                    rows.append((at, xxhash.xxh3_128_digest(form.encode()), xxhash.xxh3_128_digest(text.encode())))
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["id", "form", "class"])


def same_looks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b): pairs of rows whose texts differ but have one form.

    Texts are reduced to classes of equal texts first; only forms that several classes share are joined, class to class, and the
    members follow. Equal copies, however many, never meet.
    """
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    keys = written(rows.mapInArrow(_keys, "id long, form binary, class binary"))
    classes = keys.groupBy("form", "class").agg(F.count("*").alias("n"))
    several = classes.groupBy("form").agg(F.count("*").alias("classes")).where("classes > 1").select("form")
    variants = written(classes.join(several, "form", "left_semi").select("form", "class"))
    pairs = variants.select("form", F.col("class").alias("a")).join(variants.select("form", F.col("class").alias("b")), "form").where("a < b").select("a", "b")
    members = keys.join(variants.select("class"), "class", "left_semi").select("id", "class")
    return expand(pairs, members).select(F.col("low").alias("doc_a"), F.col("high").alias("doc_b"))
