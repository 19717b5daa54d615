"""Text that was decoded with the wrong encoding: the affected records, and the original text where it can be had.

Documents are cut into runs of ASCII letters and characters outside ASCII, and runs that mix characters a garbled run can be made of
with others are cut once more where the two meet, as text without spaces may be garbled in part. Every legacy encoding maps bytes from 0x80 to
characters outside ASCII and leaves the rest alone, so garbling a run gives a run. Three steps, each over what the corpus holds:

* The garbled forms of every distinct clean run are generated under all chains (UTF-8 read in legacy encodings, once to three times, and legacy
  bytes read in another one) and hash-joined with the runs of the documents. A bitmap over the hashes of suspicious runs, sized by
  their number up to ``MOST_BITS``, drops forms that occur nowhere before they are shuffled. Forms of legacy bytes count only if no word looks like them.
* Runs that no form explains, as their words occur nowhere clean, are explained from the garbled forms of every distinct clean character: byte sequences are
  read back, and count only if they give characters that clean runs of the corpus hold. ``by`` tells which of the two found a run.
* Replacement characters always count.

Defined cases: null and empty texts are never affected; a text keeps what can't be restored; repeated rows each count; extra columns
are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, written

#: Encodings in which UTF-8 bytes were read, one after the other; undefined bytes become the control character of their number.
CODECS = ("latin-1", "cp1252", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "cp866", "koi8-r")
CHAINS = (
    *((codec,) for codec in CODECS),
    *((one, two) for one in ("latin-1", "cp1252") for two in ("latin-1", "cp1252")),
    *((codec, codec) for codec in ("cp1251", "cp1250", "mac_roman", "cp437")),
    ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("latin-1",) * 3, ("cp1252",) * 3,
)
#: Encodings of text that never was UTF-8, whose bytes were read in one of ``CODECS``.
PAGES = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5", "cp1253", "iso8859-7", "euc_jp", "shift_jis")
RUN = "[A-Za-z\\x{80}-\\x{10ffff}]+"
#: Ranges that hold no character of a garbled run.
FAR = "\\x{500}-\\x{1fff}\\x{2600}-\\x{f8fe}\\x{10000}-\\x{10ffff}"
REPLACEMENT = "�"
#: Bits of the bitmap that is sent to all executors: 16 for each suspicious run, within these bounds (2 and 16 MB).
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27
#: Readings of one text through several encodings that are undone at most.
DEPTH = 3
#: A byte sequence of UTF-8 for one character beyond ASCII, each byte as the character of its number.
SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
KANA = re.compile("[\u3041-\u30fe]")
JAPANESE = re.compile("[\u3000-\u30ff\u3400-\u9fff\uff01-\uff9f]+")
MIXED = regex.compile(r"(?=.*\p{Latin})(?=.*[\p{Cyrillic}\p{Greek}])|\p{Ll}\p{Lu}|\p{L}[\p{S}\p{C}\p{Po}\p{Sk}]|[\p{S}\p{C}]\p{L}|[\xc0-\xff]{4}", regex.DOTALL)
#: Two-byte characters of Shift-JIS, whose second byte may be ASCII: stretches of both are taken as a whole where a lead byte of kana comes twice.
SHIFT_JIS_STRETCH, LEADS = "[@-~\\x{80}-\\x{ff}\\x{152}-\\x{192}\\x{2c6}-\\x{2dc}\\x{2013}-\\x{2122}]{4,}", "[\\x{82}\\x{83}\\x{201a}\\x{192}]"


@lru_cache(maxsize=None)
def charset(codec: str) -> tuple[str, ...]:
    """The character for each byte."""
    out = []
    for byte in range(256):
        try:
            out.append(bytes([byte]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return tuple(out)


@lru_cache(maxsize=None)
def reverse(codec: str) -> dict[str, int]:
    return {char: byte for byte, char in enumerate(charset(codec))}


@lru_cache(maxsize=1)
def garble_class() -> str:
    """A regular expression of the characters that a garbled run is made of, besides ASCII letters."""
    codes = sorted({ord(c) for codec in CODECS for c in charset(codec) if ord(c) >= 0x80} | {ord(REPLACEMENT)})
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "[A-Za-z" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]+"  # ranges: the JVM asks each part of a class in turn


def garble(run: str, chain: tuple[str, ...]) -> str:
    """What becomes of a run whose bytes are read in the encodings of the chain."""
    for codec in chain:
        run = "".join(map(charset(codec).__getitem__, run.encode("utf-8", "replace")))
    return run


def lossy(run: str, codec: str) -> str:
    """The same with replacement characters for undefined bytes."""
    return run.encode("utf-8", "replace").decode(codec, "replace")


def legacy(run: str) -> set[str]:
    """The run as read from bytes of other legacy encodings, of these forms those that look like no word."""
    if FAR_CHAR.search(run):
        return set()
    made = set()
    for page in PAGES:
        try:
            data = run.encode(page)
        except UnicodeEncodeError:
            continue
        made |= {form for codec in CODECS if MIXED.search(form := "".join(map(charset(codec).__getitem__, data)))}
    return made


def forms(run: str) -> set[str]:
    """All garbled forms of a clean run."""
    made = {garble(run, chain) for chain in CHAINS} | {lossy(run, codec) for codec in CODECS[1:4]} | legacy(run)
    made.discard(run)
    return made


@lru_cache(maxsize=None)
def as_bytes(codec: str) -> dict[int, int]:
    """For ``str.translate``: each character of an encoding to that of its byte's number; others of these numbers to none."""
    return {code: 0xFFFF for code in range(0x80, 0x100)} | {ord(char): byte for char, byte in reverse(codec).items()}


def read_back(run: str, known: Collection[str], depth: int = DEPTH) -> tuple[str, int] | None:
    """(text, characters left unexplained): the run with byte sequences read back to ``known`` characters, as many readings deep as needed.

    Letters that the corpus never holds clean count where they explain all of a run that isn't made of letters alone. None where nothing reads back, or less than half of what isn't ASCII.
    """
    best: tuple[str, int] | None = None
    for codec in CODECS:
        shown = run.translate(as_bytes(codec))
        out, at, made = [], 0, []
        for m in SEQUENCE.finditer(shown):
            char = m[0].encode("latin-1").decode()
            out += [run[at : m.start()], char]
            made.append(char)
            at = m.end()
        if not made:
            continue
        text = "".join([*out, run[at:]])
        left = sum(not c.isascii() for c in text) - len(made)
        deeper = read_back(text, known, depth - 1) if depth > 1 else None
        sure = all(c in known for c in made) or left == 0 and not run.isalpha() and all(unicodedata.category(c)[0] in "LM" for c in made)
        found = deeper or ((text, left) if left <= 2 * len(made) and sure else None)
        if found and (best is None or found[1] < best[1]):
            best = found
        if best and best[1] == 0:
            break
    return best


def from_page(run: str, known: Collection[str]) -> str | None:
    """The original of a run of Japanese in legacy bytes, wholly of known characters of Japanese and with kana; or None."""
    for codec in ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437"):
        table = reverse(codec)
        if any(c not in table for c in run):
            continue
        data = bytes(table[c] for c in run)
        for page in ("euc_jp", "shift_jis"):
            try:
                text = data.decode(page)
            except UnicodeDecodeError:
                continue
            if len(KANA.findall(text)) >= 2 and JAPANESE.fullmatch(text) and all(c in known for c in text):
                return text
    return None


def explained(run: str, known: Collection[str], whole: bool = True) -> tuple[str | None, bool]:
    """(original or None, whether the run is garbled) by the forms of known characters.

    A few letters inside a mixed run that happen to be the bytes of one character are letters.
    """
    if run.isascii():
        return None, False
    found = read_back(run, known)
    if found and not (not whole and len(found[0]) == 1 and run.isalpha()):
        return (found[0] if found[1] == 0 and REPLACEMENT not in run else None), True
    original = from_page(run, known)
    return original, original is not None


def suspicious_run() -> Column:
    """Whether a run can be a garbled form at all; replacement characters are in the class too."""
    return F.col("run").rlike("^" + garble_class() + "$|" + LEADS)


def _hashes(made: list[str], bits: int) -> list[int]:
    return [xxhash.xxh64_intdigest(run.encode("utf-8", "surrogatepass")) % bits for run in made]


def _marks(bits: int):
    """(kind, slot): the hash of each suspicious run, and the characters of runs in which nothing reads back as UTF-8."""
    pattern = python_class("+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            odd = [r for r in names if pattern.fullmatch(r) or LEAD.search(r)]
            slots = set(_hashes(odd, bits))
            chars: set[str] = set()
            for r in names:
                if not chars.issuperset(r) and not (pattern.fullmatch(r) and any(SEQUENCE.search(r.translate(as_bytes(codec))) for codec in CODECS)):
                    chars.update(r)
            codes = [ord(c) for c in chars if c != REPLACEMENT and not "\x80" <= c < "\xa0"]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(slots) + [1] * len(codes), pa.int32()), pa.array([*slots, *codes], pa.int64())], names=["kind", "slot"])

    return run


class Known:
    """Characters by a bitmap of all code points."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __contains__(self, char: str) -> bool:
        code = ord(char)
        return bool(self.bits[code >> 3] >> (code & 7) & 1)


def _generated(bitmap: np.ndarray, bits: int, known: Known):
    """Every garbled form of each clean run that the bitmap lets through: (form, original)."""
    pattern = python_class("+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[str] = []
            originals: list[str] = []
            for r in batch.column(0).to_pylist():
                if REPLACEMENT in r or (pattern.fullmatch(r) or LEAD.search(r)) and explained(r, known)[1]:
                    continue
                of = forms(r)
                made.extend(of)
                originals.extend([r] * len(of))
            if not made:
                continue
            slots = np.array(_hashes(made, bits), np.int64)
            keep = (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([made[k] for k in keep], pa.string()), pa.array([originals[k] for k in keep], pa.string())], names=["run", "original"])

    return run


def _explained(known: Known):
    """(run, original) of the suspicious runs that hold garbled characters; without an original where not all of it is read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                original, garbled = explained(r, known, whole)
                if garbled or REPLACEMENT in r:
                    rows.append((r, original))
            columns = list(zip(*rows)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["run", "original"])

    return run


def python_class(times: str = "") -> re.Pattern:
    """The class of garbled characters as a pattern of Python."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), garble_class().removesuffix("+")) + times)


FAR_CHAR = re.compile("[\u0500-\u1fff\U00010000-\U0010ffff]")
LEAD = re.compile("[\x82\x83\u201a\u0192]")
STRETCH = re.compile("[@-~\x80-\xff\u0152-\u0192\u02c6-\u02dc\u2013-\u2122]{4,}")


def runs(df: DataFrame, id_col: str, text_col: str, only_suspicious: bool = False) -> DataFrame:
    """(id, run, whole): the runs with characters outside ASCII of each text; of mixed runs also the stretches within and outside the garble class."""
    beyond = lambda r: r.rlike("[^\\x00-\\x7f]")
    mixed = lambda r: r.rlike(f"[^{FAR}]") & ~r.rlike("^" + garble_class() + "$")
    inside = lambda r: r.rlike("^" + garble_class() + "$")
    stretches = F.lit(garble_class() + "|[^" + garble_class()[1:])
    whole = F.filter(F.array_distinct(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))), beyond)
    cut = F.flatten(F.transform(F.filter(whole, mixed), lambda r: F.regexp_extract_all(r, stretches, F.lit(0))))
    bytes_ = F.when(F.col(text_col).rlike(f"{LEADS}.{LEADS}"), F.regexp_extract_all(text_col, F.lit(SHIFT_JIS_STRETCH), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kept = (lambda r: beyond(r) & inside(r)) if only_suspicious else beyond
    found = F.concat(
        F.transform(F.filter(whole, inside) if only_suspicious else whole, lambda r: F.struct(r.alias("run"), F.lit(True).alias("whole"))),
        F.transform(F.array_distinct(F.filter(cut, kept)), lambda r: F.struct(r.alias("run"), F.lit(False).alias("whole"))),
        F.transform(F.array_distinct(F.filter(bytes_, lambda r: r.rlike(LEADS))), lambda r: F.struct(r.alias("run"), F.lit(False).alias("whole"))),
    )
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias(text_col))).select("id", F.inline(found))


def _bitmap(rows: list, kind: int, bits: int) -> np.ndarray:
    """The parts of one bitmap put together: at most bits / 32768 rows of 4 KB."""
    out = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for row in rows:
        if row.kind == kind:
            part = np.frombuffer(row.bits, np.uint8)
            out[(row.bucket - 1) * 4096 : (row.bucket - 1) * 4096 + len(part)] = part
    return out


def garbled_runs(df: DataFrame, id_col: str = "record", text_col: str = "text") -> DataFrame:
    """(run, original, by): the garbled runs of the corpus; ``by`` is ``words`` or ``characters``; original is null where it can't be told."""
    distinct = written(runs(df, id_col, text_col).groupBy("run").agg(F.max("whole").alias("whole")))
    suspicious = distinct.where(suspicious_run())
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * suspicious.count()).bit_length()))
    marks = distinct.select("run").mapInArrow(_marks(bits), "kind int, slot long")
    parts = marks.groupBy("kind", F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits")).collect()
    known = Known(_bitmap(parts, 1, sys.maxunicode + 1))
    made = distinct.select("run").mapInArrow(_generated(_bitmap(parts, 0, bits), bits, known), "run string, original string")
    listed = made.join(suspicious.select("run"), "run", "left_semi").groupBy("run").agg(F.min("original").alias("original"))
    by_chars = suspicious.mapInArrow(_explained(known), "run string, original string")
    both = listed.withColumn("order", F.lit(0)).unionByName(by_chars.withColumn("order", F.lit(1)))
    best = both.groupBy("run").agg(F.min_by("original", F.when(F.col("original").isNotNull(), F.col("order")).otherwise(2)).alias("original"), F.min("order").alias("order"))
    return best.select("run", "original", F.when(F.col("order") == 0, "words").otherwise("characters").alias("by"))


def affected(df: DataFrame, id_col: str = "record", text_col: str = "text") -> DataFrame:
    """(id): the rows whose text holds a garbled run or a replacement character."""
    bad = garbled_runs(df, id_col, text_col)
    there = runs(df, id_col, text_col, True).select("id", "run")
    return there.join(bad, "run", "left_semi").select(F.col("id").alias(id_col)).distinct()


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pattern = python_class("+")
    for batch in batches:
        out = []
        for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            known = {p["run"]: p["original"] for p in pairs}
            text = STRETCH.sub(lambda m: known.get(m[0], m[0]), text)
            out.append(pattern.sub(lambda m: known.get(m[0], m[0]), text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, source): the text as ``raw`` has it, where it differs from the text that was read."""
    for batch in batches:
        rows = []
        for at, text, raw, kind, field in zip(*(batch.column(k).to_pylist() for k in range(5))):
            source = raw
            if raw and (kind == "jsonl" or kind is None and raw.startswith("{")):
                try:
                    found = json.loads(raw)
                    source = found.get(field) if isinstance(found, dict) else None
                    if isinstance(source, str):
                        source.encode()
                except (ValueError, RecursionError):  # not JSON, or lone surrogates
                    source = None
            elif kind not in (None, "txt"):
                source = None
            if isinstance(source, str) and source and text and source != text:
                rows.append((at, source))
        columns = list(zip(*rows)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["id", "source"])


def sources(df: DataFrame, inputs: DataFrame | None, id_col: str, text_col: str, raw_col: str) -> DataFrame:
    """(id, source): the original that ``raw`` holds, of a JSON line the ``text_field`` of its input. Without ``inputs`` JSON lines have none."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(raw_col).alias("raw"), *["input_path"] * (inputs is not None))
    if inputs is None:
        rows = rows.withColumns({"input_format": F.lit(None).cast("string"), "text_field": F.lit(None).cast("string")})
    else:
        rows = spread(rows).join(inputs.groupBy("input_path").agg(F.first("input_format").alias("input_format"), F.first("text_field").alias("text_field")), "input_path", "left")
    return rows.select("id", "text", "raw", "input_format", "text_field").mapInArrow(_sources, "id long, source string")


def restored(df: DataFrame, id_col: str = "record", text_col: str = "text", raw_col: str = "raw", inputs: DataFrame | None = None) -> DataFrame:
    """(id, restored, complete): affected rows with the verified originals put in place of garbled runs.

    Where ``raw`` holds another text without garbled runs, that is the original text; of JSON lines, with ``inputs`` (input_path, input_format,
    text_field), the text field. ``complete``: nothing garbled is left.
    """
    held = written(sources(df, inputs, id_col, text_col, raw_col))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bad = written(garbled_runs(texts.unionByName(held.select("id", F.col("source").alias("text"))), "id", "text"))
    hits = runs(df, id_col, text_col, True).select("id", "run").join(bad, "run")
    per_row = hits.groupBy("id").agg(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("run", "original"))).alias("pairs"), F.max(F.col("original").isNull()).alias("lost"))
    rows = texts.join(per_row, "id")
    fixed = rows.select("id", "text", "pairs").mapInArrow(_rebuilt, "id long, text string").withColumnRenamed("text", "by_runs")
    dirty = runs(held, "id", "source", True).select("id", "run").join(bad, "run", "left_semi").select("id").distinct()
    whole = held.join(dirty, "id", "left_anti")
    return rows.join(fixed, "id").join(whole, "id", "left").select(F.col("id").alias(id_col), F.coalesce("source", "by_runs").alias("restored"), (~F.col("lost") | F.col("source").isNotNull()).alias("complete"))
