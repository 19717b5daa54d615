"""Personal data inside free text, found by a bidirectional LSTM over characters with a CRF on top, in numpy.

A character is a base letter with its marks; the sum of fixed hashes of its code points names its row of the input table, which
holds the products of embedding and input weights. Texts are cut into overlapping windows, windows sorted by length
and run in batches of which every step is one small matrix product; the CRF's best path labels each character. Where windows overlap, each
decides up to the middle of the overlap, and the labels of a text are put together before spans are read from them, so a span may cross windows.
Spans grow to whole words and must have the shape of their kind: an address or name holds letters, a phone number 7 to 15 digits, an e-mail address an @ or its spelling.

The weights, next to this module, are trained by ``pii_train`` from labelled spans. They are of fixed size.

Defined cases: null texts are null and have no findings, empty ones stay; a text of any length is decoded in whole; equal texts of a batch are decoded once;
extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import io
import pkgutil
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: Rows of the input table; characters of a window and of the overlap of two; windows of a batch.
VOCABULARY, WINDOW, OVERLAP, BATCH = 4096, 240, 40, 512
CODE_POINTS = 0x20000
TOUCHING = regex.compile(r"[\p{L}\p{M}\p{Nd}]")
#: Characters over which a span of these kinds goes on in both directions.
JOINED = {"email": regex.compile(r"[A-Za-z0-9._%+@＠-]"), "phone": regex.compile(r"[\p{Nd}+()-]")}


@lru_cache(maxsize=1)
def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(hash, mark) of each code point; digits of all scripts share one of two hashes, ASCII or other."""
    hashes = np.random.default_rng(5).integers(0, 1 << 20, CODE_POINTS, dtype=np.int64)
    marks = np.zeros(CODE_POINTS, bool)
    for code in range(CODE_POINTS):
        category = unicodedata.category(chr(code))
        marks[code] = category[0] == "M"
        if category == "Nd":
            hashes[code] = 77 if code < 128 else 78
        elif 0x3041 <= code <= 0x30FA or 0x3400 <= code <= 0x9FFF:
            hashes[code] = 79 + (code >= 0x3400)
    return hashes, marks


def characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the input table, start of each character) of a text."""
    hashes, marks = code_tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % CODE_POINTS
    first = ~marks[codes]
    first[0] = True
    starts = first.nonzero()[0]
    return (np.add.reduceat(hashes[codes], starts) % VOCABULARY).astype(np.int32), starts


def windows(length: int) -> list[tuple[int, int]]:
    """(start, end) of the windows of a text."""
    if length <= WINDOW:
        return [(0, length)]
    step = WINDOW - OVERLAP
    starts = list(range(0, length - OVERLAP, step))
    return [(a, min(length, a + WINDOW)) for a in starts]


class Tagger:
    """The trained network; gates come as input, forget, output, candidate."""

    def __init__(self, weights: dict[str, np.ndarray]):
        half = weights["uf"].shape[0]
        self.half = half
        scale = np.ones(4 * half, np.float32)
        scale[: 3 * half] = 0.5  # a sigmoid is a tanh of half its argument
        self.tables = [np.ascontiguousarray((weights["emb"] @ weights["w" + d] + weights["b" + d]) * scale) for d in "fb"]
        self.inner = [np.ascontiguousarray(weights["u" + d] * scale) for d in "fb"]
        self.out, self.bias, self.trans = weights["wo"], weights["bo"], weights["trans"]

    def states(self, ids: np.ndarray, alive: np.ndarray, which: int) -> np.ndarray:
        """Hidden states (steps, windows, half); ids are (steps, windows) with longer windows first, alive the windows at each step."""
        steps, n = ids.shape
        half, table, inner = self.half, self.tables[which], self.inner[which]
        out = np.zeros((steps, n, half), np.float32)
        h, c = np.zeros((n, half), np.float32), np.zeros((n, half), np.float32)
        gates, t = np.empty((n, 4 * half), np.float32), np.empty((n, half), np.float32)
        for s in range(steps) if which == 0 else range(steps - 1, -1, -1):
            m = alive[s]
            z, hm, cm, tm = gates[:m], h[:m], c[:m], t[:m]
            np.matmul(hm, inner, out=z)
            z += table[ids[s, :m]]
            np.tanh(z, out=z)
            open_, keep, show, new = (z[:, k * half : (k + 1) * half] for k in range(4))
            keep += 1
            open_ += 1
            cm *= keep
            open_ *= new
            cm += open_
            cm *= 0.5
            np.tanh(cm, out=tm)
            show += 1
            tm *= show
            tm *= 0.5
            hm[...] = tm
            out[s, :m] = tm
        return out

    def decode(self, ids: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """The best path of labels (steps, windows)."""
        steps, n = ids.shape
        half = self.half
        scores = self.states(ids, alive, 0).reshape(-1, half) @ self.out[:half]
        scores += self.states(ids, alive, 1).reshape(-1, half) @ self.out[half:]
        scores = (scores + self.bias).reshape(steps, n, -1)
        labels = scores.shape[2]
        back = np.zeros((steps, n, labels), np.uint8)
        best = scores[0].copy()
        for s in range(1, steps):
            m = alive[s]
            top, arg = best[:m, 0:1] + self.trans[0], np.zeros((m, labels), np.uint8)
            for k in range(1, labels):
                other = best[:m, k : k + 1] + self.trans[k]
                better = other > top
                np.copyto(top, other, where=better)
                arg[better] = k
            back[s, :m] = arg
            best[:m] = top + scores[s, :m]
        path = np.zeros((steps, n), np.uint8)
        last = best.argmax(1).astype(np.uint8)
        rows = np.arange(n)
        for s in range(steps - 1, -1, -1):
            m = alive[s]
            path[s, :m] = last[:m]
            last[:m] = back[s, rows[:m], last[:m]]
        return path

    def labels(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(labels, starts) of the characters of each text, put together from its windows."""
        cut = [characters(text) for text in texts]
        parts = [(k, a, b) for k, (ids, _) in enumerate(cut) for a, b in windows(len(ids))]
        parts.sort(key=lambda p: p[1] - p[2])
        out = [np.zeros(len(ids), np.uint8) for ids, _ in cut]
        for at in range(0, len(parts), BATCH):
            batch = parts[at : at + BATCH]
            lengths = np.array([b - a for _, a, b in batch])
            ids = np.zeros((lengths[0], len(batch)), np.int32)
            for column, (k, a, b) in enumerate(batch):
                ids[: b - a, column] = cut[k][0][a:b]
            alive = len(batch) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1))
            path = self.decode(ids, alive)
            for column, (k, a, b) in enumerate(batch):
                low = a + (OVERLAP // 2 if a else 0)
                high = b - (OVERLAP // 2 if b < len(out[k]) else 0)
                out[k][low:high] = path[low - a : high - a, column]
        return [(labels, starts) for labels, (_, starts) in zip(out, cut)]


@lru_cache(maxsize=1)
def one_thread() -> str | None:
    """Keep this worker's matrix products on one core, as tasks fill all cores already; the name of the library's switch, if found."""
    try:
        paths = {line.split()[-1] for line in Path("/proc/self/maps").read_text().splitlines() if "openblas" in line}
        for path in sorted(paths):
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
                    return name
    except OSError:
        pass
    return None


@lru_cache(maxsize=2)
def tagger(path: str | None = None) -> Tagger:
    """The network of a file, or of the weights that come with this package, be it a folder or an archive."""
    source = path or io.BytesIO(pkgutil.get_data(__package__, WEIGHTS.name))
    with np.load(source) as stored:
        return Tagger({name: stored[name].astype(np.float32) for name in stored.files})


#: The shape of an e-mail address, or of one spelled out; a plain "at" needs a spelled dot.
ADDRESS_SIGN = regex.compile(
    r"[\w.+-]\s?(?:[@＠]|[(\[{<]\s?at\s?[)\]}>])\s?[\w-]+(?:[.．]|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s)[\w-]|[\w.+-]\sat\s[\w-]+\sdot\s[\w-]",
    regex.IGNORECASE,
)


def fits(kind: str, span: str) -> bool:
    """Whether a span can be of its kind at all."""
    digits, letters, words = len(regex.findall(r"\p{Nd}", span)), len(regex.findall(r"\p{L}", span)), len(span.split())
    if kind == "email":
        return bool(ADDRESS_SIGN.search(span))
    if kind == "phone":
        return 7 <= digits <= 15 and letters == 0
    if kind == "id_number":
        return 6 <= digits <= 20 and letters <= 4
    if kind == "address":
        return digits >= 1 and letters >= 3 and words >= 2
    return letters >= 3 and digits == 0 and 2 <= words <= 4


def spans_of(text: str, labels: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the spans in a labelled text, grown to whole words."""
    if not labels.any():
        return []
    edges = np.flatnonzero(np.diff(labels)) + 1
    bounds = [0, *edges.tolist(), len(labels)]
    found: list[tuple[int, int, str]] = []
    for a, b in zip(bounds, bounds[1:]):
        if not labels[a]:
            continue
        kind = KINDS[labels[a] - 1]
        low, high = int(starts[a]), int(starts[b]) if b < len(starts) else len(text)
        while low > (found[-1][1] if found else 0) and TOUCHING.match(text[low - 1]) and TOUCHING.match(text[low]):
            low -= 1
        while high < len(text) and TOUCHING.match(text[high - 1]) and TOUCHING.match(text[high]):
            high += 1
        if joined := JOINED.get(kind):
            while low > (found[-1][1] if found else 0) and joined.match(text[low - 1]) and joined.match(text[low]):
                low -= 1
            while high < len(text) and joined.match(text[high - 1]) and joined.match(text[high]):
                high += 1
        while low < high and text[low].isspace():
            low += 1
        while high > low and (text[high - 1].isspace() or text[high - 1] in ".,;:।"):
            high -= 1
        if found and found[-1][2] == kind and not text[found[-1][1] : low].strip():
            low = found.pop()[0]
        if low < high:
            found.append((low, high, kind))
    return [x for x in found if fits(x[2], text[x[0] : x[1]])]


def find(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """The spans of each text; equal texts are decoded once."""
    distinct = list(dict.fromkeys(t for t in texts if t))
    known = {text: spans_of(text, *labelled) for text, labelled in zip(distinct, tagger().labels(distinct))}
    return [known.get(text, []) if text else [] for text in texts]


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in the place of each span."""
    out, at = [], 0
    for low, high, kind in spans:
        out += [text[at:low], f"<{kind.upper()}>"]
        at = high
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one_thread()
    for batch in batches:
        for at in range(0, batch.num_rows, 2500):
            part = batch.slice(at, 2500)
            texts = part.column(1).to_pylist()
            rows = [(i, kind) for i, spans in zip(part.column(0).to_pylist(), find(texts)) for kind in sorted({s[2] for s in spans})]
            columns = list(zip(*rows)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["id", "kind"])


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one_thread()
    for batch in batches:
        for at in range(0, batch.num_rows, 2500):
            part = batch.slice(at, 2500)
            texts = part.column(1).to_pylist()
            spans = find(texts)
            out = [None if text is None else masked(text, s) for text, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array([len(s) for s in spans], pa.int32())], names=["id", "masked", "spans"])


def kinds(df: DataFrame, id_col: str = "record", text_col: str = "text") -> DataFrame:
    """(record, kind): one row for each kind of personal data in a text."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_found, "id long, kind string").withColumnRenamed("id", id_col)


def replaced(df: DataFrame, id_col: str = "record", text_col: str = "text") -> DataFrame:
    """(record, masked, spans): each text with placeholders, the rest unchanged, and the number of placeholders."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_masked, "id long, masked string, spans int").withColumnRenamed("id", id_col)
