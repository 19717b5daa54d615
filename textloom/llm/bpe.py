"""Encoding of a corpus with a public byte-level BPE tokenizer by replaying its merges over the distinct words.

Each task cuts its share of the corpus into words, and replays the merges over the words it has not met yet: an inverted index maps
each pair of adjacent tokens to the places where it stands; a heap hands out the pairs present by rank; a merge visits only the
places of its pair and updates only the two neighbours of each. Words are encoded once per task, whatever their frequency, and
documents are put together from them, so the corpus is never shuffled. Merges within a word don't depend on other words, which
makes the result the same however the corpus is cut.

Defined cases: null and empty texts have an empty list; look-alikes of special tokens are ordinary text; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: how the tokenizer cuts a text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Whitespace of that pattern. A run between whitespace, with the one space before it, is always cut alike: its ids are kept as a whole.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Characters that are cut into words at a time, and words that a task keeps: bounds of memory, without effect on the result.
CHUNK_CHARS, KEPT_WORDS = 400_000, 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, others follow from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = count(256)
    return [chr(b if b in plain else next(others)) for b in range(256)]


class MergeReplay:
    """Encodes words by replaying a tokenizer's merges over all of them at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        self.bytes = [vocab[letter] for letter in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.word = regex.compile(WORD)
        self.known: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, tuple[int, ...]] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Replay the merges over these words and keep their ids."""
        token: list[int] = []
        ends: list[int] = []
        words = list(words)
        for word in words:
            token.extend(map(self.bytes.__getitem__, word.encode("utf-8", "replace")))
            ends.append(len(token))
        size = len(token)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        start = 0
        for end in ends:
            left[start], right[end - 1] = -1, -1
            start = end
        merges, places = self.merges, defaultdict(list)
        for at in range(size):
            if (nxt := right[at]) >= 0 and (pair := (token[at], token[nxt])) in merges:
                places[pair].append(at)
        heap = [(merges[pair][0], pair) for pair in places]
        heapify(heap)
        while heap:
            _, pair = heappop(heap)
            made, (first, second) = merges[pair][1], pair
            for at in places.pop(pair):
                nxt = right[at]
                if token[at] != first or nxt < 0 or token[nxt] != second:
                    continue  # an earlier merge took one of the two
                token[at], token[nxt] = made, -1
                after = right[at] = right[nxt]
                if after >= 0:
                    left[after] = at
                    if (new := (made, token[after])) in merges:
                        if new not in places:
                            heappush(heap, (merges[new][0], new))
                        places[new].append(at)
                if (before := left[at]) >= 0 and (new := (token[before], made)) in merges:
                    if new not in places:
                        heappush(heap, (merges[new][0], new))
                    places[new].append(before)
        start = 0
        for word, end in zip(words, ends):
            self.known[word] = tuple(t for t in token[start:end] if t >= 0)
            start = end

    def encode(self, texts: list[str | None]) -> Iterator[array]:
        """The ids of each text, in order."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(RUN.findall(text) if text else [])
            size += len(text or "")
            if size > CHUNK_CHARS:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[array]:
        new = set(chain.from_iterable(held)).difference(self.runs)
        if len(self.runs) + len(new) > KEPT_WORDS or len(self.known) > KEPT_WORDS:
            self.runs.clear()
            self.known.clear()
            new = set(chain.from_iterable(held))
        if new:
            cut = {run: self.word.findall(run) for run in new}
            self.learn(sorted(set(chain.from_iterable(cut.values())).difference(self.known)))
            word = self.known.__getitem__
            for run, words in cut.items():
                self.runs[run] = tuple(chain.from_iterable(map(word, words)))
        get = self.runs.__getitem__
        for runs in held:
            yield array("i", chain.from_iterable(map(get, runs)))


@lru_cache(maxsize=2)
def replay_of(path: str) -> MergeReplay:
    """The tokenizer of this Python worker, which keeps the words it knows from one task to the next."""
    return MergeReplay(path)


def _replays(path: str, only_count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = list(replay.encode(part.column(1).to_pylist()))
                lengths = np.fromiter(map(len, ids), np.int32, len(ids))
                if only_count:
                    last: pa.Array = pa.array(lengths)
                else:
                    offsets = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum(lengths, out=offsets[1:])
                    flat = np.frombuffer(b"".join(x.tobytes() for x in ids), np.int32)
                    last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), last], names=["id", "out"])

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens. ``tokenizer``: path of a byte-level BPE in JSON."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    got = rows.mapInArrow(_replays(tokenizer or tokenizer_path(), False), "id long, out array<int>")
    return got.select(F.col("id").alias(id_col), F.col("out").alias("ids"))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, tokens): the number of tokens of each text."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    got = rows.mapInArrow(_replays(tokenizer or tokenizer_path(), True), "id long, out int")
    return got.select(F.col("id").alias(id_col), F.col("out").alias("tokens"))
