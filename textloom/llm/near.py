"""Near-duplicate texts by meet-in-the-middle ball hashing.

A text is the set of its sequences of three words. Its fingerprints are ``FINGERPRINTS`` short sequences of ``SYMBOLS`` min-hashes;
in each, two texts of similarity s agree at any place with probability s. The distance of two fingerprints counts insertions and
deletions of symbols, so one differing symbol is a distance of two. Every fingerprint emits all its variants within half that radius:
those with one symbol left out. Two fingerprints within the radius meet at the variant without the symbol in which they differ.
Texts are shuffled on variants, the colliding pairs deduplicated, and each pair verified on the full sets. Variants on which very many
texts would meet are replaced by an exact filter on rare shingles for those texts.

Texts of one word sequence and content form a class and only one of them takes part, so copies never meet. Pairs of classes are
expanded into pairs of records at the end. With ten fingerprints of four symbols a pair at the threshold of 0.6 is found with
probability 0.998, at 0.7 with more than 0.99999.

Defined cases: null texts and texts of fewer than ``min_words`` words are in no pair; texts of the same content are no pair; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import content, words
from ..session import spread, written
from .pairs import expand

THRESHOLD, SHINGLE, MIN_WORDS = 0.6, 3, 8
FINGERPRINTS, SYMBOLS = 10, 4
#: Classes that may meet on one variant.
LARGE = 1000
ODD = np.random.default_rng(2024).integers(0, 1 << 63, size=(256, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of all sequences of ``size`` words."""
    n = len(word_hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += word_hashes[k : k + n] * ODD[k, 0]
    return np.unique(mixed(total))


def _classes(size: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, int] = {}
        for batch in batches:
            rows = []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                found = words(text)
                if len(found) < min_words:
                    continue
                for word in found:
                    if word not in hashes:
                        hashes[word] = xxhash.xxh64_intdigest(word)
                one = np.array([hashes[word] for word in found], np.uint64)
                same = xxhash.xxh3_64_intdigest(content(text)) - (1 << 63)
                rows.append((at, xxhash.xxh3_128_digest(one.tobytes() + same.to_bytes(8, "big", signed=True)), same, shingles(one, size).view(np.int64)))
            if len(hashes) > 300_000:  # a cache
                hashes.clear()
            columns = list(zip(*rows)) or [[], [], [], []]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "words", "content", "shingles"])

    return run


def variants(flat: np.ndarray, starts: np.ndarray, fingerprints: int, symbols: int) -> np.ndarray:
    """Rows of variants, one row for each set of shingles: each fingerprint with each of its symbols left out in turn."""
    out = np.empty((len(starts), fingerprints * symbols), np.uint64)
    for f in range(fingerprints):
        parts = np.empty((symbols, len(starts)), np.uint64)
        for s in range(symbols):
            a, b = ODD[f * symbols + s]
            parts[s] = mixed(np.minimum.reduceat((flat * a + b) ^ (flat >> np.uint64(29)), starts) + ODD[s, 1])
        whole = parts.sum(axis=0, dtype=np.uint64)
        for s in range(symbols):
            out[:, f * symbols + s] = mixed((whole - parts[s]) * ODD[f * symbols + s, 0])
    return out


def _emitted(fingerprints: int, symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column(1)
                flat = np.asarray(lists.flatten()).view(np.uint64)
                lengths = np.asarray(lists.value_lengths())
                keys = variants(flat, np.concatenate([[0], np.cumsum(lengths)[:-1]]), fingerprints, symbols)
                ids = np.repeat(np.asarray(part.column(0)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["variant", "class"])

    return run


def met(emitted: DataFrame) -> DataFrame:
    """(a, b), a < b: classes that share a key of (key, class); duplicates remain."""
    return emitted.select("key", F.col("class").alias("a")).join(emitted.select("key", F.col("class").alias("b")), "key").where("a < b").select("a", "b")


def rare_prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, class): of each set its rarest shingles, as many as make sure that sets of this similarity share one of them.

    Two sets of n and m elements with similarity t share at least t * max(n, m) elements, so one of them is among the
    first n - ceil(t * n) + 1 of either, whatever the common order; rare shingles first keeps the groups small.
    """
    rows = classes.select("class", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("often"))
    ordered = rows.join(counts, "key").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("all"))
    return ordered.select("class", F.explode(F.slice("all", 1, F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)).alias("x")).select("x.key", "class")


def near_classes(classes: DataFrame, threshold: float = THRESHOLD, fingerprints: int = FINGERPRINTS, symbols: int = SYMBOLS, large: int = LARGE) -> DataFrame:
    """(a, b, similarity): pairs of rows (class, content, shingles) of other content whose similarity is at least ``threshold``.

    Variants of more than ``large`` classes are no evidence of closeness: their classes meet on rare shingles instead, which misses no pair.
    """
    emitted = written(classes.select("class", "shingles").mapInArrow(_emitted(fingerprints, symbols), "variant long, class long").withColumnRenamed("variant", "key"))
    crowded = written(emitted.groupBy("key").agg(F.count("*").alias("often")).where(F.col("often") > large).select("key"))
    if crowded.isEmpty():
        found = met(emitted)
    else:
        crowd = emitted.join(crowded, "key", "left_semi").select("class").distinct()
        found = met(emitted.join(crowded, "key", "left_anti")).unionByName(met(rare_prefixes(classes.join(crowd, "class", "left_semi"), threshold)))
    candidates = written(found.distinct())
    half = candidates.join(classes.select(F.col("class").alias("a"), F.col("content").alias("ca"), F.col("shingles").alias("sa")), "a")
    both = half.join(classes.select(F.col("class").alias("b"), F.col("content").alias("cb"), F.col("shingles").alias("sb")), "b").where("ca <> cb")
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def classified(df: DataFrame, id_col: str, text_col: str, size: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, class) and classes (class, content, shingles); a class is named by its smallest id."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    base = written(rows.mapInArrow(_classes(size, min_words), "id long, words binary, content long, shingles array<long>"))
    named = base.groupBy("words").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    classes = written(base.join(named.select(F.col("class").alias("id")), "id").select(F.col("id").alias("class"), "content", "shingles"))
    members = base.select("id", "words").join(named.select("words", "class"), "words").select("id", "class")
    return members, classes


def near_pairs(df: DataFrame, id_col: str = "record", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(record_a, record_b): pairs of records of other content whose similarity is at least ``threshold``."""
    members, classes = classified(df, id_col, text_col, size, min_words)
    pairs = written(near_classes(classes, threshold))
    concerned = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    members = members.join(concerned, "class", "left_semi")
    return expand(pairs.select("a", "b"), members).select(F.col("low").alias("record_a"), F.col("high").alias("record_b"))
