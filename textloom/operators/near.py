"""Near duplicates by min-hash bands, verified by exact Jaccard similarity, kept greedily in record order.

Record v is dropped if a kept record u < v shares a band with it and is similar enough; its match is the smallest such u. As a set
computation: pairs by a join on bands, verified on the full shingle sets, then a fix-point in which a record is kept once all its
smaller neighbours are dropped, and dropped once one is kept. Links stay distributed, each round in the shared folder, until few enough are open for one task.
"""

from __future__ import annotations

import hashlib
import random
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKENS
from ..policy import Policy
from ..session import spread, written
from .exact import eligible

PRIME = (1 << 61) - 1
TOKEN = regex.compile(TOKENS)
JOINT = "␟"
#: Records of a bucket up to which all its pairs are candidates; links that one task decides.
LARGE, FINISH_LINKS = 2_000, 1_000_000
BITS31, BITS30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def tokens(text: str) -> list[str]:
    """Maximal runs of letters, marks and numbers in folded, composed text."""
    return TOKEN.findall(unicodedata.normalize("NFC", text).casefold())


def digest64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())


def shingles(text: str, size: int) -> set[int]:
    """64-bit hashes of word shingles; of character shingles where there are too few words; none of a shorter text."""
    found = tokens(text)
    if len(found) >= size:
        return {digest64(JOINT.join(found[k : k + size])) for k in range(len(found) - size + 1)}
    compact = "".join(unicodedata.normalize("NFC", text).casefold().split())
    width = max(3, size + 2)
    return {digest64(compact[k : k + width]) for k in range(len(compact) - width + 1)}


@lru_cache(maxsize=8)
def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The multipliers and offsets of the permutations, from a fixed seed."""
    source = random.Random(0)
    pairs = [(source.randrange(1, PRIME), source.randrange(0, PRIME)) for _ in range(count)]
    return np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)


def signature(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of each permutation; products modulo 2^61 - 1 from 31-bit halves, for all permutations at once."""
    prime, half = np.uint64(PRIME), np.uint64(31)
    a, b = (x[:, None] for x in coefficients(count))
    h = hashes % prime
    h1, h0, a1, a0 = h >> half, h & BITS31, a >> half, a & BITS31
    middle = a1 * h0 + a0 * h1
    high = (np.uint64(2) * (a1 * h1) + (middle >> np.uint64(30))) % prime
    low = (((middle & BITS30) << half) + a0 * h0 % prime) % prime
    return ((high + low + b) % prime).min(1)


def bands(signed: np.ndarray, rows: int) -> list[int]:
    """One 64-bit bucket for each band, as a signed number."""
    packed = signed.astype(">u8")
    return [int.from_bytes(hashlib.blake2b(packed[k : k + rows].tobytes(), digest_size=8).digest(), "big", signed=True) for k in range(0, len(packed), rows)]


def _sketches(size: int, count: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = np.array(sorted(shingles(text, size)), np.uint64)
                made = hashes.view(np.int64)
                key = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                out.append((record, made, key, bands(signature(hashes, count), rows) if len(hashes) else []))
            columns = list(zip(*out)) or [[]] * 4
            types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["record", "shingles", "set_key", "bands"])

    return run


def sketches(found: DataFrame, policy: Policy) -> DataFrame:
    """(record, shingles, set_key, bands) of the eligible records."""
    rows = spread(found.where(eligible()).select("record", "norm"))
    return rows.mapInArrow(_sketches(policy.shingle_size, policy.lsh_bands * policy.lsh_rows, policy.lsh_rows), "record long, shingles array<long>, set_key binary, bands array<long>")


def candidates(sets: DataFrame, threshold: float, large: int = LARGE) -> DataFrame:
    """(u, v), u < v: records that share a band.

    Buckets of one record are dropped after a count that combines before its shuffle. In a bucket of more than ``large`` records not all pairs
    are made: its records meet on their rarest shingles, which misses no pair of the threshold, and the meeting pairs are held against their bands.
    """
    buckets = sets.select("record", F.posexplode("bands").alias("band", "bucket"))
    counts = written(buckets.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1"))
    usual = buckets.join(counts.where(F.col("n") <= large).select("band", "bucket"), ["band", "bucket"], "left_semi")
    found = usual.withColumnRenamed("record", "u").join(usual.withColumnRenamed("record", "v"), ["band", "bucket"]).where("u < v").select("u", "v")
    hot = counts.where(F.col("n") > large)
    if not hot.isEmpty():
        crowd = sets.join(buckets.join(hot, ["band", "bucket"], "left_semi").select("record").distinct(), "record", "left_semi")
        rare = rare_shingles(crowd, threshold)
        met = rare.withColumnRenamed("record", "u").join(rare.withColumnRenamed("record", "v"), "shingle").where("u < v").select("u", "v").distinct()
        of = lambda name: sets.select(F.col("record").alias(name), F.col("bands").alias(f"{name}_bands"))
        share = F.exists(F.zip_with("u_bands", "v_bands", lambda x, y: x == y), lambda same: same)
        found = found.unionByName(met.join(of("u"), "u").join(of("v"), "v").where(share).select("u", "v"))
    return found.distinct()


def rare_shingles(sets: DataFrame, threshold: float) -> DataFrame:
    """(shingle, record): of each set the rarest shingles, so many that two sets of this similarity share one of them.

    Sets of at most n elements with similarity t have t * n in common: one of them is among the first n - ceil(t * n) + 1 of either in any common order.
    """
    rows = sets.select("record", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    sorted_ = rows.join(often, "shingle").groupBy("record", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("all"))
    first = F.slice("all", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    return sorted_.select(F.explode(F.transform(first, lambda x: x["shingle"])).alias("shingle"), "record")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v, similarity) of the pairs that are similar enough."""
    half = pairs.join(sets.select(F.col("record").alias("u"), F.col("shingles").alias("su")), "u")
    both = half.join(sets.select(F.col("record").alias("v"), F.col("shingles").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.select("u", "v", (shared / (F.size("su") + F.size("sv") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, kept) of all v of links (u, v, kept), kept being that of u where it is known; all links in one task, by rising v."""
    links = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if links is None:
        return
    u, v = (np.asarray(links.column(k).combine_chunks()) for k in (0, 1))
    known = links.column(2).to_pylist()
    state: dict[int, bool] = {}
    for at in np.argsort(v, kind="stable").tolist():
        low, high = int(u[at]), int(v[at])
        below = known[at] if known[at] is not None else state[low]
        state[high] = state.get(high, True) and not below
    yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int64()), pa.array(list(state.values()), pa.bool_())], names=["record", "kept"])


def greedy(links: DataFrame, at_once: int = FINISH_LINKS) -> DataFrame:
    """(record, kept) of all records in links (u, v), u < v: kept if and only if no kept record is linked below it.

    Every round decides at least the smallest undecided record of each connected part and drops the links that no longer matter. As soon as
    at most ``at_once`` links are open, a size that fits any task, one task decides the rest in order, however long its chains are.
    """
    open_ = written(links.select("u", "v"))
    nodes = open_.select(F.explode(F.array("u", "v")).alias("record")).distinct()
    last = written(nodes.join(open_.select(F.col("v").alias("record")), "record", "left_anti").withColumn("kept", F.lit(True)))
    parts = [last]
    while True:
        marks = open_.join(last.select(F.col("record").alias("u"), "kept"), "u", "left").select("u", "v", "kept")
        if open_.limit(at_once + 1).count() <= at_once:
            parts.append(written(marks.coalesce(1).mapInArrow(_decided, "record long, kept boolean")))
            return reduce(DataFrame.unionByName, parts)
        state = marks.groupBy("v").agg(F.max(F.coalesce("kept", F.lit(False))).alias("hit"), F.count_if(F.col("kept").isNull()).alias("unknown"))
        last = written(state.where("hit or unknown = 0").select(F.col("v").alias("record"), (~F.col("hit")).alias("kept")))
        parts.append(last)
        # links from dropped records no longer matter, nor do links to records that are decided now
        left = marks.where("kept is null").select("u", "v").join(last.select(F.col("record").alias("v")), "v", "left_anti")
        open_ = written(left)


def matches(found: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record, near_match, near_similarity) of near duplicates; all sketches; (v, u) candidates, for statistics.

    Records of one shingle set are reduced to the first of them before any join, so a bucket holds different sets only.
    """
    sets = written(sketches(found, policy))
    some = sets.where(F.size("shingles") > 0)
    firsts = some.groupBy("set_key").agg(F.min("record").alias("first"))
    named = some.join(firsts, "set_key").select("record", "first", "shingles", "bands")
    reps = written(named.where("record = first").select("record", "shingles", "bands"))
    pairs = written(candidates(reps, policy.near_duplicate_threshold))
    links = written(verified(pairs, reps, policy.near_duplicate_threshold))
    kept = greedy(links)
    ends = links.join(kept.where("kept").select(F.col("record").alias("u")), "u").join(kept.where("not kept").select(F.col("record").alias("v")), "v")
    of_reps = ends.groupBy("v").agg(F.min("u").alias("near_match"), F.min_by("similarity", "u").alias("near_similarity"))
    of_all = named.select("record", "first").join(of_reps.withColumnRenamed("v", "first"), "first", "left")
    copies = F.when((F.col("record") > F.col("first")) & F.col("near_match").isNull(), F.col("first")).otherwise(F.col("near_match"))
    similar = F.when((F.col("record") > F.col("first")) & F.col("near_match").isNull(), 1.0).otherwise(F.col("near_similarity"))
    return of_all.select("record", copies.alias("near_match"), similar.alias("near_similarity")).where("near_match is not null"), sets, pairs


def comparisons(matched: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(comparisons): over all records, the kept candidates below each, up to its match.

    Counted for the first record of each shingle set; its copies look at the same candidates, and at the first one if that was kept.
    """
    near = matched.select("record", "near_match")
    counts = sets.where(F.size("shingles") > 0).groupBy("set_key").agg(F.min("record").alias("v"), F.count("*").alias("n"))
    kept_u = pairs.join(near.select(F.col("record").alias("u")), "u", "left_anti")
    firsts = counts.join(near.withColumnRenamed("record", "v"), "v", "left").select("v", "n", "near_match")
    looked = kept_u.join(firsts, "v").where("near_match is null or u <= near_match").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("looked"))
    own = firsts.where("near_match is null").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("own"))
    return looked.join(own).select((F.col("looked") + F.col("own")).alias("comparisons"))  # one row each


def marked(found: DataFrame, matched: DataFrame, policy: Policy) -> DataFrame:
    """Findings with ``near_duplicate`` appended."""
    finding = F.struct(
        F.lit("near_duplicate").alias("code"),
        F.lit("reject").alias("action"),
        F.concat(F.lit("The record is near-duplicate of retained record "), F.col("near_match").cast("string"), F.lit(".")).alias("message"),
        F.col("near_similarity").cast("double").alias("value"),
        F.lit(policy.near_duplicate_threshold).cast("double").alias("threshold"),
        F.lit(None).cast("string").alias("threshold_label"),
    )
    joined = found.join(matched, "record", "left")
    return joined.withColumn("findings", F.when(F.col("near_match").isNull(), F.col("findings")).otherwise(F.array_append("findings", finding)))
