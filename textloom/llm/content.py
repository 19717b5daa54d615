"""Copies hidden by formatting: one record per content, with the number of its copies.

Each text is brought to its letters, marks and digits (case, whitespace, punctuation and field order ignored) and hashed to
128 bits plus an independent 64-bit check. Counting groups by hash and check together, so a collision of the 128-bit hash
cannot merge two contents; ``collisions`` reports how many such hashes there were. Counts combine before the shuffle, so a content
that makes up a third of all rows is a few partial rows per task.

Defined cases: null texts and texts whose content has under ``min_length`` letters belong to no group; copies of one text count each; a group's first
record is its smallest id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import content
from ..session import spread, written

MIN_LENGTH = 20
#: A group is hot from this many rows, or from this share of all rows, if that is more: at most HOT_SHARE hot groups exist.
HOT_ROWS, HOT_SHARE = 20_000, 2_000


def hashed(text: str) -> tuple[bytes, int, int]:
    """(hash, check, length) of a text's content."""
    data = content(text)
    raw = data.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_128_digest(raw), xxhash.xxh64_intdigest(raw, 7) - (1 << 63), len(data)


def _keyed(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and (got := hashed(text))[2] >= min_length:
                    rows.append((at, got[0], got[1]))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()))], names=["id", "hash", "check"])

    return run


def keyed(df: DataFrame, id_col: str, text_col: str, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, hash, check) of each text of at least ``min_length`` letters, marks and digits."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_keyed(min_length), "id long, hash binary, check long")


def groups(keys: DataFrame) -> DataFrame:
    """(hash, check, first, copies): one row for each content."""
    return keys.groupBy("hash", "check").agg(F.min("id").alias("first"), F.count("*").alias("copies"))


def collisions(counted: DataFrame) -> DataFrame:
    """(hash, contents): the 128-bit hashes that more than one content shares."""
    return counted.groupBy("hash").agg(F.count("*").alias("contents")).where("contents > 1")


def unique_records(df: DataFrame, id_col: str = "record", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(first_record, copies): one record for each content, with the number of its copies."""
    return groups(keyed(df, id_col, text_col, min_length)).select(F.col("first").alias("first_record"), "copies")


def copies(df: DataFrame, id_col: str = "record", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(first_record, record): each record that isn't the smallest of its group, with the smallest.

    The groups of several records are joined back to the keys. Hot groups, of which there are at most ``HOT_SHARE``, are
    broadcast, so their rows never meet in one task; all others are joined by shuffle.
    """
    keys = written(keyed(df, id_col, text_col, min_length))
    several = written(groups(keys).where("copies > 1"))
    hot_from = max(HOT_ROWS, -(-keys.count() // HOT_SHARE))
    hot = F.broadcast(several.where(F.col("copies") >= hot_from)).select("hash", "check", "first")
    marked = keys.join(hot, ["hash", "check"], "left")
    cold = several.where(F.col("copies") < hot_from).select("hash", "check", F.col("first").alias("cold_first"))
    rest = marked.where("first is null").drop("first").join(cold, ["hash", "check"]).withColumnRenamed("cold_first", "first")
    found = marked.where("first is not null").unionByName(rest)
    return found.where("id <> first").select(F.col("first").alias("first_record"), F.col("id").alias("record"))
