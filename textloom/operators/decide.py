"""Decisions of a run: all findings of each record, whether it is kept, and its masked text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask
from ..policy import Policy
from ..profiles import Profile
from ..session import spread, written
from . import exact, near
from .rules import Rule, findings, rejected, signals

#: What decisions need of a record, and what a whole run keeps of it.
DECIDING = ("record", "source_error", "norm", "findings")
KEPT_COLUMNS = ("record", "raw", "byte_length", "source_error", "norm", "characters", "scripts", "script_ratio", "findings")


@dataclass(frozen=True)
class Decided:
    """Decided records; sketches and candidate pairs where near deduplication ran."""

    records: DataFrame
    sketches: DataFrame | None = None
    matched: DataFrame | None = None
    pairs: DataFrame | None = None


def stateless(records: DataFrame, profile: Profile, policy: Policy, extra: Sequence[Rule] = (), keep: Sequence[str] = KEPT_COLUMNS) -> DataFrame:
    """Records with the findings of the stateless rules; no shuffle but one that spreads a scan of few partitions."""
    return findings(signals(spread(records), profile, policy), profile, policy, extra).select(*keep)


def decided(records: DataFrame, profile: Profile, policy: Policy, extra: Sequence[Rule] = (), keep: Sequence[str] = KEPT_COLUMNS) -> Decided:
    """Decide all records. The stateless findings are written once, with the columns to ``keep`` (``DECIDING`` at least), and read by each later stage with those that it needs."""
    found = stateless(records, profile, policy, extra, keep)
    sets = matched = pairs = None
    if policy.exact_dedup or policy.near_dedup:
        found = written(found)
    if policy.exact_dedup:
        found = exact.marked(found)
    else:
        found = found.withColumn("first_record", F.lit(None).cast("long"))
    if policy.near_dedup:
        matched, sets, pairs = near.matches(found, policy)
        matched = written(matched)
        found = near.marked(found, matched, policy)
    else:
        found = found.withColumns({"near_match": F.lit(None).cast("long"), "near_similarity": F.lit(None).cast("double")})
    found = found.withColumn("rejected", rejected())
    masked = mask(F.col("norm"), profile) if policy.mask_pii else F.struct(F.col("norm").alias("masked"), F.lit(0).alias("emails"), F.lit(0).alias("phones"))
    kept = ~F.col("rejected")
    found = found.withColumn("_m", F.when(kept, masked)).withColumns({"output": F.col("_m.masked"), "emails": F.coalesce("_m.emails", F.lit(0)), "phones": F.coalesce("_m.phones", F.lit(0))}).drop("_m")
    return Decided(found, sets, matched, pairs)
