"""The rules on a stream: stateless rules run unchanged; exact duplicates keep the first arrival of each text in state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask
from ..operators.decide import KEPT_COLUMNS
from ..operators.rules import findings, rejected, signals
from ..policy import Policy
from ..profiles import Profile


def audited(stream: DataFrame, profile: Profile, policy: Policy, keep: tuple[str, ...] = ()) -> DataFrame:
    """A stream of records with stateless findings, decision and masked text; nothing is kept in state.

    ``keep``: further columns of the stream, such as its event time.
    """
    found = findings(signals(stream, profile, policy), profile, policy).select(*KEPT_COLUMNS, *keep).withColumn("rejected", rejected())
    kept = mask(F.col("norm"), profile)["masked"] if policy.mask_pii else F.col("norm")
    return found.withColumn("output", F.when(~F.col("rejected"), kept))


def first_arrivals(audited_stream: DataFrame, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """The kept records whose text has not arrived before; state holds one digest for each text.

    With ``event_time`` and ``within`` state is bounded: a copy that comes later than that counts as new.
    """
    keyed = audited_stream.where(~F.col("rejected")).withColumn("digest", F.sha2("norm", 256))
    if event_time and within:
        return keyed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["digest"])
    return keyed.dropDuplicates(["digest"])
