"""The rules of a policy as columns: signals of each record, and the findings that they give, in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..policy import Policy
from ..profiles import Profile


@dataclass(frozen=True)
class Rule:
    """One finding code: when it fires, with what value against which threshold. Users may append their own."""

    code: str
    action: str
    message: Column | str
    when: Column
    value: Column | None = None
    threshold: float | None = None
    on_empty: bool = False

    def finding(self) -> Column:
        message = self.message if isinstance(self.message, Column) else F.lit(self.message)
        made = F.struct(
            F.lit(self.code).alias("code"),
            F.lit(self.action).alias("action"),
            message.alias("message"),
            (F.lit(None) if self.value is None else self.value).cast("double").alias("value"),
            F.lit(self.threshold).cast("double").alias("threshold"),
            F.lit(None).cast("string").alias("threshold_label"),
        )
        return F.when(self.when if self.on_empty else (F.col("norm") != "") & self.when, made)


def normalized(records: DataFrame) -> DataFrame:
    """Records with ``norm`` and ``folded``. A null text counts as empty."""
    return records.withColumn("_forms", X.forms(F.col("text"))).withColumns({"norm": F.col("_forms.norm"), "folded": F.col("_forms.folded")}).drop("_forms")


def signals(records: DataFrame, profile: Profile, policy: Policy) -> DataFrame:
    """Normalized records with every number that a rule needs, each computed once."""
    norm, folded = F.col("norm"), F.col("folded")
    out = normalized(records).withColumns({"_r": X.measures_udf(norm, folded), "characters": F.length(norm)})
    out = out.withColumns({name: F.col(f"_r.{name}") for name in X.MEASURES.fieldNames()}).drop("_r")
    allowed = profile.targets + tuple(s for s in profile.secondary if s not in profile.targets)
    letters = F.aggregate(F.map_values("scripts"), F.lit(0).cast("long"), lambda a, b: a + b)
    # a share of what is unexpected, counted as such: one minus a share would round differently
    unexpected = F.aggregate(F.map_values(F.map_filter("scripts", lambda k, _: ~k.isin(list(allowed)))), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.withColumns(
        {
            "script_ratio": X.share(F.col("scripts"), profile.targets) if profile.targets else F.lit(None).cast("double"),
            "unexpected_ratio": F.when(letters == 0, 0.0).otherwise(unexpected / F.nullif(letters, F.lit(0))),
            "symbol_ratio": X.symbol_ratio(norm),
            "markers": X.marker_count(folded, profile),
            "url_count": F.size(X.urls(norm)),
            "url_ratio": X.url_ratio(norm),
            "character_run": X.longest_character_run(norm, policy.repeated_character_run),
            "repeated_ratio": F.when(F.col("words") == 0, 0.0).otherwise((F.col("words") - F.col("distinct_words")) / F.nullif(F.col("words"), F.lit(0))),
            "unique_trigram_ratio": F.when(F.col("trigrams") == 0, 1.0).otherwise(F.col("distinct_trigrams") / F.nullif(F.col("trigrams"), F.lit(0))),
        }
    )


def rules(profile: Profile, policy: Policy) -> list[Rule]:
    """The stateless rules, in the order in which findings are given."""
    c, norm = F.col, F.col("norm")
    phone = F.lit(False)
    for pattern in profile.phones:
        phone = phone | norm.rlike(pattern)
    found = [
        Rule("malformed_record", "reject", F.col("source_error"), F.coalesce(c("source_error"), F.lit("")) != "", on_empty=True),
        Rule("empty", "reject", "The normalized record is empty.", norm == "", on_empty=True),
        Rule("too_short", "reject", "The record is shorter than the configured minimum.", c("characters") < policy.min_characters, c("characters"), policy.min_characters),
        Rule("too_long", "reject", "The record exceeds the configured maximum.", c("characters") > policy.max_characters, c("characters"), policy.max_characters),
    ]
    if profile.targets and policy.min_script_ratio is not None:
        names = ", ".join(profile.targets)
        found.append(Rule("low_target_script_ratio", policy.low_script_action, f"Too little text uses the expected {names} script.", c("script_ratio") < policy.min_script_ratio, c("script_ratio"), policy.min_script_ratio))
    if profile.targets:
        message = "Too much text uses scripts outside the profile's target and allowed-secondary scripts."
        found.append(Rule("unexpected_script_ratio", "flag", message, c("unexpected_ratio") > policy.max_unexpected_script_ratio, c("unexpected_ratio"), policy.max_unexpected_script_ratio))
    long_enough = c("words") >= 20
    found += [
        Rule("high_symbol_ratio", "reject", "Punctuation and symbols dominate the record.", (c("characters") >= 50) & (c("symbol_ratio") > policy.max_symbol_ratio), c("symbol_ratio"), policy.max_symbol_ratio),
        Rule("broken_encoding", "reject", "The record contains replacement characters or common mojibake sequences.", norm.rlike(X.MOJIBAKE)),
        Rule("boilerplate", "reject", "The record contains multiple webpage boilerplate markers.", c("markers") >= 2, c("markers"), 2),
        Rule("url_spam", "reject", "URLs occupy too much of the record.", (c("url_count") >= 5) | ((c("url_count") > 0) & (c("url_ratio") > policy.max_url_ratio)), c("url_ratio"), policy.max_url_ratio),
        Rule("character_spam", "reject", "A single character repeats pathologically.", (c("characters") >= 20) & (c("character_run") > 0) & (c("character_run") / F.nullif(c("characters"), F.lit(0)) >= 0.10), c("character_run"), policy.repeated_character_run),
        Rule("word_spam", "reject", "The same word repeats consecutively.", c("longest_run") >= policy.consecutive_word_run, c("longest_run"), policy.consecutive_word_run),
        Rule("high_word_repetition", "reject", "Most words are repetitions.", long_enough & (c("repeated_ratio") >= policy.max_repeated_word_ratio), c("repeated_ratio"), policy.max_repeated_word_ratio),
        Rule("repeated_ngram", "reject", "The record repeats the same word sequences.", long_enough & (c("trigrams") >= 20) & (c("unique_trigram_ratio") < policy.min_unique_trigram_ratio), c("unique_trigram_ratio"), policy.min_unique_trigram_ratio),
    ]
    if policy.mask_pii:
        found += [
            Rule("email_detected", "transform", "Email addresses will be masked.", X.has_email(norm)),
            Rule("phone_detected", "transform", "Phone numbers will be masked.", phone),
        ]
    return found


def findings(signalled: DataFrame, profile: Profile, policy: Policy, extra: Sequence[Rule] = ()) -> DataFrame:
    """Records with signals, and ``findings`` of all stateless rules."""
    return signalled.withColumn("findings", F.array_compact(F.array(*(rule.finding() for rule in [*rules(profile, policy), *extra]))))


def rejected() -> Column:
    """Whether any finding of a record rejects it."""
    return F.exists("findings", lambda f: f["action"] == "reject")
