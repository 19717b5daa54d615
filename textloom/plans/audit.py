"""Queries of the audit's operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import near, summaries
from ..operators.decide import DECIDING, KEPT_COLUMNS, decided, stateless
from ..operators.rules import normalized, rejected, signals
from ..policy import Policy, resolved
from ..profiles import BOILERPLATE, OTHER, PROFILES, SCRIPT_RANGES
from ..session import shared_dir, spread, table, written
from ..sources import sinks
from ..sources.lines import from_table
from ..streaming.audit import audited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EN, EN_POLICY = resolved({"profile": "en"})[::-1]
NEAR_POLICY = resolved({"profile": "en", "near_dedup": True})[0]
GENERIC, GENERIC_POLICY = PROFILES["generic"], Policy()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its SQL if there is one."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "records"), "record", "text", "raw", "source_error", "byte_length")


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spread(documents(spark, sf_dir)), EN, EN_POLICY)


def judged(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = DECIDING) -> DataFrame:
    return decided(documents(spark, sf_dir), EN, EN_POLICY, keep=keep).records


# --- SQL building blocks -------------------------------------------------------------------------------------------
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _n(source: str = "documents", key: str = "doc_id", more: str = "") -> str:
    return f"n AS (SELECT {key} AS record, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '{SPACE}', ' ', 'g'), ' ') AS t{more} FROM {source})"


N = _n()
FOLD = "replace(replace(replace(replace(lower(t), 'ß', 'ss'), 'ς', 'σ'), 'µ', 'μ'), 'ſ', 's')"
WORDS = f"w AS (SELECT record, t, CASE WHEN t = '' THEN [] ELSE string_split({FOLD}, ' ') END AS ws FROM n)"
LETTERS = r"len(regexp_extract_all(t, '[\p{L}\p{M}]'))"
SYMBOL = r"CASE WHEN replace(t, ' ', '') = '' THEN 0.0 ELSE len(regexp_extract_all(t, '[\p{P}\p{S}]')) / length(replace(t, ' ', '')) END"
URLS = r"regexp_extract_all(t, '(?i)(?:https?://|www\.|[\p{L}\p{N}_]+\.(?:com|org|net|info|biz)\b)')"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def _between(name: str) -> str:
    return " OR ".join(f"u BETWEEN {low} AND {high}" for low, high in SCRIPT_RANGES[name])


SCRIPT = "CASE " + " ".join(f"WHEN {_between(name)} THEN '{name}'" for name in SCRIPT_RANGES) + f" ELSE '{OTHER}' END"
CHARS = r"c AS (SELECT record, unicode(unnest(regexp_extract_all(t, '[\p{L}\p{M}]'))) AS u FROM n), s AS (SELECT record, " + SCRIPT + " AS script FROM c)"
RATIO = f"r AS (SELECT n.record, coalesce(count(*) FILTER (WHERE script = 'Latin') / nullif(count(script), 0), 0.0) AS ratio, coalesce(count(*) FILTER (WHERE script <> 'Latin') / nullif(count(script), 0), 0.0) AS odd FROM n LEFT JOIN s USING (record) GROUP BY n.record)"
CHAR_RUN = "ch AS (SELECT record, unnest(regexp_extract_all(t, '(?s).')) AS c, generate_subscripts(regexp_extract_all(t, '(?s).'), 1) AS i FROM n), g AS (SELECT record, c, i - row_number() OVER (PARTITION BY record, c ORDER BY i) AS grp FROM ch), cr AS (SELECT record, max(k) AS run FROM (SELECT record, count(*) AS k FROM g GROUP BY record, c, grp) GROUP BY record)"
WORD_RUN = "wo AS (SELECT record, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w), wg AS (SELECT record, x, i - row_number() OVER (PARTITION BY record, x ORDER BY i) AS grp FROM wo), wr AS (SELECT record, max(k) AS run FROM (SELECT record, count(*) AS k FROM wg GROUP BY record, x, grp) GROUP BY record)"
TRI = "tg AS (SELECT record, len(ws) AS words, len(list_distinct(ws)) AS distinct_words, CASE WHEN len(ws) < 3 THEN 0 ELSE len(ws) - 2 END AS trigrams, CASE WHEN len(ws) < 3 THEN 0 ELSE len(list_distinct([ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] for k in range(1, len(ws) - 1)])) END AS distinct_trigrams FROM w)"
MARKERS = " + ".join(f"CASE WHEN contains({FOLD}, '{m}') THEN 1 ELSE 0 END" for m in BOILERPLATE)


def _codes(error: str = "NULL", latin: bool = True) -> str:
    """A CTE f(record, code, action, o): the stateless findings of documents under the profile en, or of records under generic."""
    scripts = (
        [("low_target_script_ratio", "flag", "t <> '' AND ratio < 0.5"), ("unexpected_script_ratio", "flag", "t <> '' AND odd > 0.1")]
        if latin
        else []
    )
    rules = [
        ("malformed_record", "reject", f"{error} IS NOT NULL"),
        ("empty", "reject", "t = ''"),
        ("too_short", "reject", "t <> '' AND length(t) < 5"),
        ("too_long", "reject", "length(t) > 100000"),
        *scripts,
        ("high_symbol_ratio", "reject", f"length(t) >= 50 AND {SYMBOL} > 0.4"),
        ("broken_encoding", "reject", "regexp_matches(t, '�|Ã.|Â.|â€|ðŸ')"),
        ("boilerplate", "reject", f"t <> '' AND {MARKERS} >= 2"),
        ("url_spam", "reject", f"t <> '' AND (len({URLS}) >= 5 OR (len({URLS}) > 0 AND list_sum([length(u) for u in {URLS}]) / length(t) > 0.3))"),
        ("character_spam", "reject", "length(t) >= 20 AND crun >= 15 AND crun / length(t) >= 0.1"),
        ("word_spam", "reject", "t <> '' AND wrun >= 5"),
        ("high_word_repetition", "reject", "t <> '' AND words >= 20 AND (words - distinct_words) / words >= 0.7"),
        ("repeated_ngram", "reject", "t <> '' AND words >= 20 AND trigrams >= 20 AND distinct_trigrams / trigrams < 0.35"),
        ("email_detected", "transform", f"regexp_matches(t, '{EMAIL}')"),
    ]
    listed = " UNION ALL ".join(f"SELECT record, t, '{code}' AS code, '{action}' AS action, {k} AS o FROM a WHERE {when}" for k, (code, action, when) in enumerate(rules))
    joins = "LEFT JOIN r USING (record) " if latin else ""
    ratios = f"{CHARS}, {RATIO}, " if latin else ""
    columns = "n.*, cr.run AS crun, wr.run AS wrun, tg.words, tg.distinct_words, tg.trigrams, tg.distinct_trigrams" + (", r.ratio, r.odd" if latin else "")
    return f"{WORDS}, {ratios}{CHAR_RUN}, {WORD_RUN}, {TRI}, a AS (SELECT {columns} FROM n LEFT JOIN cr USING (record) LEFT JOIN wr USING (record) LEFT JOIN tg USING (record) {joins}), f0 AS ({listed})"


def _decided(error: str = "NULL") -> str:
    """Adds x(record, first_record), and f with exact duplicates."""
    return (
        f"ok AS (SELECT record, t FROM n WHERE t <> '' AND {error} IS NULL AND record NOT IN (SELECT record FROM f0 WHERE action = 'reject')), "
        "x AS (SELECT record, first_record FROM (SELECT record, min(record) OVER (PARTITION BY sha256(t)) AS first_record FROM ok) WHERE record > first_record), "
        "f AS (SELECT record, code, action, o FROM f0 UNION ALL SELECT record, 'exact_duplicate', 'reject', 90 FROM x)"
    )


F_DOCS = f"WITH {N}, {_codes()}, {_decided()}"
RECORDS_N = _n("records", "record", ", raw, source_error")
F_RECORDS = f"WITH {RECORDS_N}, {_codes('source_error', False)}, {_decided('source_error')}"


# --- functions -----------------------------------------------------------------------------------------------------
@query(f"WITH {N} SELECT record, t AS norm, {FOLD} AS folded FROM n")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spread(documents(spark, sf_dir))).select("record", "norm", "folded")


@query(f"WITH {N}, {CHARS} SELECT record, script, count(*) AS characters FROM s GROUP BY record, script")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signalled(spark, sf_dir).select("record", F.explode("scripts").alias("script", "characters"))


@query(f"WITH {N}, {CHARS}, {RATIO} SELECT record, ratio AS script_ratio, odd AS unexpected_ratio FROM r")
def script_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signalled(spark, sf_dir).select("record", "script_ratio", "unexpected_ratio")


@query(f"WITH {N} SELECT record, {SYMBOL} AS symbol_ratio FROM n")
def symbol_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signalled(spark, sf_dir).select("record", "symbol_ratio")


@query(f"WITH {N}, {CHAR_RUN} SELECT n.record, CASE WHEN run >= 3 THEN run ELSE 0 END AS character_run FROM n LEFT JOIN cr USING (record)")
def character_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = X.longest_character_run(F.col("norm"), 3)
    return normalized(spread(documents(spark, sf_dir))).select("record", run.alias("character_run"))


@query(f"WITH {N}, {WORDS}, {WORD_RUN} SELECT n.record, coalesce(run, 0) AS word_run FROM n LEFT JOIN wr USING (record)")
def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signalled(spark, sf_dir).select("record", F.col("longest_run").alias("word_run"))


@query(f"WITH {N}, {WORDS}, {TRI} SELECT record, words, distinct_words, trigrams, distinct_trigrams FROM tg")
def word_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signalled(spark, sf_dir).select("record", "words", "distinct_words", "trigrams", "distinct_trigrams")


@query(f"WITH {N} SELECT record, {MARKERS} AS markers FROM n")
def boilerplate_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signalled(spark, sf_dir).select("record", "markers")


@query(f"WITH {N} SELECT record, len({URLS}) AS url_count, CASE WHEN t = '' THEN 0.0 ELSE coalesce(list_sum([length(u) for u in {URLS}]), 0) / length(t) END AS url_ratio FROM n")
def url_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signalled(spark, sf_dir).select("record", "url_count", "url_ratio")


@query(f"WITH {N} SELECT record FROM n WHERE regexp_matches(t, '�|Ã.|Â.|â€|ðŸ')")
def broken_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spread(documents(spark, sf_dir))).where(F.col("norm").rlike(X.MOJIBAKE)).select("record")


@query(f"WITH {N} SELECT record, regexp_replace(t, '{EMAIL}', '<EMAIL>', 'g') AS masked, len(regexp_extract_all(t, '{EMAIL}')) AS emails FROM n")
def email_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.mask(F.col("norm"), EN)
    return normalized(spread(documents(spark, sf_dir))).select("record", made["masked"].alias("masked"), made["emails"].alias("emails"))


ND = r"\p{Nd}"
#: The phone patterns of Bengali without the looks behind and ahead that RE2 lacks: (digits, number); the neighbours are matched and put back.
BN_PHONES = ((ND, rf"(?:\+?88)?01[3-9]{ND}{{8}}"), ("০-৯", r"(?:\+?৮৮)?০১[৩-৯][০-৯]{8}"), (ND, rf"(?:\+?91[- ]?)?[6-9]{ND}{{9}}"))


def _phones(text: str) -> str:
    """Each pattern twice, as one character between two numbers can be put back for one of them only."""
    for digit, number in BN_PHONES:
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^{digit}])(?:{number})($|[^{digit}])', '\\1<PHONE>\\2', 'g')"
    return text


MASKED_BN = f"m AS (SELECT record, e, {_phones('e')} AS masked FROM (SELECT record, regexp_replace(t, '{EMAIL}', '<EMAIL>', 'g') AS e FROM n))"
PHONES_FOUND = "(length(replace(masked, '<PHONE>', '<PHONE>.')) - length(masked) - length(replace(e, '<PHONE>', '<PHONE>.')) + length(e))"


@query(f"WITH {_n('records', 'record')}, {MASKED_BN} SELECT record, masked, {PHONES_FOUND} AS phones FROM m")
def phone_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.mask(F.col("norm"), PROFILES["bn"])
    return normalized(spread(records(spark, sf_dir))).select("record", made["masked"].alias("masked"), made["phones"].alias("phones"))


# --- rules and decisions -------------------------------------------------------------------------------------------
@query(f"WITH {N}, {_codes()} SELECT record, code, action FROM f0")
def stateless_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.exploded(stateless(documents(spark, sf_dir), EN, EN_POLICY, keep=DECIDING)).select("record", "code", "action")


@query(f"WITH {N} SELECT record, length(t) AS characters, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 5 THEN 'too_short' ELSE 'too_long' END AS code FROM n WHERE length(t) < 5 OR length(t) > 100000")
def length_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stateless(documents(spark, sf_dir), EN, EN_POLICY)
    codes = F.filter("findings", lambda f: f["code"].isin("empty", "too_short", "too_long"))
    return found.select("record", "characters", F.explode(codes).alias("f")).select("record", "characters", "f.code")


@query(f"{F_DOCS} SELECT record, first_record FROM x")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).where("first_record is not null").select("record", "first_record")


@query(f"{F_DOCS} SELECT code, count(*) AS findings FROM f GROUP BY code")
def findings_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.by_code(judged(spark, sf_dir)).select("code", "findings")


@query(f"{F_DOCS} SELECT action, count(*) AS findings FROM f GROUP BY action")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.by_action(judged(spark, sf_dir))


@query(f"{F_DOCS} SELECT code, rank, record, text FROM (SELECT code, row_number() OVER (PARTITION BY code ORDER BY record) AS rank, record, substr(n.t, 1, 500) AS text FROM f JOIN n USING (record)) WHERE rank <= 5")
def examples_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.examples(judged(spark, sf_dir), 5).select("code", "rank", "record", "text")


@query(f"WITH {N}, {CHARS} SELECT script, count(*) AS characters FROM s GROUP BY script")
def script_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.script_totals(signalled(spark, sf_dir))


@query(f"WITH {N}, {CHARS}, {RATIO} SELECT printf('%02d-%02d%%', least(100, (floor(ratio * 10)::INT + 1) * 10) - 10, least(100, (floor(ratio * 10)::INT + 1) * 10)) AS bucket, count(*) AS records FROM r GROUP BY bucket")
def script_ratio_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.ratio_buckets(signalled(spark, sf_dir))


@query(
    f"WITH {N}, {CHARS}, {RATIO}, k AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) "
    "SELECT threshold, count(*) FILTER (WHERE ratio < threshold) AS records_below, count(*) FILTER (WHERE ratio < threshold) / count(*) AS share_below FROM r, k GROUP BY threshold"
)
def script_threshold_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.threshold_preview(signalled(spark, sf_dir))


@query(
    f"WITH {N} SELECT count(*) AS count, min(length(t)) AS minimum, quantile_cont(length(t), 0.05) AS p05, quantile_cont(length(t), 0.5) AS median, quantile_cont(length(t), 0.95) AS p95, "
    "quantile_cont(length(t), 0.99) AS p99, max(length(t)) AS maximum, avg(length(t)) AS mean FROM n"
)
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalized(spread(documents(spark, sf_dir))).select(F.length("norm").alias("characters"))
    return summaries.lengths(found)


@query(
    f"{F_DOCS}, d AS (SELECT record, t, record NOT IN (SELECT record FROM f WHERE action = 'reject') AS kept, len(regexp_extract_all(t, '{EMAIL}')) AS e FROM n) "
    "SELECT count(*) AS records_read, count(*) FILTER (WHERE kept) AS records_kept, count(*) FILTER (WHERE NOT kept) AS records_rejected, count(*) FILTER (WHERE kept AND e > 0) AS records_transformed, "
    "sum(length(t))::BIGINT AS characters_read, coalesce(sum(e) FILTER (WHERE kept), 0)::BIGINT AS emails_masked FROM d"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.totals(judged(spark, sf_dir, KEPT_COLUMNS)).select("records_read", "records_kept", "records_rejected", "records_transformed", "characters_read", "emails_masked")


@query(f"{F_DOCS} SELECT record, regexp_replace(t, '{EMAIL}', '<EMAIL>', 'g') AS value FROM n WHERE record NOT IN (SELECT record FROM f WHERE action = 'reject')")
def cleaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.cleaned_lines(judged(spark, sf_dir), "txt")


@query(f"{F_DOCS} SELECT record, n.t AS text, string_agg(code, ',' ORDER BY o) AS codes FROM f JOIN n USING (record) GROUP BY record, n.t HAVING count(*) FILTER (WHERE action = 'reject') > 0")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).where("rejected")
    return rows.select("record", F.col("norm").alias("text"), F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


@query(f"{F_RECORDS} SELECT code, count(*) AS findings FROM f GROUP BY code")
def records_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.by_code(decided(records(spark, sf_dir), GENERIC, GENERIC_POLICY, keep=DECIDING).records).select("code", "findings")


@query()
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept JSON lines with their text replaced, every input's field by its own name."""
    inputs = table(spark, sf_dir, "inputs").where("input_format = 'jsonl' and text_field is not null").select("input_path", "text_field").distinct()
    rows = table(spark, sf_dir, "records").join(inputs, "input_path").where("raw is not null and source_error is null")
    fields = sorted(r.text_field for r in inputs.select("text_field").distinct().collect())  # names of fields: a few
    out = None
    for field in fields:
        made = decided(from_table(rows.where(F.col("text_field") == field), "record", "text", "raw", "source_error", "byte_length"), GENERIC, Policy(exact_dedup=False)).records
        one = sinks.cleaned_lines(made, "jsonl", field)
        out = one if out is None else out.unionByName(one)
    return out


# --- near duplicates -----------------------------------------------------------------------------------------------
NEAR_PAIRS = (
    f"WITH {N}, {_codes()}, tok AS (SELECT record, regexp_extract_all({FOLD}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS ws, replace({FOLD}, ' ', '') AS c FROM n WHERE t <> '' AND record NOT IN (SELECT record FROM f0 WHERE action = 'reject')), "
    "sh AS (SELECT record, list_sort(list_distinct(CASE WHEN len(ws) >= 3 THEN [ws[k] || '␟' || ws[k + 1] || '␟' || ws[k + 2] for k in range(1, len(ws) - 1)] ELSE [substr(c, k, 5) for k in range(1, length(c) - 3)] END)) AS s FROM tok), "
    "rep AS (SELECT min(record) AS record, s FROM sh WHERE len(s) > 0 GROUP BY s), e AS (SELECT record, len(s) AS size, unnest(s) AS x FROM rep), "
    "p AS (SELECT a.record AS u, b.record AS v, a.size AS n, b.size AS m, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.record < b.record GROUP BY ALL) "
    "SELECT u, v, k / (n + m - k) AS similarity FROM p WHERE k / (n + m - k) >= 0.85"
)


@query(NEAR_PAIRS)
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified pairs of different shingle sets that share a band; the SQL compares all sets that share a shingle."""
    found = written(stateless(documents(spark, sf_dir), EN, NEAR_POLICY, keep=DECIDING))
    sets = written(near.sketches(found, NEAR_POLICY).where(F.size("shingles") > 0))
    firsts = sets.groupBy("set_key").agg(F.min("record").alias("record"))
    reps = written(sets.join(firsts.select("record"), "record").select("record", "shingles", "bands"))
    return near.verified(near.candidates(reps, NEAR_POLICY.near_duplicate_threshold), reps, NEAR_POLICY.near_duplicate_threshold)


NEAR_DUPLICATES = (
    NEAR_PAIRS.split(", rep AS")[0].replace("FROM f0 WHERE action = 'reject'))", "FROM f WHERE action = 'reject'))").replace(", tok AS", f", {_decided()}, tok AS", 1).replace("WITH ", "WITH RECURSIVE ", 1)
    + ", named AS (SELECT record, s, min(record) OVER (PARTITION BY s) AS first FROM sh WHERE len(s) > 0), e AS (SELECT record, len(s) AS size, unnest(s) AS x FROM named WHERE record = first), "
    "p AS (SELECT a.record AS u, b.record AS v, a.size AS n, b.size AS m, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.record < b.record GROUP BY ALL), "
    "l AS (SELECT u, v, k / (n + m - k) AS similarity FROM p WHERE k / (n + m - k) >= 0.85), nodes AS (SELECT u AS r FROM l UNION SELECT v FROM l), "
    "o AS (SELECT r, list(u) FILTER (WHERE u IS NOT NULL) AS us, row_number() OVER (ORDER BY r) AS k FROM nodes LEFT JOIN l ON v = r GROUP BY r), "
    "steps AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT steps.k + 1, CASE WHEN list_has_any(kept, coalesce(us, [])) THEN kept ELSE list_append(kept, r) END FROM steps JOIN o ON o.k = steps.k + 1), "
    "alive AS (SELECT unnest(kept) AS r FROM (SELECT kept FROM steps ORDER BY k DESC LIMIT 1)), "
    "d AS (SELECT v, min(u) AS near_match, arg_min(similarity, u) AS near_similarity FROM l JOIN alive ON r = u WHERE v NOT IN (SELECT r FROM alive) GROUP BY v) "
    "SELECT record, coalesce(near_match, first) AS near_match, coalesce(near_similarity, 1.0) AS near_similarity FROM named LEFT JOIN d ON v = first WHERE near_match IS NOT NULL OR record > first"
)


@query(NEAR_DUPLICATES)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decided(documents(spark, sf_dir), EN, NEAR_POLICY, keep=DECIDING)
    return made.records.where("near_match is not null").select("record", "near_match", "near_similarity")


# --- further rules and counters --------------------------------------------------------------------------------------
TIGHT = Policy(max_characters=200, repeated_character_run=3, exact_dedup=False)


@query(
    f"WITH {RECORDS_N}, {CHAR_RUN} SELECT record, 'too_long' AS code, length(t)::DOUBLE AS value FROM n WHERE length(t) > 200 "
    "UNION ALL SELECT record, 'character_spam', run FROM n JOIN cr USING (record) WHERE length(t) >= 20 AND run >= 3 AND run / length(t) >= 0.1"
)
def tight_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a strict policy: long texts, and those with a long run of one character."""
    found = summaries.exploded(stateless(records(spark, sf_dir), GENERIC, TIGHT, keep=DECIDING))
    return found.where(F.col("code").isin("too_long", "character_spam")).select("record", "code", "value")


@query(f"WITH {_n('records', 'record')} SELECT record FROM n WHERE t <> '' AND (" + " OR ".join(f"regexp_matches(t, '(^|[^{digit}])(?:{number})($|[^{digit}])')" for digit, number in BN_PHONES) + ")")
def phone_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy, profile = resolved({"profile": "bn"})
    return summaries.exploded(stateless(records(spark, sf_dir), profile, policy, keep=DECIDING)).where("code = 'phone_detected'").select("record")


@query(f"{F_DOCS} SELECT (SELECT count(*) FROM ok) - (SELECT count(*) FROM x) AS indexed, (SELECT count(*) FROM x) AS removed")
def exact_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the exact deduplication holds, and copies that it removes."""
    stateless_reject = F.exists("findings", lambda f: (f["action"] == "reject") & (f["code"] != "exact_duplicate"))
    open_ = (F.col("norm") != "") & F.col("source_error").isNull() & ~stateless_reject
    return judged(spark, sf_dir).agg(F.count_if(open_ & F.col("first_record").isNull()).alias("indexed"), F.count("first_record").alias("removed"))


@query(
    f"WITH {_n('records', 'record', ', raw, source_error, input_path')}, {_codes('source_error', False)} SELECT n.record, regexp_replace(n.t, '{EMAIL}', '<EMAIL>', 'g') AS text, len(json_keys(n.raw)) AS keys "
    "FROM n JOIN (SELECT DISTINCT input_path FROM inputs WHERE input_format = 'jsonl' AND text_field IS NOT NULL) USING (input_path) "
    "WHERE n.raw IS NOT NULL AND n.source_error IS NULL AND n.record NOT IN (SELECT record FROM f0 WHERE action = 'reject')"
)
def jsonl_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept JSON lines of ``jsonl_roundtrip`` read again: their text, and how many keys they have."""
    lines = jsonl_roundtrip(spark, sf_dir).join(table(spark, sf_dir, "records").select("record", "input_path"), "record")
    fields = table(spark, sf_dir, "inputs").groupBy("input_path").agg(F.first("text_field").alias("field"))
    read = lines.join(fields, "input_path").withColumn("object", F.from_json("value", "map<string,string>"))
    return read.select("record", F.element_at("object", F.col("field")).alias("text"), F.size("object").cast("long").alias("keys"))


# --- streams -------------------------------------------------------------------------------------------------------
@query(f"WITH {N}, {_codes()} SELECT code, count(*) AS findings FROM f0 GROUP BY code")
def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateless findings of a stream over the documents, written by a streaming sink and counted."""
    source = table(spark, sf_dir, "documents")
    reader = spark.readStream.schema(source.schema)
    if Path(f"{sf_dir}/documents.parquet").is_file():  # a stream watches folders
        rows = reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    else:
        rows = reader.parquet(f"{sf_dir}/documents.parquet")
    stream = from_table(rows, "doc_id", "text")
    out = f"{shared_dir(spark)}/stream-{spark.sql('select uuid()').first()[0]}"
    run = audited(stream, EN, EN_POLICY).select("record", "norm", "findings").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    return summaries.by_code(spark.read.parquet(f"{out}/rows")).select("code", "findings")
