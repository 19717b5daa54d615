"""One run over a corpus: analyze reports what a policy would do, clean does it."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import near, summaries
from .operators.decide import decided
from .operators.rules import Rule
from .policy import Policy
from .profiles import Profile
from .session import WRITTEN, purge, written
from .sources import lines, sinks


def summarized(records: DataFrame, policy: Policy) -> dict[str, Any]:
    """The counts and distributions of a report; every collected result has a bounded number of rows."""
    report = summaries.totals(records).first().asDict()
    codes = sorted(summaries.by_code(records).collect(), key=lambda r: (-r.findings, r.first_record, r.first_at))
    report["findings_by_code"] = {r.code: r.findings for r in codes}
    report["action_counts"] = {r.action: r.findings for r in sorted(summaries.by_action(records).collect(), key=lambda r: r.action)}
    report["script_totals"] = {r.script: r.characters for r in sorted(summaries.script_totals(records).collect(), key=lambda r: (-r.characters, r.script))}
    report["script_ratio_buckets"] = {r.bucket: r.records for r in sorted(summaries.ratio_buckets(records).collect())}
    preview = sorted(summaries.threshold_preview(records).collect())
    report["script_threshold_preview"] = {f"{r.threshold:.2f}": {"records_below": r.records_below, "percentage": round(r.share_below * 100, 3)} for r in preview}
    n = summaries.lengths(records).first()
    names = (("minimum", "minimum"), ("p05", "p05_approx"), ("median", "median_approx"), ("p95", "p95_approx"), ("p99", "p99_approx"), ("maximum", "maximum"), ("mean", "mean"))
    report["length_statistics"] = {"count": n["count"]} | ({name: round(n[key], 2) for key, name in names} | {"quantile_sample_size": n["count"]} if n["count"] else {})
    report["examples_by_code"] = {r.code: [] for r in codes}
    if policy.sample_limit:
        for r in sorted(summaries.examples(records, policy.sample_limit).collect(), key=lambda r: (r.code, r["rank"])):
            report["examples_by_code"][r.code].append({"record": r.record, "text": r.text, "finding": sinks.finding_dict(r.asDict())})
    report["reconciliation_ok"] = report["records_read"] == report["records_kept"] + report["records_rejected"]
    return report


def run_audit(
    spark: SparkSession,
    path: str,
    output_dir: str | Path,
    command: str,
    policy: Policy,
    profile: Profile,
    input_format: str = "auto",
    text_field: str = "text",
    max_records: int | None = None,
    force: bool = False,
    rules: Sequence[Rule] = (),
    progress: Callable[[str], None] = lambda stage: None,
) -> dict[str, Any]:
    """Run over a line file and write the reports, and for ``clean`` the kept and rejected records; returns the report."""
    if command not in ("analyze", "clean"):
        raise ValueError("the command must be analyze or clean")
    began, out = time.perf_counter(), Path(output_dir)
    kind = lines.infer_format(path, input_format)
    cleaned, rejected = out / f"cleaned.{kind}", out / "rejected.jsonl"
    files = {"json_report": out / "report.json", "html_report": out / "report.html", "resolved_policy": out / "resolved-policy.json"}
    if command == "clean":
        files |= {"cleaned_corpus": cleaned, "rejected_records": rejected}
    sinks.guard(list(files.values()), force)
    out.mkdir(parents=True, exist_ok=True)
    progress("deciding")
    tables = len(WRITTEN)
    made = decided(lines.read_lines(spark, path, kind, text_field, max_records), profile, policy, rules)
    records = written(made.records)
    progress("summarizing")
    local = Path(path.removeprefix("file://"))
    report: dict[str, Any] = {
        "command": command,
        "input_path": path,
        "input_format": kind,
        "input_compression": lines.compression(path),
        "source_file_bytes": local.stat().st_size if local.is_file() else 0,
        "policy": policy.to_dict(),
        "profile_details": {"name": profile.name, "target_scripts": list(profile.targets), "allowed_secondary_scripts": list(profile.secondary)},
    }
    report |= summarized(records, policy)
    report["deduplication_statistics"] = deduplication(records, made, policy)
    if command == "clean":
        progress("writing")
        sinks.write_lines(sinks.cleaned_lines(records, kind, text_field), cleaned, force)
        sinks.write_lines(sinks.rejected_lines(records), rejected, force)
    seconds = time.perf_counter() - began
    report |= {"elapsed_seconds": round(seconds, 3), "throughput_records_per_second": round(report["records_read"] / seconds, 2), "outputs": {k: str(v) for k, v in files.items()}}
    purge(spark, tables)
    sinks.write_json(policy.to_dict(), files["resolved_policy"])
    sinks.write_json(report, files["json_report"])
    files["html_report"].write_text(sinks.html_report(report), encoding="utf-8")
    return report


def deduplication(records: DataFrame, made: Any, policy: Policy) -> dict[str, Any]:
    """Counters of both deduplications, with their parameters."""
    stats: dict[str, Any] = {"exact_dedup_enabled": int(policy.exact_dedup), "near_dedup_enabled": int(policy.near_dedup)}
    stateless = ~F.exists("findings", lambda f: (f["action"] == "reject") & ~f["code"].isin("exact_duplicate", "near_duplicate"))
    open_ = (F.col("norm") != "") & F.col("source_error").isNull() & stateless
    if policy.exact_dedup:
        row = records.agg(F.count_if(open_ & F.col("first_record").isNull()).alias("indexed"), F.count("first_record").alias("removed")).first()
        stats |= {"exact_documents_indexed": row.indexed, "exact_duplicates_removed": row.removed}
    if policy.near_dedup:
        row = made.sketches.agg(F.count("*").alias("all"), F.count_if(F.size("shingles") == 0).alias("without")).first()
        removed = made.matched.count()
        stats |= {
            "near_documents_indexed": row["all"] - row["without"] - removed,
            "near_documents_without_shingles": row["without"],
            "near_candidate_comparisons": near.comparisons(made.matched, made.sketches, made.pairs).first()[0],
            "near_duplicates_removed": removed,
            "near_threshold": policy.near_duplicate_threshold,
            "near_shingle_size": policy.shingle_size,
            "lsh_bands": policy.lsh_bands,
            "lsh_rows": policy.lsh_rows,
            "lsh_signature_values": policy.lsh_bands * policy.lsh_rows,
            "max_lsh_candidates_per_record": policy.max_lsh_candidates,
        }
    return stats
