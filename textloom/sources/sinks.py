"""Outputs of a run. Corpus outputs are folders of part files in record order; reports are single files written by the driver."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes whose value and threshold are whole numbers.
WHOLE = ("too_short", "too_long", "boilerplate", "character_spam", "word_spam", "exact_duplicate")


def guard(paths: list[Path], force: bool) -> None:
    """Refuse to overwrite any output unless forced."""
    if not force and (there := [str(p) for p in paths if p.exists()]):
        raise ValueError(f"refusing to overwrite existing outputs: {', '.join(there)}")


def rewrite_udf(field: str):
    """The raw JSON line with only its text replaced; the order of its keys and other values stay."""

    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raws, texts in batches:
            out = []
            for raw, text in zip(raws, texts):
                if raw is None or text is None:
                    out.append(None)
                    continue
                value = json.loads(raw)
                value[field] = text
                line = json.dumps(value, ensure_ascii=False)
                out.append(line if line.isprintable() or not any("\ud800" <= c <= "\udfff" for c in line) else json.dumps(value))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(rewrite, T.StringType())


def cleaned_lines(records: DataFrame, kind: str, text_field: str = "text") -> DataFrame:
    """(record, value): one line for each kept record."""
    kept = records.where(~F.col("rejected"))
    if kind == "jsonl":
        return kept.select("record", rewrite_udf(text_field)("raw", "output").alias("value"))
    return kept.select("record", F.col("output").alias("value"))


def finding_dict(finding: dict[str, Any]) -> dict[str, Any]:
    """A finding without nulls; whole numbers stay whole, ratios have four digits."""
    whole = finding["code"] in WHOLE
    number = lambda x: None if x is None else int(x) if whole else round(x, 4)
    found = {"code": finding["code"], "action": finding["action"], "message": finding["message"]}
    found |= {"value": number(finding["value"]), "threshold": finding["threshold_label"] or number(finding["threshold"])}
    return {k: v for k, v in found.items() if v is not None}


def _rejected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = batch.to_pydict()
        out = [json.dumps({"record": n, "text": t, "findings": [finding_dict(x) for x in f]}, ensure_ascii=False) for n, t, f in zip(got["record"], got["norm"], got["findings"])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["record", "value"])


def rejected_lines(records: DataFrame) -> DataFrame:
    """(record, value): rejected records with their normalized, unmasked text and all findings."""
    return records.where("rejected").select("record", "norm", "findings").mapInArrow(_rejected, "record long, value string")


def write_lines(lines: DataFrame, path: Path, force: bool) -> None:
    """Part files in record order: ranges of records are sorted apart, never the whole in one task."""
    ordered = lines.repartitionByRange("record").sortWithinPartitions("record").select("value")
    ordered.write.mode("overwrite" if force else "errorifexists").text(str(path))


def write_json(value: dict[str, Any], path: Path) -> None:
    path.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def html_report(report: dict[str, Any]) -> str:
    """A page of its own, without scripts; all text is escaped."""
    e = lambda x: html.escape(str(x))

    def rows(title: str, items: dict[str, Any]) -> str:
        body = "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in items.items())
        return f"<section><h2>{e(title)}</h2><table>{body or '<tr><td>none</td></tr>'}</table></section>"

    keys = ("records_read", "records_kept", "records_rejected", "records_transformed", "characters_read", "bytes_read", "emails_masked", "phone_numbers_masked", "reconciliation_ok", "elapsed_seconds")
    parts = [
        rows("Summary", {k: report[k] for k in keys}),
        rows("Profile", report["profile_details"]),
        rows("Findings", report["findings_by_code"]),
        rows("Actions", report["action_counts"]),
        rows("Scripts", report["script_totals"]),
        rows("Script ratios", report["script_ratio_buckets"]),
        rows("Threshold preview", {k: f"{v['records_below']} ({v['percentage']} %)" for k, v in report["script_threshold_preview"].items()}),
        rows("Deduplication", report["deduplication_statistics"]),
        rows("Lengths", report["length_statistics"]),
    ]
    for code, found in report["examples_by_code"].items():
        cards = "".join(f"<article><b>record {e(x['record'])}</b><p>{e(x['text'])}</p><code>{e(json.dumps(x['finding'], ensure_ascii=False))}</code></article>" for x in found)
        parts.append(f"<section><h2>Examples: {e(code)}</h2>{cards}</section>")
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}th,td{border:1px solid #ccc;padding:.2em .6em;text-align:left}article{border-left:3px solid #88a;margin:.6em 0;padding-left:.8em}"
    title = e(f"{report['command']}: {report['input_path']}")
    return f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{title}</title><style>{style}</style></head><body><h1>{title}</h1>{''.join(parts)}</body></html>\n"
