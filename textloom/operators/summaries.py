"""Aggregates over decided records: counts, distributions, examples. Each result has a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ratio_bucket

THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def totals(records: DataFrame) -> DataFrame:
    """One row of counters: read, kept, rejected, transformed, masked, characters, bytes."""
    kept = ~F.col("rejected")
    return records.agg(
        F.count("*").alias("records_read"),
        F.count_if(kept).alias("records_kept"),
        F.count_if("rejected").alias("records_rejected"),
        F.count_if(kept & (F.col("emails") + F.col("phones") > 0)).alias("records_transformed"),
        F.coalesce(F.sum("characters"), F.lit(0)).alias("characters_read"),
        F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes_read"),
        F.coalesce(F.sum("emails"), F.lit(0)).alias("emails_masked"),
        F.coalesce(F.sum("phones"), F.lit(0)).alias("phone_numbers_masked"),
    )


def exploded(records: DataFrame) -> DataFrame:
    """One row for each finding.

    The outer form keeps the optimizer from pushing a filter on the array, and with it all rules a second time, below.
    """
    rows = records.select("record", "norm", F.posexplode_outer("findings").alias("at", "finding"))
    return rows.where("at is not null").select("record", "norm", "at", "finding.*")


def by_code(records: DataFrame) -> DataFrame:
    """(code, findings, first_record, first_at): counts, and where each code came first."""
    first = F.min(F.struct("record", "at"))
    return exploded(records).groupBy("code").agg(F.count("*").alias("findings"), first["record"].alias("first_record"), first["at"].alias("first_at"))


def by_action(records: DataFrame) -> DataFrame:
    return exploded(records).groupBy("action").agg(F.count("*").alias("findings"))


def script_totals(records: DataFrame) -> DataFrame:
    """(script, characters) over all records."""
    return records.select(F.explode("scripts").alias("script", "n")).groupBy("script").agg(F.sum("n").alias("characters"))


def ratio_buckets(records: DataFrame) -> DataFrame:
    """(bucket, records) over records with a ratio."""
    return records.where("script_ratio is not null").groupBy(ratio_bucket(F.col("script_ratio")).alias("bucket")).agg(F.count("*").alias("records"))


def threshold_preview(records: DataFrame) -> DataFrame:
    """(threshold, records_below, share_below): always nine rows, from one pass."""
    ratio = F.col("script_ratio")
    once = records.agg(F.count(ratio).alias("observed"), *(F.count_if(ratio < t).alias(f"t{k}") for k, t in enumerate(THRESHOLDS)))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("records_below")) for k, t in enumerate(THRESHOLDS)))
    share = F.when(F.col("observed") == 0, 0.0).otherwise(F.col("row.records_below") / F.nullif(F.col("observed"), F.lit(0)))
    return once.select("observed", F.explode(rows).alias("row")).select("row.*", share.alias("share_below"))


def lengths(records: DataFrame) -> DataFrame:
    """One row: count, extremes, mean and interpolated quantiles of lengths.

    Quantiles are exact: the aggregate holds one entry for each distinct length, of which there are few however many records.
    """
    n = F.col("characters")
    q = F.percentile(n, F.array(*map(F.lit, (0.05, 0.5, 0.95, 0.99))))
    return records.agg(F.count("*").alias("count"), F.min(n).alias("minimum"), F.max(n).alias("maximum"), F.avg(n).alias("mean"), q.alias("q")).select(
        "count", "minimum", F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), F.col("q")[3].alias("p99"), "maximum", "mean"
    )


def examples(records: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` findings of each code in record order, with the first 500 characters of the text.

    Codes are few and findings many: each partition keeps its own first ones, and only those meet in the final ranking.
    """
    rows = exploded(records).withColumn("part", F.spark_partition_id())
    local = Window.partitionBy("code", "part").orderBy("record", "at")
    whole = Window.partitionBy("code").orderBy("record", "at")
    few = rows.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= limit)
    ranked = few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= limit)
    return ranked.select("code", "rank", "record", F.substring("norm", 1, 500).alias("text"), "action", "message", "value", "threshold", "threshold_label")
