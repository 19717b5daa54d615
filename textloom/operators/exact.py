"""Exact duplicates: the first record of each normalized text among those not rejected so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import rejected


def eligible() -> Column:
    """Non-empty, readable and not rejected so far."""
    return (F.col("norm") != "") & F.col("source_error").isNull() & ~rejected()


def first_records(found: DataFrame) -> DataFrame:
    """(record, first_record) of the exact duplicates.

    Digests are counted with map-side combining; only digests that several records share are joined back, so a text that
    makes up a third of all rows costs one partial row for each task. The join back is skewed
    on such a text; adaptive execution splits it, as the side of the digests is one row for each.
    """
    keys = found.where(eligible()).select("record", F.sha2("norm", 256).alias("digest"))
    counted = keys.groupBy("digest").agg(F.min("record").alias("first_record"), F.count("*").alias("copies"))
    several = counted.where("copies > 1").select("digest", "first_record")
    return keys.join(several, "digest").where(F.col("record") > F.col("first_record")).select("record", "first_record")


def marked(found: DataFrame) -> DataFrame:
    """Findings with ``exact_duplicate`` appended to those of later copies.

    One shuffle by record brings the few duplicates back to the records; where they are small, Spark broadcasts them.
    """
    finding = F.struct(
        F.lit("exact_duplicate").alias("code"),
        F.lit("reject").alias("action"),
        F.lit("The normalized record was seen earlier.").alias("message"),
        F.col("first_record").cast("double").alias("value"),
        F.lit(None).cast("double").alias("threshold"),
        F.lit("first_record").alias("threshold_label"),
    )
    joined = found.join(first_records(found), "record", "left")
    return joined.withColumn("findings", F.when(F.col("first_record").isNull(), F.col("findings")).otherwise(F.array_append("findings", finding)))
