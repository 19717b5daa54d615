"""Queries of the operators for training data, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table, written
from . import bpe, content, lookalike, mixing, mojibake, near, oracles, pii, quality, repetition

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query by its function's name."""
    QUERIES[run.__name__] = run
    return run


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.copies(table(spark, sf_dir, "records"))


@query
def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.unique_records(table(spark, sf_dir, "records"))


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looks(table(spark, sf_dir, "documents"))


@query
def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.forms(table(spark, sf_dir, "documents"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.affected(table(spark, sf_dir, "records"))


@query
def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(table(spark, sf_dir, "records"), inputs=table(spark, sf_dir, "inputs"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_pairs(table(spark, sf_dir, "records"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf_dir, "records"), table(spark, sf_dir, "inputs"))


@query
def p3_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``p3_found`` and those that stand out from their language and source below its threshold."""
    return repetition.outliers(table(spark, sf_dir, "records"), table(spark, sf_dir, "inputs"))


@query
def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.shares(table(spark, sf_dir, "records"), min_words=1)


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.kinds(table(spark, sf_dir, "records"), table(spark, sf_dir, "common_words"), table(spark, sf_dir, "findings"))


@query
def p6_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "records"), table(spark, sf_dir, "common_words")).drop("kind")


@query
def p6_wrong_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``p6_found`` that an earlier measurement doesn't fit."""
    return p6_found(spark, sf_dir).where("kind = 'wrong_value'").select("record")


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


@query
def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target its share among the sources that have texts, whether that is reached but for what documents can't be cut, and whether none is used too often.

    The stretch of a source begins and ends within a document, so it is off by two documents at most.
    """
    targets = table(spark, sf_dir, "mix_targets")
    mixed = written(mixing.mix(table(spark, sf_dir, "documents"), targets))
    largest = mixed.groupBy("source").agg(F.max("tokens").alias("largest"))
    target = F.when(F.col("documents") > 0, F.col("target_share") / F.sum(F.when(F.col("documents") > 0, F.col("target_share"))).over(Window.partitionBy())).otherwise(0.0)
    found = mixing.shares(mixed, targets).withColumns({"wanted": target, "total": F.sum("tokens").over(Window.partitionBy())}).join(largest, "source", "left")  # a row for each target
    off = F.abs(F.col("tokens") - F.col("wanted") * F.col("total"))
    return found.select("source", F.round("wanted", 6).alias("wanted"), (off <= 2 * F.coalesce("largest", F.lit(0))).alias("reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.kinds(table(spark, sf_dir, "records"))


@query
def p7_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "records"))


ORACLES |= {"p1_found": oracles.P1_FOUND, "p1_copies": oracles.P1_COPIES, "p2_found": oracles.P2_FOUND, "p3_found": oracles.P3_FOUND, "p3_shares": oracles.P3_SHARES, "p6_statistics": oracles.P6_STATISTICS, "p6_wrong_values": oracles.P6_WRONG_VALUES, "p9_checks": oracles.P9_CHECKS}
