"""Pairs of rows that share a key but differ in another, by way of classes of equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(class_pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(low, high): every pair of a member of class ``a`` and one of class ``b``, for the rows (a, b) of ``class_pairs``.

    ``members``: (id, class). The output is as large as the result demands and no larger: rows of one class never meet.
    """
    left = class_pairs.join(members.select(F.col("class").alias("a"), F.col("id").alias("one")), "a")
    both = left.join(members.select(F.col("class").alias("b"), F.col("id").alias("other")), "b")
    return both.select(F.least("one", "other").alias("low"), F.greatest("one", "other").alias("high"))
