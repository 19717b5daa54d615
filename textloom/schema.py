"""Schemas of records and findings."""

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("record", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("byte_length", T.LongType()),
        T.StructField("source_error", T.StringType()),
    ]
)
FINDING = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("threshold_label", T.StringType()),
    ]
)
