"""Line files as records: plain text or JSON lines, gzip by suffix, numbered by their place in the file."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import WRITTEN, shared_dir, written

PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("source_error", T.StringType())])
BOM = b"\xef\xbb\xbf"


def infer_format(path: str, requested: str = "auto") -> str:
    """``txt`` or ``jsonl``: what is asked for, or else by the suffix, past one ``.gz``."""
    if requested != "auto":
        return requested
    suffixes = [s.lower() for s in Path(path).suffixes]
    if suffixes[-1:] == [".gz"]:
        suffixes.pop()
    return "jsonl" if suffixes[-1:] in ([".jsonl"], [".ndjson"]) else "txt"


def compression(path: str) -> str:
    return "gzip" if path.lower().endswith(".gz") else "none"


def parse_line(raw: str, field: str) -> tuple[str, str | None]:
    """(text, error) of a JSON line; the text of an error is empty."""
    try:
        value = json.loads(raw)
        if isinstance(value, dict) and isinstance(value.get(field), str):
            value[field].encode("utf-8")
    except json.JSONDecodeError as error:
        return "", f"invalid_json: {error.msg}"
    except (ValueError, RecursionError) as error:
        return "", f"invalid_json: {type(error).__name__}"
    if not isinstance(value, dict):
        return "", "json_record_is_not_an_object"
    return (value[field], None) if isinstance(value.get(field), str) else ("", f"missing_string_field:{field}")


def parse_udf(field: str):
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            yield pd.DataFrame([parse_line(line, field) for line in lines], columns=["text", "source_error"])

    return F.pandas_udf(parse, PARSED)


#: Partitions up to which their offsets are sent to all executors, one row of 16 bytes for each.
SENT_PARTITIONS = 2_000_000


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``record``, counted from 1 in file order.

    The lines of each partition are counted first; a line's number is its place within its partition plus the lines before, from a table of
    one row for each partition that is joined by the partition's number: no sort or shuffle of lines, and no plan that grows with them.
    """
    marked = lines.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    counts = written(marked.groupBy("_part").agg(F.count("*").alias("n")))
    before = written(counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before")))  # a row for each partition
    if before.count() <= SENT_PARTITIONS:
        before = F.broadcast(before)
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(before, "_part").withColumn("record", (F.col("_before") + place + 1).cast("long")).drop("_part", "_id", "_before")


def head(spark: SparkSession, path: str, count: int) -> str | None:
    """A copy of the first lines of a local file in the shared folder, so that no more of it is read; None where either isn't local."""
    local, shared = Path(path.removeprefix("file://")), shared_dir(spark).removeprefix("file://")
    if not local.is_file() or "://" in shared:
        return None
    target = Path(shared) / f"textloom-head-{uuid.uuid4().hex}.txt"
    target.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(local) if compression(path) == "gzip" else local.open("rb") as source, target.open("wb") as copy:
        copy.writelines(islice(source, count))
    WRITTEN.append(str(target))
    return str(target)


def edges(spark: SparkSession, path: str, size: int) -> tuple[bool, bool]:
    """(begins with a byte order mark, last line has no line feed) of one file of any file system; ``size``: its bytes if each line had one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    if not system.exists(place) or not system.getFileStatus(place).isFile() or not size:
        return False, False
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)

    def opened():
        stream = system.open(place)
        return codec.createInputStream(stream) if codec else stream

    first = opened()
    mark = [first.read() for _ in BOM] == list(BOM)
    first.close()
    size += len(BOM) * mark
    last = opened()
    if codec:
        jvm.org.apache.commons.io.IOUtils.skip(last, size - 1)  # of a gzip file, which one task reads in whole anyway
        missing = last.read() == -1
    else:
        length = system.getFileStatus(place).getLen()
        last.seek(length - 1)
        missing = last.read() != 10
    last.close()
    return mark, missing


def read_lines(spark: SparkSession, path: str, requested: str = "auto", text_field: str = "text", max_records: int | None = None) -> DataFrame:
    """The records of a file: (record, text, raw, byte_length, source_error).

    Lines end at line feeds only; carriage returns at the end of a line are dropped; invalid UTF-8 becomes replacement characters. A leading
    byte order mark is kept as text. ``byte_length`` counts decoded bytes with the line feed; a last line without one counts as it is.
    Of a local file no more than ``max_records`` lines are read.
    """
    kind = infer_format(path, requested)
    if max_records is not None:
        path = head(spark, path, max_records) or path
    rows = numbered(spark.read.option("lineSep", "\n").text(path))
    size = F.octet_length("value") + 1
    whole = rows.agg(F.max("record").alias("last"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    mark, unended = edges(spark, path, whole.bytes)
    value = F.col("value")
    if mark:
        value = F.when((F.col("record") == 1) & ~value.startswith("\ufeff"), F.concat(F.lit("\ufeff"), value)).otherwise(value)
    rows = rows.withColumn("value", value)
    if unended:
        size = size - (F.col("record") == whole.last).cast("int")
    if max_records is not None:
        rows = rows.where(F.col("record") <= max_records)
    raw = F.regexp_replace(F.make_valid_utf8("value"), r"[\r\n]+$", "")
    rows = rows.select("record", raw.alias("raw"), size.cast("long").alias("byte_length"))
    if kind == "txt":
        return rows.select("record", F.col("raw").alias("text"), "raw", "byte_length", F.lit(None).cast("string").alias("source_error"))
    parsed = rows.withColumn("_p", parse_udf(text_field)("raw"))
    return parsed.select("record", F.col("_p.text").alias("text"), "raw", "byte_length", F.col("_p.source_error").alias("source_error"))


def from_table(df: DataFrame, id_col: str, text_col: str, raw_col: str | None = None, error_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """A table as records. A null text counts as empty; missing columns are null or derived from the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("record"),
        text.alias("text"),
        (F.col(raw_col) if raw_col else text).alias("raw"),
        (F.col(length_col) if length_col else F.octet_length(text) + 1).cast("long").alias("byte_length"),
        (F.col(error_col) if error_col else F.lit(None)).cast("string").alias("source_error"),
    )
