"""File-shaped inputs: routing by magic, the input gate, folder listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimp import model


def payload_kind(content: Column) -> Column:
    """Kind of a payload by its first eight bytes."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.lit("unsupported")
    for name, magic in model.MAGICS.items():
        kind = F.when(head.startswith(magic), name).otherwise(kind)
    return F.when(content.isNull(), "missing").otherwise(kind)


def scan_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = model.MAX_INPUT_BYTES) -> DataFrame:
    """(path, length, kind) of files; those over the size cap are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    small = files.where(F.col("length") <= max_bytes).select("path", "length", payload_kind(F.col("content")).alias("kind"))
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit("too large").alias("kind"))
    return small.unionByName(large)


def folder_scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(folder, name, length, position): names in order within each folder; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    parts = files.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")
    return parts.withColumn("position", F.row_number().over(Window.partitionBy("folder").orderBy("name")).cast("bigint"))


def input_gate(text: Column, max_chars: int, head_pattern: str) -> Column:
    """Reason for rejecting an input, null when it is accepted. Cheap tests come first."""
    return (F.when(text.isNull() | (text == ""), "missing").when(F.length(text) > max_chars, "too large")
            .when(~text.rlike(head_pattern), "bad magic"))
