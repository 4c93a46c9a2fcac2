"""Exact duplicates by sorting the content itself.

Normalised texts are range-partitioned at sampled splitters and sorted externally, so equal texts stand next to each
other and are compared in full with their neighbour. The splitters are cut from (head, hash, doc_id), never from whole
texts: what the driver samples stays small, texts with a common beginning spread over partitions, and a group of copies
of any size is cut by doc_id. Runs that a cut divides meet again as one row per run and partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimp.llm.base import BLANKS, partitions, query, set_apart, staged, table, text_of
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Characters of a text that go into a splitter.
HEAD = 24


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows with a column ``__norm``: put the digest of the text and whether a run of equal neighbours starts here
    in its place. Digests are computed once for each run."""
    last, digest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("__norm")
        same = [last is not None and norm[0].as_py() == last]
        same += pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_pylist()
        digests = []
        for i, equal in enumerate(same):
            if not equal:
                digest = hashlib.sha256(norm[i].as_py().encode()).hexdigest()
            digests.append(digest)
        last = norm[len(norm) - 1].as_py()
        names = [n for n in batch.schema.names if n != "__norm"]
        columns = [batch.column(n) for n in names] + [pa.array(digests, pa.string()), pa.array([not x for x in same])]
        yield pa.RecordBatch.from_arrays(columns, [*names, "__sha", "__starts"])


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`_mark_runs` with the number of each row's run within the partition, from 1."""
    before = 0
    for batch in _mark_runs(batches):
        numbers = before + np.cumsum(batch.column("__starts").to_numpy(zero_copy_only=False).astype(np.int64))
        before = int(numbers[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*batch.schema.names, "__run"])


def content_sorted(docs: DataFrame, columns: list[Column], key: str, text: str, number: bool = False) -> DataFrame:
    """The given columns of each row, with the digest of its normalised text (``__sha``), whether a run of equal texts
    starts in it (``__starts``), and the number of its partition (``__part``); equal texts are ordered by id, nulls last.
    With ``number`` also that of its run in the partition (``__run``)."""
    norm = F.regexp_replace(text_of(docs, text), BLANKS, " ")
    rows = docs.select(*columns, F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("__at"), norm.alias("__norm"))
    rows = (
        rows.withColumns({"__head": F.substring("__norm", 1, HEAD), "__h": F.xxhash64("__norm")})
        .repartitionByRange(partitions(docs), "__head", "__h", "__at")
        .sortWithinPartitions("__head", "__h", "__norm", "__at")
        .drop("__head", "__h", "__at")
        .withColumn("__part", F.spark_partition_id())
    )
    out = StructType([f for f in rows.schema if f.name != "__norm"]).add("__sha", "string").add("__starts", "boolean")
    return rows.mapInArrow(_number_runs, out.add("__run", "long")) if number else rows.mapInArrow(_mark_runs, out)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal if identical once every run of ASCII blanks is one space; null is empty, and empty texts are equal.
    Of equal texts the smallest id stays; repeated ids each give a row, and all rows with the smallest id are ``kept``.
    Null ids sort last; a group of null ids only has a null ``keep_id`` and keeps them. An empty table gives no rows;
    other columns are ignored.
    """
    columns = [F.col(key).cast("long").alias("doc_id")]
    marked = staged(content_sorted(docs, columns, key, text, number=True).drop("__starts"), "content-runs")
    run = ["__part", "__run"]
    runs = staged(marked.groupBy(*run, "__sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "runs")
    # Only the first and the last run of a partition can go on in another: at most two rows per partition.
    ends = F.broadcast(runs.groupBy("__part").agg(F.max("__run").alias("last")))
    edges = runs.join(ends, "__part").where("__run = 1 or __run = last")
    whole = edges.groupBy("__sha").agg(F.min("keep_id").alias("whole_id"), F.sum("group_size").alias("whole_size"), F.count("*").alias("n")).where("n > 1")
    merged = F.broadcast(edges.join(whole, "__sha").select(*run, "whole_id", "whole_size"))
    groups = runs.join(merged, run, "left").select(
        *run, F.when(F.col("whole_size").isNull(), F.col("keep_id")).otherwise(F.col("whole_id")).alias("keep_id"), F.coalesce("whole_size", "group_size").alias("group_size"))
    return marked.join(groups, run).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("__sha").alias("text_sha256")
    )


@set_apart("__at", "__norm", "__head", "__h", "__part", "__sha", "__starts")
def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns as they were (of rows that repeat that
    id, one). The starts of runs are kept; a run that continues from the partition before has a start in each, and there
    are fewer such starts than partitions, so they are found and removed by a broadcast of a proven size."""
    columns = [F.col(n) for n in docs.columns]
    starts = staged(content_sorted(docs, columns, key, text).where("__starts"), "content-kept")
    slim = starts.select("__sha", "__part")
    first = slim.groupBy("__sha").agg(F.min("__part").alias("__part"), F.count("*").alias("n")).where("n > 1")
    rest = slim.join(first.select("__sha", F.col("__part").alias("first")), "__sha").where("__part > first").drop("first")
    return starts.join(F.broadcast(rest), ["__sha", "__part"], "left_anti").select(*docs.columns)


ORACLE = """
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from n group by text_sha256)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, n.text_sha256 from n join g using (text_sha256)
"""


@query("op8_content_sort_dedup", ORACLE)
def op8(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
