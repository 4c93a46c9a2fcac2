"""Token counts through a cache of digests.

Every text is reduced to the digest of its content. Digests are joined with a table of stored counts under the digest of
the tokenizer's file; only distinct texts without a count are encoded, once each, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.llm.base import query, staged, table, text_of
from palimp.session import scratch_path, ship_by_value

ship_by_value(__name__)

CACHE = "digest string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """What counts depend on beside the text: the model and the version of the library that reads it."""
    library = __import__("tokenizers" if path.endswith(".json") else "sentencepiece")
    with open(path, "rb") as model:
        return hashlib.sha256(model.read() + library.__version__.encode()).hexdigest()


def load_counter(path: str):
    """A function from one text to its number of tokens, without begin, end or added special tokens."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        json_model = Tokenizer.from_file(path)
        json_model.no_padding()
        json_model.no_truncation()
        return lambda text: len(json_model.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text))


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(path)
        for batch in batches:
            texts = batch.column("text")
            counts = [count(texts[i].as_py()) for i in range(len(texts))]  # one at a time: ids of one text only are in memory
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; a cache that has not been written yet is empty."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row per input row; counts that the cache lacks are computed and appended to it.

    Null texts count as empty (0 tokens); content is taken as it is, since white space and case change the count. Rows may
    repeat, ids may be null or repeated, and an empty table gives no rows and leaves the cache alone. Other columns are
    ignored. Two writers that append the same digest do no harm: stored counts are reduced to one per digest when read.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    content = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("text")).withColumn("digest", F.sha2("text", 256))
    rows = staged(content.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")

    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    misses = first.join(stored, "digest", "left_anti")
    # The text of one document of each missing digest; the join is by id, so no group of copies meets in one task.
    to_encode = content.join(
        misses.withColumnRenamed("digest", "miss"),
        F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("miss")),
    ).select("digest", "text")
    encoded = to_encode.mapInArrow(_encoder(tokenizer_path), "digest string, n_tokens long")
    encoded = encoded.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # rows that repeat an id and its text
    encoded.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


@query("op2_digest_cache_token_counts")
def op2(spark, sf_dir: str) -> DataFrame:
    cache = scratch_path(spark, "token-counts")  # a fresh cache: every distinct text is a miss
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)
