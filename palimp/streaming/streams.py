"""Structured Streaming forms: the batch operators run on data as it lands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palimp.operators import audit, verify
from palimp.session import scratch_path


def landing(spark: SparkSession, sf_dir: str, name: str, schema=None, **options) -> DataFrame:
    """A table as a stream of its files. The bracket makes a glob, which a single file also answers to."""
    found = schema or spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(found).options(**options).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()


def to_table(stream: DataFrame, label: str) -> DataFrame:
    """Append a stream to a table in the shared folder until its input ends, then read the table."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, label + "-state")
    run_to_end(stream.writeStream.format("parquet").outputMode("append").option("path", out)
               .option("checkpointLocation", state).trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(out)


def audit_stream(pages: DataFrame) -> DataFrame:
    """Findings of pages as they land; stateless."""
    return audit.explode_findings(audit.audit_pages(pages))


def hash_dedup_stream(documents: DataFrame, event_time: str | None = None) -> DataFrame:
    """One row per content. With an event time the state is bounded by its watermark."""
    hashed = documents.withColumn("hash", F.sha2("text", 256))
    if event_time is None:
        return hashed.dropDuplicates(["hash"])
    return hashed.withWatermark(event_time, "1 day").dropDuplicatesWithinWatermark(["hash"])


def latest_table(stream: DataFrame, label: str) -> DataFrame:
    """Run an aggregation in complete mode until its input ends, then read the last result; each batch writes all of it under its own number."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, label + "-state")
    written: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written.append(batch_id)

    run_to_end(stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={written[-1]}") if written else spark.createDataFrame([], stream.schema)


def op_metrics_stream(events: DataFrame, tools: int = 5, late: str | None = "1 hour") -> DataFrame:
    """Finished and failed operations per tool and tumbling hour; late rows are dropped after the watermark.

    Without ``late`` every row counts, for complete mode; rows without a time are an hour of their own."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late is None:
        start = F.date_trunc("hour", "at")
        hour = F.struct(start.alias("start"), (start + F.expr("interval 1 hour")).alias("end"))
    else:
        timed, hour = timed.withWatermark("at", late), F.window("at", "1 hour")
    return timed.groupBy(hour.alias("w"), (F.col("user_id") % tools).alias("tool")).agg(
        F.count_if(F.col("event_type") != "error").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"))


def redact_release_stream(documents: DataFrame, paginate, terms: DataFrame, label: str = "release", **kw) -> DataFrame:
    """Redact and verify each micro-batch; released, quarantined and report rows go to sinks named by the batch. Gives what the
    sinks hold: the pages of released and quarantined documents, and a row without a page for those without a match.

    Writing a batch again overwrites its own folder, so a retried batch leaves no duplicates.
    """
    spark = documents.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, label + "-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        pages, docs = paginate(batch), batch.select("doc_id")
        released, quarantined, report = verify.fail_closed_release(pages, docs, terms, **kw)
        for name, df in (("released", released), ("quarantined", quarantined), ("report", report)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    run_to_end(documents.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start())
    sink = lambda name: spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").drop("batch")
    report = sink("report").select("doc_id", "hits", "verified", "status")
    text = sink("released").unionByName(sink("quarantined"))
    none = report.where("status = 'no_match'").withColumns({"page_no": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string")})
    return report.where("status <> 'no_match'").join(text, "doc_id").unionByName(none)
