"""Documents packed into blocks, so that what is looked up for words is asked once per block and word, not per occurrence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.base import text_of
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Text bytes of a block, on average; one task holds one block. A longer text is in a block whole.
BLOCK_BYTES = 16 << 20
#: Of zstd: a block is shuffled as often as it is read, so its bytes count more than the seconds for them.
LEVEL = 6
ROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: dict) -> pa.RecordBatch:
        blocks, payloads = [], []
        for block, rows in held.items():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ROW) as writer:
                writer.write_batch(pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}, ROW))
            blocks.append(block)
            payloads.append(zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary())], ["block", "payload"])

    held, size = {}, 0
    for batch in batches:
        for block, key, text in zip(batch.column("block").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            held.setdefault(block, []).append((key, text))
            size += len(text)
            if size > 2 * BLOCK_BYTES:
                yield flush(held)
                held, size = {}, 0
    if held:
        yield flush(held)


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, payload: documents dealt by a hash into blocks of about ``block_bytes``; several payloads make a block."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // block_bytes + 1))
    return rows.withColumn("block", block).mapInArrow(_pack, "block long, payload binary")


def payloads(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of a block in batches of doc_id and text."""
    for payload in group["payload"]:
        yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload.as_py()))


def documents(group: pa.Table) -> Iterator[tuple[int, str]]:
    """(doc_id, text) of a block."""
    for batch in payloads(group):
        yield from zip(batch.column("doc_id").to_pylist(), (t.as_py() for t in batch.column("text")))


def per_block(blocks: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").applyInArrow(function, schema)
