"""Strings and hashes packed into binary values, so that a shuffle carries a few bytes for each of them instead of a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard

from palimp.session import ship_by_value

ship_by_value(__name__)

#: Rows of a batch that goes back to Spark.
ROWS = 1 << 16


def pack(table: pa.Table) -> bytes:
    """A table as one value; a string is held as what differs from the one before, so sorted ones take least."""
    sink, strings = pa.BufferOutputStream(), [f.name for f in table.schema if f.type == pa.string()]
    pq.write_table(table, sink, compression="zstd", use_dictionary=False, column_encoding={c: "DELTA_BYTE_ARRAY" for c in strings},
                   write_statistics=False, store_schema=False)
    return sink.getvalue().to_pybytes()


def unpack(payloads: pa.ChunkedArray) -> list[pa.Table]:
    return [pq.ParquetFile(pa.BufferReader(p.as_buffer())).read(use_threads=False) for p in payloads]


def pack_numbers(values: np.ndarray) -> bytes:
    """Ascending numbers of 32 bits as their differences, byte by byte of like weight."""
    steps = np.diff(values, prepend=values[:1] * 0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def ascending(values: np.ndarray) -> np.ndarray:
    """The distinct values in their order."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def once(table: pa.Table) -> pa.Table:
    """The rows in the order of their first column, one for each of its values."""
    held = table.take(pc.sort_indices(table.column(0))).combine_chunks()
    new = pc.not_equal(held.column(0)[1:], held.column(0)[:-1]).to_numpy() if len(held) > 1 else np.empty(0, bool)
    return held if new.all() else held.filter(pa.array(np.append(True, new)))


def stretches(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first place, place after the last) of every part in ascending numbers of parts."""
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    yield from zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)])


def by_part(table: pa.Table, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, payload) of the rows of each part, one for each value of their first column, in its order."""
    table = table.combine_chunks()
    # Numbers of 16 bits are sorted by counting.
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    for place, first, last in stretches(part[order]):
        yield place, pack(once(table.take(order[first:last])))


def in_batches(table: pa.Table) -> pa.Table:
    """The same table in chunks, each of which goes to Spark as a batch of its own."""
    return pa.Table.from_batches([b for b in table.combine_chunks().to_batches(max_chunksize=ROWS)], table.schema)


def spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) for every place of the ranges from ``first`` up to ``last``."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) + np.repeat(first - (np.cumsum(n) - n), n)
