"""Documents dealt into chunks of bounded size, and what operators share on top of them.

A chunk is the unit that a Python worker holds at once: all rows whose
``xxhash64(doc_id)`` falls in it, about ``CHUNK_BYTES`` of text.  The number of
chunks follows the input, the size of one does not.  Operators that need an
answer from the whole corpus send one packed request per (chunk, bucket) and
get one packed answer back; the text itself is shuffled once, as Spark reuses
the exchange on ``_chunk`` for every pass of the same query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 6 << 20

PIECE = "to long, chunk long, data binary"
PIECE_ARROW = pa.schema([("to", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, _chunk) of `docs`, and the number of chunks; null text becomes empty."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    return base.withColumn("_chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n))), n


def joined(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of no chunk
        column = pa.array([], column.type)
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def pieces(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    to, chunk, data = zip(*rows) if rows else ((), (), ())
    return pa.Table.from_arrays([pa.array(to, pa.int64()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary())], schema=PIECE_ARROW)


def by_bucket(bucket: np.ndarray) -> dict[int, np.ndarray]:
    """Indices of each bucket that occurs, in their order."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
    return dict(zip(own[starts].tolist(), np.split(order, starts[1:])))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, behind their sizes in bytes."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(raw), *map(len, raw)], "<i8").tobytes() + b"".join(raw)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays that pack() was given, by their types."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.concatenate(([0], np.cumsum(np.frombuffer(data, "<i8", n, 8))))
    return [np.frombuffer(data[a:b], kind) for a, b, kind in zip(ends.tolist(), ends[1:].tolist(), kinds)]


def small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and those that don't fit."""
    return np.minimum(x, 255).astype(np.uint8), x[x >= 255].astype("<u4")


def counts(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The counts that small() was given."""
    out = few.astype(np.int64)
    out[few == 255] = many
    return out
