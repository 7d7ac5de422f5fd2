"""Helpers that several operators of this subpackage share.

Text is handled as UTF-8 bytes in numpy arrays.  A substring hash is the
difference of two prefix sums of ``byte * BASE**i`` modulo 2**64, brought to
the same power and mixed, so any substring costs O(1) after one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import stored as materialize  # noqa: F401

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Rows of an Arrow batch at most; whole texts travel in one, in the JVM and in Python.
BATCH_ROWS = 500
#: Bits of one piece of a bitmap, as Spark builds them.
_PIECE = 1 << 15
#: Broadcast sides may hold at most this many bytes; larger sides are shuffled.
BROADCAST_BYTES = 48 << 20


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers (at least) of the base or of its inverse."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = np.full(size, np.uint64(_BASE_INV if inverse else _BASE))
        base[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(base)
    return have


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = sum of (data[k] + 1) * BASE**k over i <= k < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    start, end = word_bounds(data)
    return span_hashes(prefix_hashes(data), start, end) if len(start) else np.zeros(0, np.uint64)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : i + n]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow string column, without a copy; null as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        chunk = chunk.cast(pa.large_binary())
        _, offsets, values = chunk.buffers()
        at = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        valid = chunk.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(chunk)):
            yield data[at[i] : at[i + 1]] if valid[i] else data[:0]


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, so a task's memory does not hold thousands of texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def sized_broadcast(side: DataFrame, row_bytes: int | Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if side, counted now, stays within ``most`` bytes; else the side as it is (a shuffled join).

    row_bytes is the width of every row, or for rows that hold arrays or texts a Column with the width of each.
    """
    if isinstance(row_bytes, Column):
        small = (side.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= most
    else:
        limit = most // row_bytes
        small = side.limit(limit + 1).count() <= limit
    return F.broadcast(side) if small else side


def held_by(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df with the column ``maybe``: true for rows whose hash in ``key`` is among those of keys, and for about 1 in 16 of the others.

    A bitmap of 16 bits a key, BROADCAST_BYTES at most (beyond that more rows are true), is built by Spark and broadcast in pieces.
    """
    bits = 1 << min(max(16 * keys.count(), _PIECE) - 1, 8 * BROADCAST_BYTES // 2).bit_length()
    at = F.pmod(F.col(key), F.lit(bits))
    piece, place = (at / _PIECE).cast("int"), (at % _PIECE).cast("int")
    pieces = keys.select(piece.alias("_piece"), place.alias("_place")).groupBy("_piece").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, place.bitwiseAND(7)) == 1, F.lit(False))
    return df.withColumn("_piece", piece).join(F.broadcast(pieces), "_piece", "left").withColumn("maybe", maybe).drop("_piece", "_bits")
