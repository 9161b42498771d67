"""Vectorised helpers for text columns inside Arrow batches.

Everything here works on a slice of one Arrow batch in one task: the bytes of
all its rows lie in one NumPy array and ``offsets`` marks where rows begin.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at a time; a longer row is a chunk alone.
CHUNK_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tidy(work: Callable) -> Callable:
    """``work`` on batches, with freed memory given back at its end: idle workers hold theirs beside the stages that follow."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU C library alone has it
            trim(0)

    return run


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row begins (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, marks, data = column.buffers()
    offsets = np.frombuffer(marks, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and (made := work(batch)) is not None:
                yield made

    return df.mapInArrow(tidy(run), schema)


def pieces(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """Python values of a column, a few rows at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown when needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            seed = np.full(size, _BASE)
            seed[0] = 1
            cls.up = np.multiply.accumulate(seed)
            seed = np.full(size, _INVERSE)
            seed[0] = 1
            cls.down = np.multiply.accumulate(seed)
        return cls.up[:n], cls.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes with ``inside[byte]``: starts, ends, and the first run of each row (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    here = inside[data]
    begins, ends = here.copy(), here.copy()
    begins[1:] &= ~here[:-1]
    ends[:-1] &= ~here[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads], ends[tails] = here[heads], here[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


#: Longest span that is hashed by powers of a base modulo 2^64: longer texts can be made to collide under any base.
SHORT_SPAN = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each of some ordered, disjoint spans."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = Powers.of(high - low + 1)
        values = np.zeros(high - low + 1, np.uint64)
        np.multiply(table[data[low:high]], up[:-1], out=values[:-1])
        edges = np.empty(2 * (to - at), np.int64)
        edges[0::2], edges[1::2] = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix(np.add.reduceat(values, edges)[::2] * down[edges[0::2]] + (ends[at:to] - starts[at:to]).astype(np.uint64))
        at = to
    for k in np.flatnonzero(ends - starts > SHORT_SPAN).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def window_hashes(values: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` values (rows are not told apart here)."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if salt:
        values = mix(values ^ np.uint64(salt))
    if length <= 12:
        total = values[:n].copy()
        for k in range(1, length):
            total *= _BASE
            total += values[k : k + n]
        return mix(total)
    up, down = Powers.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n])


def covered(total: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``total`` places lie in any of the spans."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[0::2], edges[1::2]


#: Word bytes when words are split at ASCII white space (space and \x09-\x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
