"""Shared helpers: row keys, written intermediate tables, Arrow text buffers, words and their hashes.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64-bit, not linear, and seeded with
fixed numbers, so that every task, retry and cluster gets the same value.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stash  # noqa: F401

# Bytes of text that are taken apart at once in a task; one longer text is taken alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
# Multipliers of the independent hashes, the step between places, and masks of the first bytes of a lane.
ODD = [_U(int(x) & ~7 | 3) for x in _rng.integers(2**62, 2**63, 8, dtype=np.uint64)]
_STEP = _U(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str) -> Column:
    """Tells rows apart that share an id; rows equal in both id and text are equal in every result."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["k1"].eqNullSafe(b["k1"]) & (a["k2"] == b["k2"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, text): id, hash of the text, text with null as empty."""
    return docs.select(F.col(id_col).cast("long").alias("k1"), text_hash(text_col).alias("k2"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# --- Arrow -------------------------------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs.astype(np.int64)


def pieces(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi with their bytes and offsets from 0, about ``limit`` bytes at a time; no text is cut."""
    data, offs = utf8(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def strings(data: np.ndarray, offs: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """String (or binary) column from bytes and offsets."""
    kind = kind or pa.string()
    if offs[-1] > 2**31 - 1:
        raise ValueError("more than 2 GB of text in one slice")
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()),
                                                       pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def rows_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def tidy() -> None:
    """Give memory back to the system; Python workers live on and serve tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the C library that has it


def tidied(run: Callable) -> Callable:
    """``run`` for mapInArrow, with ``tidy`` at the end of each task."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()
    return wrapped


# --- words -------------------------------------------------------------------------

def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and the index of the first word of each text (one more than texts)."""
    word = IS_WORD[data]
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offs[:-1][offs[:-1] < len(data)]
    begin[at] = word[at]
    at = offs[1:][offs[1:] > 0] - 1
    last[at] = word[at]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (in place)."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes of each span; ``which`` picks one of several independent hashes.

    Every lane of eight bytes is mixed with its place in the span before lanes are summed, so that no regular
    text (such as one of two letters) has the same sum as another.
    """
    sizes = ends - starts
    n = np.maximum((sizes + 7) // 8, 1)
    first = np.cumsum(n) - n
    span = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(span)) - first[span]
    at = starts[span] + 8 * place
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lane = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    lane &= _FIRST_BYTES[np.minimum(ends[span] - at, 8)]
    return _summed(lane, place, first, sizes, which)


def _summed(values: np.ndarray, place: np.ndarray, first: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """Sum of the values of each span, each mixed with its place, mixed with the size of the span."""
    values = mix(values * ODD[which] + (place + 1).astype(_U) * _STEP)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=sums[1:])
    return mix(sums[np.append(first[1:], len(values))] - sums[first] + sizes.astype(_U) * _STEP) if len(first) else np.zeros(0, _U)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of values[start:end] for each span of 64-bit values; spans may overlap."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    out, lo = np.zeros(len(sizes), _U), 0
    while lo < len(sizes):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + SLICE_BYTES, "right")))
        at, span = ranges(starts[lo:hi], ends[lo:hi] - 1)
        first = total[lo:hi] - sizes[lo:hi] - done
        out[lo:hi] = _summed(values[at], at - starts[lo:hi][span], first, sizes[lo:hi], which)
        lo = hi
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return byte_hashes(data, starts, ends, which)


def gram_hashes(values: np.ndarray, k: int, which: int) -> np.ndarray:
    """Hash of each run of k values, by joining the hashes of shorter runs."""
    if len(values) < k:
        return np.zeros(0, _U)
    joined = lambda a, b: mix(a * ODD[which] + b)
    runs, size = values, 1
    for bit in bin(k)[3:]:
        runs, size = joined(runs[: len(runs) - size], runs[size:]), 2 * size
        if bit == "1":
            runs, size = joined(runs[:-1], values[size:]), size + 1
    return runs if k > 1 else mix(values * ODD[which])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of lo..hi (ends included) one after the other, and the index of the range of each."""
    sizes = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which], which
