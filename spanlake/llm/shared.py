"""What several operators need: folders, batches, words of a text, a cache per worker."""

from __future__ import annotations

import functools
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanlake.sources.workspace import stored  # noqa: F401  (for the operators)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of text that are worked on at once; one document may be larger.
SLICE = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker; task code travels by value and has none."""
    name = "_spanlake_worker_cache"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    return module.__dict__.setdefault("values", {})


def tidy(run: Callable) -> Callable:
    """A task's function that in the end gives back to the system what was freed.

    Executors keep their Python workers. Arrow's usual pool keeps the most that a worker ever had,
    so its buffers come from malloc, as those of NumPy, and what is free there is handed back.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.system_memory_pool()
        pa.set_memory_pool(pool)
        try:
            yield from run(batches)
        finally:
            pool.release_unused()

    return tidied


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``limit`` bytes each, at least one row."""
    ends = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)
    ends = ends[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at, n = 0, len(column)
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1))
        yield at, to
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows, n + 1 of them."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value (splitmix64 finaliser), one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Odd multiplier of the polynomial byte hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, kept in the worker."""
    cache = worker_cache()
    have = cache.get(("powers", base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        cache["powers", base] = have
    return have[:n]


def byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, dependent on its bytes alone."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * powers(len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(len(data) + 1, UNBASE)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row of bytes: starts, ends, and n + 1 bounds of the rows' words."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return runs(~space[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of ``inside`` that do not cross rows: starts, ends, bounds per row."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def hashed_words(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a string column, A-Z lower-cased, and the rows' bounds."""
    data, offsets = utf8(part)
    low = lowered(data)
    starts, ends, bounds = space_words(low, offsets)
    return segment_hashes(low, starts, ends), bounds


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts[:0]


def packed(values: np.ndarray) -> bytes:
    """Byte planes of the values under zstandard."""
    import zstandard

    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)
