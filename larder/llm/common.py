"""Helpers shared by the operators of this subpackage: batch slicing, vectorised words and hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; a longer single text is its own slice.
SLICE_BYTES = 2 << 20

#: Byte tables for ``words``: ASCII white space separates, everything else is kept.
SPACE_TABLE = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
#: ASCII letters are lowered; every other ASCII character but digits separates.
ALNUM_TABLE = bytes(
    b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Odd multiplier of the k-gram polynomial.
GRAM = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` whose texts hold at most ``limit`` bytes together (one row at least)."""
    limit = limit or SLICE_BYTES
    n = batch.num_rows
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cum, start = np.cumsum(size), 0
    while start < n:
        base = cum[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(cum, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from each start to its end, eight bytes a round; ``buf`` has 8 bytes more at least."""
    eight = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    rest = end - start
    out = mix(rest.astype(np.uint64) * GRAM)
    live, at = np.arange(len(rest)), start
    while len(live):
        take = np.minimum(rest, 8)
        part = eight[at] & _KEEP[take]
        out[live] = mix(out[live] * GRAM ^ part)
        more = rest > 8
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    return out


class Words:
    """Words of many texts in flat arrays: ``buf`` bytes, ``start``/``end`` offsets, ``first`` word of each text."""

    def __init__(self, texts: list[bytes | None], table: bytes = SPACE_TABLE):
        joined = b" ".join(t or b"" for t in texts).translate(table)
        self.buf = np.frombuffer(joined + b" " * 9, dtype=np.uint8)
        gap = np.empty(len(joined) + 2, dtype=bool)
        gap[0] = gap[-1] = True
        np.equal(self.buf[: len(joined)], 32, out=gap[1:-1])
        edge = gap[1:] != gap[:-1]
        at = np.flatnonzero(edge)
        self.start, self.end = at[0::2], at[1::2]
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, begin, side="left")

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return hashes(self.buf, self.start, self.end)

    def text(self, i: int, j: int) -> bytes:
        """Bytes of the words i to j-1 with what separates them."""
        return self.buf[self.start[i]: self.end[j - 1]].tobytes() if j > i else b""


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, at its first word (``len - k + 1`` values)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * GRAM + word_hash[j: j + n]
    return mix(out)


def winnow(gram: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` grams the index of the smallest, the rightmost of equal ones."""
    n = len(gram) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = gram[:n].copy(), np.arange(n)
    for j in range(1, w):
        g = gram[j: j + n]
        less = g <= best
        np.copyto(best, g, where=less)
        at[less] = np.flatnonzero(less) + j
    return at


def inside(first: np.ndarray, n_words: int, span: int) -> np.ndarray:
    """Mask over word positions: a run of ``span`` words starting there stays in its text."""
    left = np.zeros(max(0, n_words - span + 1), dtype=bool)
    if len(left):
        ends = np.repeat(first[1:], np.diff(first))
        left[:] = ends[: len(left)] >= np.arange(len(left)) + span
    return left


def signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64, copy=False).view(np.int64)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


#: Low bits of a tie that number rows.
_NUMBERED = (1 << 24) - 1


def tie_range(value: Column) -> tuple[Column, Column]:
    """The smallest and the largest tie of rows with this hash."""
    return value.bitwiseAND(F.lit(~_NUMBERED)), value.bitwiseOR(F.lit(_NUMBERED))


def tie(value: Column) -> Column:
    """A row's place among those with its key: by its hash and, in the low bits, by its number in its input partition, so that equal rows can be parted."""
    return tie_range(value)[0].bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(_NUMBERED)))


def give_back() -> None:
    """Return a worker's freed memory to the machine: workers live on between stages and share their executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs (its cleaner follows the driver's garbage collection)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
