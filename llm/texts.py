"""Texts as numpy arrays inside tasks, and the small frames that several operators share.

A batch of texts is worked on in slabs of about a megabyte, so memory follows the longest text
of a task and not the batch. A word is a run of bytes outside 0x20 and 0x09-0x0D; UTF-8 bytes of
other characters never fall into that range, so bytes and code points give the same words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framevitals.sources.scratch import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SLAB = 1 << 20
LAST = 2**63 - 1

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240601).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` in the shared folder and read it back: lineage ends there, lost executors do no harm."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def learns(doc_id: Column, parts: int, held: int) -> Column:
    """False for the part that is held out: crc32 of the id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != held, F.lit(True))


def release() -> None:
    """Give back what a finished task no longer needs: workers are used again, and their memory is the executor's."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(work):
    """``work(batches)`` that releases memory when its task ends."""

    @wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def slabs(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as bytes (NULL as empty), about ``SLAB`` bytes at a time: (first row, texts)."""
    first, held, size = 0, [], 0
    for i, value in enumerate(texts.cast(pa.large_binary())):
        raw = value.as_buffer()
        held.append(raw.to_pybytes() if raw is not None else b"")
        size += len(held[-1])
        if size >= SLAB:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of an odd base, or of its inverse, modulo 2^64."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 2**64) if inverse else _BASES[which]
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) <= 1 << 23:
            _POWERS[which, inverse] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``, from prefix sums: constant work a range."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(which, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(which, n + 1, True)[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: byte ranges in ``data``, a hash each, and where each text's words begin."""

    def __init__(self, texts: list[bytes], lower: bool = False, hashes: int = 1):
        joined = b" ".join(texts) + b" "
        self.data = np.frombuffer(joined, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        blank = _BLANK[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.offsets = offsets
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = [ranges_hash(_VALUES[i][self.data], self.starts, self.ends, i) for i in range(hashes)]

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each word a hash of the ``k`` words from it on, and whether they lie in one text."""
        n = len(self.starts)
        inside = np.zeros(n, bool)
        for a, b in zip(self.first[:-1], self.first[1:]):
            inside[a : max(a, b - k + 1)] = True
        out = np.zeros(n, np.uint64)
        at = np.flatnonzero(inside)
        if len(at):
            out[at] = ranges_hash(self.hash[which], at, at + k, which)
        return out, inside


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    done, span = values, 1
    while span * 2 <= width:
        done = np.minimum(done[:-span], done[span:])
        span *= 2
    rest = width - span
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def packed(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and the text as ``z``, compressed: a shuffle then carries about a third of the bytes."""
    source = docs.select(*keep, F.col("text").alias("z"))

    @frugal
    def work(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [None if (b := v.as_buffer()) is None else press.compress(b.to_pybytes()) for v in batch.column("z").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.binary())], names=batch.schema.names)

    return source.mapInArrow(work, StructType(source.schema.fields[:-1]).add("z", "binary"))


def unpack(column: pa.Array) -> list[bytes]:
    opener = zstandard.ZstdDecompressor()
    return [b"" if (b := v.as_buffer()) is None else opener.decompress(b.to_pybytes()) for v in column]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as sorted disjoint ranges; touching ranges become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reach) - 1]))]
