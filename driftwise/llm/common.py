"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import base64
import contextlib
import ctypes
import functools
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.session import scratch_path

_U = np.uint64


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers look for this package where the driver found it, unless it was shipped to them.
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: the lineage
    is cut and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id: fold 0)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Lean:
    """A task for ``mapInArrow`` that gives the memory it used back to the system when
    it ends: workers stay alive between stages, beside other stages' JVM memory."""

    def __init__(self, task, **options):
        self.task, self.options = task, options

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.task(batches, **self.options)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)


def block_ids() -> Iterator[int]:
    """Ids for the blocks that a task makes, the same when the task is run again."""
    part, n = TaskContext.get().partitionId(), 0
    while True:
        yield (part << 32) | n
        n += 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``start .. start + length``, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    at = np.cumsum(lengths) - lengths
    full = lengths > 0
    starts, lengths, at = starts[full], lengths[full], at[full]
    out[at] = starts
    out[at[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)


def cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each of ``shards`` equal ranges of the 64-bit space starts in sorted keys."""
    edges = np.array([(i << 64) // shards for i in range(shards)], dtype=_U)
    return np.append(np.searchsorted(keys, edges), len(keys))


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts in sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


_ZSTD = pa.Codec("zstd", 1)


def to_planes(x: np.ndarray) -> bytes:
    """An array byte by byte, all lowest bytes first, compressed: planes of high bytes hardly
    change.  In front stands the array's size in bytes."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(flat).to_bytes(8, "little") + _ZSTD.compress(flat, asbytes=True)


def of_planes(data: bytes, dtype) -> np.ndarray:
    dtype, size = np.dtype(dtype), int.from_bytes(data[:8], "little")
    flat = np.frombuffer(_ZSTD.decompress(data[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(dtype.itemsize, size // dtype.itemsize).T).view(dtype).ravel()


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """Deal packed rows to their shards, a shard's rows side by side."""
    spark = rows.sparkSession
    return rows.repartition(min(shards, partitions(spark)), "shard").sortWithinPartitions("shard")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of neighbouring equal ``key``, as dicts."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


class Bits:
    """Bloom filter in segments, one per range of the 64-bit key space."""

    HASHES = 4

    def __init__(self, segments: list[bytes]):
        self.shards = len(segments)
        self.sizes = np.array([len(s) * 8 for s in segments], dtype=_U)
        self.at = (np.cumsum(self.sizes) - self.sizes).astype(_U)
        self.bits = np.frombuffer(b"".join(segments), dtype=np.uint8)
        self.edges = np.array([(i << 64) // self.shards for i in range(self.shards)], dtype=_U)

    @staticmethod
    def places(keys: np.ndarray, sizes) -> Iterator[np.ndarray]:
        """The bits of each key in its segment (sizes are powers of two)."""
        step = (keys >> _U(17)) | _U(1)
        at = keys * _U(0xC2B2AE3D27D4EB4F)
        for _ in range(Bits.HASHES):
            yield (at >> _U(11)) & (sizes - _U(1))
            at = at + step * _U(0x9E3779B97F4A7C15)

    @staticmethod
    def segment(keys: np.ndarray, most_bits: int) -> bytes:
        """A segment of about 12 bits a key, at most ``most_bits`` in all."""
        size = 1 << int(min(max(64, 12 * len(keys)) - 1, most_bits - 1)).bit_length()
        bits = np.zeros(size, dtype=bool)
        for at in Bits.places(keys, _U(size)):
            bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        shard = np.searchsorted(self.edges, keys, "right") - 1
        sizes, base = self.sizes[shard], self.at[shard]
        out = np.ones(len(keys), dtype=bool)
        for at in Bits.places(keys, sizes):
            at = at + base
            out &= (self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
        return out


def collect_segments(rows: DataFrame, shards: int, column: str = "bits") -> Bits:
    """The filter whose segments ``rows`` (shard, bits) hold.  Its size is bounded
    by the caller's bits per segment, whatever the data."""
    found = {r["shard"]: bytes(r[column]) for r in rows.select("shard", column).collect()}
    return Bits([found.get(s, bytes(8)) for s in range(shards)])


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
