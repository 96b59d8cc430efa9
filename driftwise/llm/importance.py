"""Resampling towards a target distribution by hashed n-gram features.

A text is lower-cased (A-Z), its separators collapse to single spaces, and an
overlapping regular-expression scan with boundary lookarounds gives every run of one
to ``longest`` words as a span of the scanned bytes; the CRC of each span, modulo
``buckets``, is the feature's bucket.  Bucket counts of the source and the target give
each bucket a gain, the floored thousandfold logarithm of the ratio of smoothed
shares; a document's weight is the floored mean gain of its features; a Gumbel draw of
the document's id is added, and the highest scores are drawn, which samples without
replacement in proportion to the exponential of the weight.

Each text is scanned once: the buckets are stored, counted per task and added up (at
most ``buckets`` numbers a task; ``buckets`` numbers go to the driver).  Ranks come from
range slices of the scores, ranked inside and moved up by the rows of the slices before.

Defined cases: a null or empty text has no features, weight 0, and is drawn only where
``least_words`` is 0; a null id is drawn by the seed alone; rows with one id are
candidates each, ordered by what they hold; columns of the input named like the results
are replaced; without a target or source text every gain follows from the smoothing; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import Lean, partitions, stored
from driftwise.llm.hashing import blocks

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
RESULTS = ("n_words", "buckets")

# what a byte is scanned as: letters A-Z in lower case, separators as spaces
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pattern(words: int) -> regex.Pattern:
    """Runs of so many words; a line feed stands between texts."""
    return regex.compile(rb"(?<![^ \n])" + b" ".join([rb"[^ \n]+"] * words) + rb"(?![^ \n])")


def _codes(text: bytes, pattern: regex.Pattern) -> Iterator[int]:
    crc32 = zlib.crc32
    return (crc32(span[0]) for span in pattern.finditer(text, overlapped=True))


def scan_block(buf: np.ndarray, offsets: np.ndarray, buckets: int, patterns: list[regex.Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the buckets of all features, text by text, and how many each text has."""
    data = buf.tobytes().translate(_PLAIN)
    texts = [b" ".join(data[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    n_words = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    scanned = b"\n".join(texts)
    found, owner = [], []
    for k, pattern in enumerate(patterns):
        found.append(np.fromiter(_codes(scanned, pattern), np.uint32) % np.uint32(buckets))
        owner.append(np.repeat(np.arange(len(texts)), np.maximum(n_words - k, 0)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return n_words, np.concatenate(found)[order], np.bincount(owner, minlength=len(texts))


def _scan(batches, buckets, longest):
    patterns = [_pattern(k + 1) for k in range(longest)]
    kind = _kind(buckets)
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "_text"]
        for i, j, buf, offsets in blocks(batch["_text"]):
            n_words, found, counts = scan_block(buf, offsets, buckets, patterns)
            ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]) * kind.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(found.astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([batch[n].slice(i, j - i) for n in rest] + [pa.array(n_words, pa.int64()), packed.cast(pa.binary())],
                                             names=[*rest, *RESULTS])


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and the offset of each row."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return np.frombuffer(data.tobytes(), kind), (ends - ends[0]) // kind.itemsize


def features(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``docs`` without the text, with ``n_words`` and ``buckets`` (packed, little-endian,
    two bytes a feature, four beyond 65,536 buckets)."""
    frame = docs.select(*[c for c in docs.columns if c not in (*RESULTS, text_col, "_text")], F.col(text_col).alias("_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "_text")
    return frame.mapInArrow(Lean(_scan, buckets=buckets, longest=longest), f"{types}n_words long, buckets binary")


def _count(batches, buckets):
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        total += np.bincount(_unpacked(batch["buckets"], _kind(buckets))[0], minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, counted per task, then added up (``buckets`` rows at most)."""
    rows = (scanned.select("buckets").mapInArrow(Lean(_count, buckets=buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold logarithm of each bucket's smoothed target share over its source share, floored."""
    size, all_s, all_t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size))))
                     for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def _weigh(batches, gain):
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "buckets"]
        values, first = _unpacked(batch["buckets"], _kind(len(gain)))
        total = np.concatenate([[0], np.cumsum(gain[values])])
        n = np.diff(first)
        weight = np.where(n > 0, (total[first[1:]] - total[first[:-1]]) // np.maximum(n, 1), 0)
        yield pa.RecordBatch.from_arrays([batch[c] for c in rest] + [pa.array(x, pa.int64()) for x in (n, weight)],
                                         names=[*rest, "n_features", "weight"])


def weigh(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """``scanned`` with ``n_features`` and ``weight`` in place of ``buckets``."""
    frame = scanned.select(*[c for c in scanned.columns if c not in ("n_features", "weight")])
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "buckets")
    return frame.mapInArrow(Lean(_weigh, gain=gain), f"{types}n_features long, weight long")


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Floored thousandfold Gumbel draw of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("bigint")


def draw(scored: DataFrame, id_col: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank`` from 1 for the ``percent`` of its rows of at least
    ``least_words`` words with the highest ``score`` (ties to the smaller id), else null."""
    ordered = [F.col("score").desc(), F.col(id_col).asc_nulls_first(), F.col("n_words"), F.col("n_features"), F.col("weight")]
    counted = scored.where(F.col("n_words") >= least_words)
    dealt = counted.repartitionByRange(partitions(scored.sparkSession), *ordered).sortWithinPartitions(*ordered)
    # rows of a slice are numbered where they lie, and stored so that all uses see the same slices
    place = F.monotonically_increasing_id()
    rows = stored(dealt.withColumn("_slice", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), "importance-slices")
    sizes = sorted((r["_slice"], r["count"]) for r in rows.groupBy("_slice").count().collect())
    before, n = [], 0
    for k, size in sizes:
        before.append((k, n))
        n += size
    if not n:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    offsets = scored.sparkSession.createDataFrame(before, "_slice bigint, _before bigint")  # a row a slice
    rank = F.col("_before") + F.col("_at") + 1
    rows = rows.join(F.broadcast(offsets), "_slice")
    drawn = rows.withColumn("rank", F.when(rank <= percent * n // 100, rank)).drop("_slice", "_at", "_before")
    rest = scored.where(~F.coalesce(F.col("n_words") >= least_words, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, buckets: int = BUCKETS,
             longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``."""
    source = stored(features(docs.select(F.col(id_col), F.col(text_col)), text_col, buckets, longest), "importance-features")
    gain = gains(bucket_counts(source, buckets), bucket_counts(features(target.select(text_col), text_col, buckets, longest), buckets))
    weighed = weigh(source, gain).withColumn("score", F.col("weight") + gumbel(id_col, seed))
    return draw(stored(weighed, "importance-weights"), id_col, least_words, percent)
