"""Line dedup: a line that several documents hold stays in the first of them.

Two Bloom filters over 64-bit line hashes find the suspects: a hash enters the
first filter when it is seen once and the second when the first has it already.
The filters are built shard by shard from packed hash arrays (each block of
documents sends a hash once, so a line that every document holds costs one entry
a block), and only the second filter, whose size is the parameter
``filter_bits``, goes to all tasks.  Of the lines that it holds, those with the same
text in an earlier document of their block are repeats already and go on as numbers;
the others are shuffled with their text and confirmed exactly, so a line that every
document holds meets itself once a block.  Everything else never leaves its task.  A filter
too small for the data lets more lines through to the exact step and changes no result.

Defined cases: a null or empty text is one empty line; a row with a null id is
returned unchanged and takes no part; rows with one id are one document; a line
repeated only within one document stays; an empty table gives an empty table; ids that
are neither integers nor strings are compared by the exact step alone.
Columns of the input named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import Bits, Lean, by_shard, collect_segments, cuts, groups, partitions, stored
from driftwise.llm.hashing import LOWER, blocks, prefix, span_hash, spans

MIN_CHARS = 10
FILTER_BITS = 1 << 27
RESULTS = ("kept_text", "n_lines", "n_dropped")
_U = np.uint64


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, line number in it, and stripped start and end of each line."""
    newline = np.flatnonzero(buf == 10)
    docs = len(offsets) - 1
    before = np.searchsorted(newline, offsets, "left")
    lines = np.diff(before) + 1
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    n = int(lines.sum())
    starts, ends = np.empty(n, np.int64), np.empty(n, np.int64)
    inner = np.ones(n, dtype=bool)
    inner[last] = False
    ends[last], ends[inner] = offsets[1:], newline
    inner[:] = True
    inner[first] = False
    starts[first], starts[inner] = offsets[:-1], newline + 1
    a, b = spans(buf, offsets)
    i, j = np.searchsorted(a, starts, "left"), np.searchsorted(b, ends, "right") - 1
    full = i <= j
    starts[full], ends[full] = a[i[full]], b[j[full]]
    ends[~full] = starts[~full]
    doc = np.repeat(np.arange(docs), lines)
    return doc, np.arange(n) - first[doc], starts, ends


def _keys(buf: np.ndarray, offsets: np.ndarray, min_chars: int):
    """The lines of at least ``min_chars`` code points and their hashes."""
    doc, line, starts, ends = line_spans(buf, offsets)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)])
    long = np.flatnonzero(chars[ends] - chars[starts] >= min_chars)
    doc, line, starts, ends = doc[long], line[long], starts[long], ends[long]
    return doc, line, starts, ends, span_hash(prefix(buf), starts, ends)


def _send(batches, shards, min_chars):
    for batch in batches:
        found = [_keys(buf, offsets, min_chars)[4] for _, _, buf, offsets in blocks(batch["text"])]
        if not found:
            continue
        keys = np.sort(np.concatenate(found))
        at = cuts(keys, shards)
        full = np.flatnonzero(np.diff(at))
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([_twice_marked(keys[at[s]:at[s + 1]]) for s in full], pa.binary())],
            names=["shard", "keys"])


def _twice_marked(keys: np.ndarray) -> bytes:
    """Sorted keys, each at most twice."""
    keep = np.ones(len(keys), dtype=bool)
    keep[2:] = keys[2:] != keys[:-2]
    return keys[keep].tobytes()


def _two_filters(batches, segment_bits):
    """For each shard the second filter: hashes that came while the first had them."""
    for shard, rows in _streams(batches):
        once, twice = np.zeros(segment_bits, dtype=bool), np.zeros(segment_bits, dtype=bool)
        for row in rows:
            keys = np.frombuffer(row, dtype=_U)
            again = np.zeros(len(keys), dtype=bool)
            again[1:] = keys[1:] == keys[:-1]
            known = np.ones(len(keys), dtype=bool)
            for at in Bits.places(keys, _U(segment_bits)):
                known &= once[at]
            for at in Bits.places(keys, _U(segment_bits)):
                once[at] = True
                twice[at[known | again]] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())],
            names=["shard", "bits"])


def _streams(batches):
    """(shard, keys of its rows); at most one shard's packed keys are held."""
    for shard, rows in groups(batches, "shard"):
        yield shard, (r["keys"] for r in rows)


def _repeats_here(ids: pa.Array, keys: pa.Array) -> np.ndarray:
    """Which lines have the same text in a row of a smaller id among these."""
    if not len(keys) or not (pa.types.is_integer(ids.type) or pa.types.is_string(ids.type)):
        return np.zeros(len(keys), dtype=bool)
    turn = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    text = keys.dictionary_encode().indices.to_numpy()
    least = np.full(int(text.max()) + 1, len(ids) + 1, np.int64)
    np.minimum.at(least, text, turn)
    return turn > least[text]


def _suspects(batches, bits, min_chars):
    """The suspects with their text as key; without it those that are repeats already."""
    seen = bits.value
    for batch in batches:
        for first, _, buf, offsets in blocks(batch["text"]):
            doc, line, starts, ends, keys = _keys(buf, offsets, min_chars)
            hit = np.flatnonzero(seen.has(keys))
            lower = LOWER[buf].tobytes()
            rows = pa.array(first + doc[hit])
            ids = batch["doc"].take(rows)
            texts = pa.array([lower[a:b].decode() for a, b in zip(starts[hit], ends[hit], strict=True)], pa.string())
            sure = pa.array(_repeats_here(ids, texts))
            yield pa.RecordBatch.from_arrays(
                [ids, batch["tag"].take(rows), pa.array(line[hit].astype(np.int32)), pc.if_else(sure, pa.scalar(None, pa.string()), texts)],
                names=["doc", "tag", "line", "key"])


def _drop(batches):
    for batch in batches:
        texts, gone = batch["kept_text"].to_pylist(), batch["gone"].to_pylist()
        kept, n, dropped = [], [], []
        for text, out in zip(texts, gone, strict=True):
            text = text or ""
            if out:
                lines, out = text.split("\n"), set(out)
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in out))
                n.append(len(lines))
                dropped.append(len(out))
            else:
                kept.append(text)
                n.append(text.count("\n") + 1)
                dropped.append(0)
        arrays = dict(zip(batch.schema.names, batch.columns, strict=True))
        arrays.pop("gone")
        arrays |= {"kept_text": pa.array(kept, pa.string()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def twice_seen(lines: DataFrame, min_chars: int, filter_bits: int) -> Bits:
    """The second filter over the lines of ``lines`` (doc, text)."""
    spark = lines.sparkSession
    shards = max(4, 4 * partitions(spark))
    segment = 1 << max(6, (filter_bits // shards).bit_length() - 1)
    sent = lines.select("text").mapInArrow(Lean(_send, shards=shards, min_chars=min_chars), "shard int, keys binary")
    return collect_segments(by_shard(sent, shards).mapInArrow(Lean(_two_filters, segment_bits=segment), "shard int, bits binary"), shards)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped``."""
    spark = docs.sparkSession
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), tag.alias("tag"), F.col(text_col).alias("text"))
    bits = spark.sparkContext.broadcast(twice_seen(lines, min_chars, filter_bits))
    kind = lines.schema["doc"].dataType.simpleString()
    suspects = stored(lines.mapInArrow(Lean(_suspects, bits=bits, min_chars=min_chars), f"doc {kind}, tag long, line int, key string"), "line-suspects")
    open_ = suspects.where("key IS NOT NULL")
    repeats = open_.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first")
    late = open_.join(repeats, "key").where("doc > first").select("doc", "tag", "line")
    gone = (late.union(suspects.where("key IS NULL").select("doc", "tag", "line"))
            .groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_set("line").alias("gone")))
    rest = [c for c in docs.columns if c not in RESULTS and c != "gone"]
    left = docs.select(*rest, F.col(text_col).alias("kept_text"), F.col(id_col).alias("_doc"), tag.alias("_tag"))
    joined = left.join(gone, ["_doc", "_tag"], "left").select(*rest, "kept_text", "gone")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("gone", "kept_text"))
    return joined.mapInArrow(Lean(_drop), f"{types}, kept_text string, n_lines long, n_dropped long")
