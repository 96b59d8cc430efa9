"""Substring dedup by distributed prefix doubling.

The rank of a position at length k names the k bytes from there; the rank at 2k is
the pair of the ranks at k and k later.  Ranks are 64-bit fingerprints (equal bytes,
equal rank), so pairs are formed where the text is and Spark shuffles and sorts only
to find which ranks are unique.  Starting from a quarter of ``length`` bytes:

* half length: every ``length`` bytes hold some rank at half length that is the
  smallest among theirs; such smallest ranks (about one position in 26 for 100
  bytes) are shuffled and sorted, and positions whose smallest rank is unique are
  finished.  The ranks seen twice go to all tasks as a Bloom filter of bounded size.
  Neighbouring positions with one smallest rank are a run; the runs left are sorted
  by that rank and their own fingerprint.  In a run that equals an earlier run every
  position is a repeat, so of equal runs only the first goes on, and only if runs of
  other content share its rank or its rank comes back within it;
* full length, past which doubling stops: the positions of those runs are ranked at
  full length, shuffled and sorted with their places, and every position but the
  first of its rank starts a repeat.

Rows carry packed arrays (some blocks of texts and a range of ranks each; the more ranges,
the more blocks, so that rows grow with the entries only).  Smallest ranks lie near zero,
so ranges are taken of their mix.  Of equal entries of those blocks only the first meets
the others': the rest are repeats whatever those hold, and go past the sort, dealt by
block, with the texts that the blocks' entries lie in.  So a passage that everything holds
sends one entry a row to the task that compares it, and each shard is a task of its own.
Repeats become byte spans per document, which are merged and cut out of the texts.

Defined cases: a null text counts as empty; ids are integers (cast to long); rows
with a null id are returned whole and take no part; rows with one id are one
document's places: the same start in two of them is no earlier start; texts shorter
than ``length`` never change; an empty table gives no rows.  Two different strings
share a rank with a chance of 2**-64.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import Bits, Lean, block_ids, collect_segments, cuts, groups, partitions, ragged, run_starts, stored
from driftwise.llm.hashing import _POWERS, blocks, mix, prefix, span_hash

LENGTH = 100
FILTER_BITS = 1 << 29
_U = np.uint64
_PAIR = _U(0x9FB21C651E98DF25)
ROW_ENTRIES, MOST_ENTRIES, MOST_BYTES = 256, 1 << 20, 1 << 26
PLACED = "block long, places binary, sizes binary, docs binary, tags binary, offsets binary"
SENT = f"shard int, keys binary, prints binary, {PLACED}"
JUDGED = f"shard int, keys binary, {PLACED}"
_AGAIN = np.uint32(1 << 31)


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[:len(a) - (width - span)], a[width - span:]) if span < width else a


def rank(buf: np.ndarray, length: int) -> np.ndarray:
    """Rank at half length of every position of the block."""
    quarter = length // 4
    sums = prefix(buf, lower=False)
    n = len(buf) - quarter + 1
    _, down = _POWERS.of(len(sums))
    own = mix((sums[quarter:] - sums[:n]) * down[:n])
    return mix(own[:n - quarter] * _PAIR + own[quarter:])


def _open(offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` bytes of one text start at each place of the block."""
    size = np.diff(offsets)
    marks = np.zeros(int(offsets[-1]) + 1, np.int32)
    long = size >= length
    np.add.at(marks, offsets[:-1][long], 1)
    np.add.at(marks, offsets[1:][long] - length + 1, -1)
    return np.cumsum(marks)[:int(offsets[-1]) - length + 1] > 0


def _least(buf: np.ndarray, offsets: np.ndarray, length: int):
    """Half ranks, the smallest of each place's (0 where no ``length`` bytes start), and how many those are."""
    half, open_ = rank(buf, length), _open(offsets, length)
    width = len(half) - len(open_) + 1
    return half, np.where(open_, _slide(half, width, np.minimum), _U(0)), width


def _smallest(half: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Which half ranks are the smallest of some place."""
    padded = np.concatenate([np.zeros(width - 1, _U), least, np.zeros(width - 1, _U)])
    return _slide(padded, width, np.maximum) == half


def _anchors(batches, shards, length):
    for batch in batches:
        found = []
        for _, _, buf, offsets in blocks(batch["text"]):
            if len(buf) >= length:
                half, least, width = _least(buf, offsets, length)
                found.append(half[_smallest(half, least, width)])
        if not found:
            continue
        keys = np.sort(mix(np.concatenate(found)))
        keep = np.ones(len(keys), dtype=bool)
        keep[2:] = keys[2:] != keys[:-2]
        yield _keyed(keys[keep], shards)


def _keyed(keys: np.ndarray, shards: int) -> pa.RecordBatch:
    at = cuts(keys, shards)
    some = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([keys[at[s]:at[s + 1]].tobytes() for s in some], pa.binary())],
                                      names=["shard", "keys"])


def _repeated(batches, most_bits):
    for shard, rows in groups(batches, "shard"):
        keys = np.sort(np.frombuffer(b"".join(r["keys"] for r in rows), _U))
        twice = keys[1:][keys[1:] == keys[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([Bits.segment(twice[run_starts(twice)], most_bits)], pa.binary())],
                                         names=["shard", "bits"])


def _segments(batches, most_bits):
    for shard, rows in groups(batches, "shard"):
        keys = np.unique(np.frombuffer(b"".join(r["keys"] for r in rows), _U))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([Bits.segment(keys, most_bits)], pa.binary())], names=["shard", "bits"])


def _run_keys(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return mix(mix(docs.view(_U)) + starts.astype(_U))


def _runs(least: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of places with one smallest rank."""
    own = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    fresh = np.ones(len(least), dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], len(least))
    some = least[start] != 0
    return start[some], end[some], own[start[some]]


def _late(some, keys, prints, doc, start):
    """``some`` entries in order, which of them open a group of one key and print, and, of
    all entries, which lie elsewhere than the first of their group."""
    some = some[np.lexsort((start[some], doc[some], prints[some], keys[some]))]
    head = np.ones(len(some), dtype=bool)
    head[1:] = (keys[some][1:] != keys[some][:-1]) | (prints[some][1:] != prints[some][:-1])
    lead = some[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(some) else some
    late = np.zeros(len(keys), dtype=bool)
    late[some] = (doc[some] != doc[lead]) | (start[some] != start[lead])
    return some, head, late


def _pack(block, shards, keys, prints, places, sizes, docs, tags, offsets) -> pa.RecordBatch:
    """Entries by the shard of their key, with the texts that each shard's entries lie in.
    Entries with an earlier equal among them are repeats already: they are one more row,
    without keys, for a shard taken from ``block``, with the texts of all entries."""
    own = np.searchsorted(offsets, places, "right") - 1
    late = _late(np.arange(len(keys)), keys, prints, docs[own], places - offsets[own])[2]
    which = np.searchsorted(np.array([(i << 64) // shards for i in range(shards)], dtype=_U), keys, "right") - 1
    which[late] = shards
    order = np.argsort(which, kind="stable")
    at = np.searchsorted(which[order], np.arange(shards + 2))
    keys, prints, own = keys[order], prints[order], own[order]
    places, sizes = places[order].astype(np.uint32), sizes[order].astype(np.uint32)
    out = {n: [] for n in ("shard", "keys", "prints", "block", "places", "sizes", "docs", "tags", "offsets")}
    for s in [*np.flatnonzero(np.diff(at[:-1])).tolist(), shards]:
        a, b = at[s], at[s + 1]
        if s < shards:
            used = np.unique(own[a:b])
            to, compared, named = s, (keys[a:b].tobytes(), prints[a:b].tobytes()), None
        else:
            used = np.unique(own)
            to, compared, named = ((block >> 32) + block) % shards, (b"", b""), tags[used].tobytes()
        row = (to, *compared, block, np.diff(places[a:b], prepend=np.uint32(0)).astype(np.uint32).tobytes(),
               sizes[a:b].tobytes(), docs[used].tobytes(), named, offsets[used].tobytes())
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _together(parts):
    """The entries and texts of some blocks as those of one."""
    keys, prints, places, sizes, docs, tags, offsets = zip(*parts, strict=True)
    at = np.cumsum([0, *(int(o[-1]) for o in offsets)])
    return (np.concatenate(keys), np.concatenate(prints), np.concatenate([p + b for p, b in zip(places, at[:-1], strict=True)]), np.concatenate(sizes),
            np.concatenate(docs), np.concatenate(tags), np.concatenate([*(o[:-1] + b for o, b in zip(offsets, at[:-1], strict=True)), at[-1:]]))


def _sent(found, shards):
    """Packed rows of the entries found in blocks, for as many blocks at a time as have about
    ``ROW_ENTRIES`` entries a shard: rows of single blocks would grow with blocks times shards."""
    ids, parts, entries, size = block_ids(), [], 0, 0
    for part in found:
        parts.append(part)
        entries, size = entries + len(part[0]), size + int(part[-1][-1])
        if entries >= min(MOST_ENTRIES, ROW_ENTRIES * shards) or size >= MOST_BYTES:
            yield _pack(next(ids), shards, *_together(parts))
            parts, entries, size = [], 0, 0
    if parts:
        yield _pack(next(ids), shards, *_together(parts))


def _texts(batches, length):
    for batch in batches:
        docs, tags = batch["doc"].to_numpy(zero_copy_only=False), batch["tag"].to_numpy(zero_copy_only=False)
        for first, last, buf, offsets in blocks(batch["text"]):
            if len(buf) >= length:
                yield docs[first:last], tags[first:last], buf, offsets


def _hit_runs(batches, seen, length):
    for docs, tags, buf, offsets in _texts(batches, length):
        half, least, width = _least(buf, offsets, length)
        start, end, _ = _runs(least, offsets)
        keys = mix(least[start])
        hit = seen.has(keys)
        keys, start, end = keys[hit], start[hit], end[hit]
        if not len(start):
            continue
        # a smallest rank that comes back at once (every place of the run sees one, so after at most
        # ``width``): places within the run may be equal
        place = np.flatnonzero(_smallest(half, least, width))
        back = np.zeros(len(half) + 1, np.int64)
        back[place[1:][(half[place[1:]] == half[place[:-1]]) & (np.diff(place) <= width)] + 1] = 1
        back = np.cumsum(back)
        again = back[np.minimum(end + width - 1, len(half))] > back[start]
        sizes = (end - start).astype(np.uint32) | np.where(again, _AGAIN, np.uint32(0))
        prints = span_hash(prefix(buf, lower=False), start, end + length - 1)
        yield keys, prints, start, sizes, docs, tags, offsets


def _send_runs(batches, bits, shards, length):
    yield from _sent(_hit_runs(batches, bits.value, length), shards)


def _hit_places(batches, chosen, length):
    for docs, tags, buf, offsets in _texts(batches, length):
        half, least, _ = _least(buf, offsets, length)
        start, end, own = _runs(least, offsets)
        hit = chosen.has(_run_keys(docs[own].astype(np.int64), start - offsets[own]))
        if not hit.any():
            continue
        place = ragged(start[hit], (end - start)[hit])
        full = mix(half[place] * _PAIR + half[place + length // 2])
        yield full, np.zeros(len(full), np.uint8), place, np.ones(len(full), np.uint32), docs, tags, offsets


def _send_places(batches, bits, shards, length):
    yield from _sent(_hit_places(batches, bits.value, length), shards)


def _places(row) -> np.ndarray:
    return np.cumsum(np.frombuffer(row["places"], np.uint32), dtype=np.int64)


def _entries(rows):
    keys = np.concatenate([np.frombuffer(r["keys"], _U) for r in rows])
    places = [_places(r) for r in rows]
    doc, start = [], []
    for r, p in zip(rows, places, strict=True):
        offsets = np.frombuffer(r["offsets"], np.int64)
        i = np.searchsorted(offsets, p, "right") - 1
        doc.append(np.frombuffer(r["docs"], np.int64)[i])
        start.append(p - offsets[i])
    return keys, places, np.concatenate(doc), np.concatenate(start)


def _repeats(rows, shards, whole):
    """Rows of :data:`JUDGED` from a shard's: of equal entries all but the first.  Of runs
    (``whole``) also the keys of those whose places are to be ranked at full length."""
    for r in rows:
        if not r["keys"]:
            sizes = np.frombuffer(r["sizes"], np.uint32) & ~_AGAIN
            yield None, None, r["block"], r["places"], sizes.tobytes(), r["docs"], r["tags"], r["offsets"]
    rows = [r for r in rows if r["keys"]]
    if not rows:
        return
    keys, places, doc, start = _entries(rows)
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint32) for r in rows])
    prints = np.concatenate([np.frombuffer(r["prints"], _U) for r in rows]) if whole else keys
    length = sizes & ~_AGAIN
    order = np.argsort(keys)
    size = np.diff(np.append(run_starts(keys[order]), len(keys)))
    some = order[np.repeat(size > 1, size)] if not whole else order
    some, head, late = _late(some, keys, prints, doc, start)
    if whole:
        at = run_starts(keys[some])
        kinds = np.add.reduceat(head.astype(np.int64), at)
        again = np.maximum.reduceat((sizes[some] & _AGAIN) > 0, at)
        open_ = some[np.repeat((kinds > 1) | again, np.diff(np.append(at, len(some)))) & ~late[some]]
        if len(open_):
            part = _keyed(np.unique(_run_keys(doc[open_], start[open_])), shards)
            for s, k in zip(part["shard"].to_pylist(), part["keys"].to_pylist(), strict=True):
                yield s, k, *[None] * 6
    ends = np.cumsum([len(p) for p in places])[:-1]
    for r, p, flags, n in zip(rows, places, np.split(late, ends), np.split(length, ends), strict=True):
        if flags.any():
            yield None, None, r["block"], np.diff(p[flags], prepend=0).astype(np.uint32).tobytes(), n[flags].tobytes(), *[None] * 3


def _judge(batches, shards, whole):
    names = ("shard", "keys", "block", "places", "sizes", "docs", "tags", "offsets")
    kinds = (pa.int32(), pa.binary(), pa.int64(), *[pa.binary()] * 5)
    for _, rows in groups(batches, "shard"):
        for part in itertools.batched(_repeats(rows, shards, whole), ROW_ENTRIES):
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def _spans(batches, length):
    """Byte spans per document from the repeats of its blocks, one of whose rows names the texts."""
    for _, rows in groups(batches, "block"):
        place = np.concatenate([_places(r) for r in rows])
        if not len(place):
            continue
        end = place + np.concatenate([np.frombuffer(r["sizes"], np.uint32) for r in rows]) + length - 1
        docs, tags, offsets = next([np.frombuffer(r[c], np.int64) for c in ("docs", "tags", "offsets")] for r in rows if r["tags"] is not None)
        order = np.argsort(place)
        place, end = place[order], np.maximum.accumulate(end[order])
        own = np.searchsorted(offsets, place, "right") - 1
        fresh = np.ones(len(place), dtype=bool)
        fresh[1:] = (place[1:] > end[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(fresh)
        starts, ends, owner = place[head], end[np.append(head[1:], len(place)) - 1], own[head]
        cut = np.flatnonzero(np.diff(owner)) + 1
        named = owner[np.concatenate([[0], cut])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[named], pa.int64()), pa.array(tags[named], pa.int64()),
             pa.array([x.astype(np.int64).tobytes() for x in np.split(starts - offsets[owner], cut)], pa.binary()),
             pa.array([x.astype(np.int64).tobytes() for x in np.split(ends - offsets[owner], cut)], pa.binary())],
            names=["_doc", "_tag", "_starts", "_ends"])


def _merged(starts: list[bytes], ends: list[bytes]) -> list[tuple[int, int]]:
    spans = sorted(zip(np.frombuffer(b"".join(starts), np.int64).tolist(), np.frombuffer(b"".join(ends), np.int64).tolist(), strict=True))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches):
    for batch in batches:
        kept, bytes_, removed, spans = [], [], [], []
        for text, starts, ends in zip(batch["_text"], batch["_starts"].to_pylist(), batch["_ends"].to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            bytes_.append(len(data))
            if starts is None:
                kept.append(data)
                removed.append(0)
                spans.append(0)
                continue
            gone = _merged(starts, ends)
            edges = [0, *[x for span in gone for x in span], len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(len(data) - len(kept[-1]))
            spans.append(len(gone))
        rest = [n for n in batch.schema.names if n not in ("_text", "_starts", "_ends")]
        yield pa.RecordBatch.from_arrays(
            [batch[n] for n in rest] + [pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (bytes_, removed, spans)]],
            names=[*rest, "kept", "n_bytes", "n_removed", "n_spans"])


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Each shard's rows in a task of their own."""
    return rows.repartitionById(shards, "shard")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``;
    ``length`` is a multiple of four."""
    if length < 8 or length % 4:
        raise ValueError("length must be a multiple of four, and at least 8")
    spark = docs.sparkSession
    shards = max(4, partitions(spark))
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), tag.alias("tag"), F.col(text_col).alias("text"))
    anchors = texts.select("text").mapInArrow(Lean(_anchors, shards=shards, length=length), "shard int, keys binary")
    repeated = _dealt(anchors, shards).mapInArrow(Lean(_repeated, most_bits=max(64, filter_bits // shards)), "shard int, bits binary")
    bits = spark.sparkContext.broadcast(collect_segments(repeated, shards))
    most = max(64, filter_bits // shards)
    sent = _dealt(texts.mapInArrow(Lean(_send_runs, bits=bits, shards=shards, length=length), SENT), shards)
    runs = stored(sent.mapInArrow(Lean(_judge, shards=shards, whole=True), JUDGED), "runs")
    open_ = _dealt(runs.where("shard IS NOT NULL").select("shard", "keys"), shards).mapInArrow(Lean(_segments, most_bits=most), "shard int, bits binary")
    chosen = spark.sparkContext.broadcast(collect_segments(open_, shards))
    placed = _dealt(texts.mapInArrow(Lean(_send_places, bits=chosen, shards=shards, length=length), SENT), shards)
    places = placed.mapInArrow(Lean(_judge, shards=shards, whole=False), JUDGED)
    names = ["block", "places", "sizes", "docs", "tags", "offsets"]
    late = runs.where("block IS NOT NULL").select(F.lit(0).alias("step"), *names).union(places.select(F.lit(1), *names))
    spans = (late.withColumn("block", F.xxhash64("step", "block")).drop("step")
             .repartition(partitions(spark), "block").sortWithinPartitions("block")
             .mapInArrow(Lean(_spans, length=length), "_doc long, _tag long, _starts binary, _ends binary")
             .groupBy("_doc", "_tag").agg(F.collect_list("_starts").alias("_starts"), F.collect_list("_ends").alias("_ends")))
    results = ("kept", "n_bytes", "n_removed", "n_spans")
    rest = [c for c in docs.columns if c not in results]
    left = docs.select(*rest, F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_doc"), tag.alias("_tag"))
    joined = left.join(spans, ["_doc", "_tag"], "left").select(*rest, "_text", "_starts", "_ends")
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema if f.name in rest)
    return joined.mapInArrow(Lean(_cut), f"{types}kept binary, n_bytes long, n_removed long, n_spans long")
