"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period ``q`` and of at least
``max(least, 2 * q)`` words that no neighbouring word extends keeping that period.
Each of its words stands again ``q`` words further or before, and ``q`` is at most
half the run.  So in a segment of ``m`` words a word that is not found twice within
``m // 2 + 1`` words there is too rare for any run: it splits the segment, what is
left on either side is a smaller segment with fewer words and a smaller half, and
segments of fewer than ``least`` words go.  This repeats until no segment splits
(after ``ROUNDS`` rounds the segments go on as they are: they only leave the scan
more to look at).

The surviving segments are scanned for lags: lag by lag up to 31; longer lags in
octaves ``2b .. 4b - 1``, where a run has at least ``2b`` words that equal the word
one lag further, among them a whole aligned block of ``b`` words.  The places of
each aligned block's content one lag further are looked up among the sorted hashes
of all stretches of ``b`` words, and every hit grows to both sides by halving steps
on prefix hashes.  So the scan takes n log n steps, not one pass a lag.  Equal
stretches found under several lags are one run of the smallest lag (by the theorem
of Fine and Wilf the others are its multiples).

Words are compared by 64-bit hashes.  Each text is searched whole in one task, the
texts of a block together.

Defined cases: a null or empty text has no words, no runs and an empty
``collapsed``; repeated rows are searched each; columns of the input named like the
results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import Lean, ragged, run_starts
from driftwise.llm.hashing import blocks, prefix, span_hash, spans, value_prefix

LEAST = 12
ROUNDS = 64
BLOCK = 16       # the first octave's block; smaller lags are scanned one by one
RESULTS = ("n_words", "runs", "collapsed")
NONE = np.int64(1) << 60


def neighbours(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and after each word the same text has it again (``NONE``: not)."""
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((words, own))
    a, b = order[:-1], order[1:]
    same = (words[a] == words[b]) & (own[a] == own[b])
    before, after = np.full(len(words), NONE), np.full(len(words), NONE)
    before[b[same]] = after[a[same]] = (b - a)[same]
    return before, after


def segments(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that rare words leave."""
    before, after = neighbours(words, first)
    wide = np.diff(first) >= least
    start, end = first[:-1][wide], first[1:][wide]
    done = [(start[:0], end[:0])]
    for _ in range(ROUNDS):
        if not len(start):
            break
        at = ragged(start, end - start)
        seg = np.repeat(np.arange(len(start)), end - start)
        half = ((end - start) // 2)[seg]
        back, ahead = before[at], after[at]
        stays = ((back <= half) & (at - back >= start[seg])) | ((ahead <= half) & (at + ahead < end[seg]))
        whole = np.bincount(seg[~stays], minlength=len(start)) == 0
        done.append((start[whole], end[whole]))
        left = np.flatnonzero(stays & ~whole[seg])
        if not len(left):
            start = start[:0]
            break
        new = np.ones(len(left), dtype=bool)
        new[1:] = (np.diff(at[left]) != 1) | (np.diff(seg[left]) != 0)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(left)) - 1
        start, end = at[left[head]], at[left[tail]] + 1
        wide = end - start >= least
        start, end = start[wide], end[wide]
    done.append((start, end[:len(start)]))
    start, end = (np.concatenate([d[k] for d in done]) for k in (0, 1))
    order = np.argsort(start)
    return start[order], end[order]


def _short_lags(x: np.ndarray, seg: np.ndarray, longest: int, least: int) -> list:
    found = []
    for lag in range(1, min(2 * BLOCK - 1, longest // 2) + 1):
        same = np.zeros(len(x) - lag + 2, dtype=np.int8)
        same[1:-1] = (x[lag:] == x[:-lag]) & (seg[lag:] == seg[:-lag])
        edge = np.flatnonzero(np.diff(same))
        a, b = edge[::2], edge[1::2]
        enough = b - a >= max(lag, least - lag)
        found.append((a[enough], (b - a)[enough] + lag, np.full(int(enough.sum()), lag)))
    return found


def _grow(sums: np.ndarray, a: np.ndarray, lag: np.ndarray, known: int, most: np.ndarray, sign: int) -> np.ndarray:
    """How many words from ``a`` on (``sign`` 1) or before it (-1) equal those one lag further."""
    low, high = np.full(len(a), known), most
    while (low < high).any():
        mid = (low + high + 1) // 2
        s, e = (a, a + mid) if sign > 0 else (a - mid, a)
        same = span_hash(sums, s, e) == span_hash(sums, s + lag, e + lag)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _octave(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seg: np.ndarray, block: int) -> tuple | None:
    """Equal stretches of lags ``2 * block .. 4 * block - 1``; ``start`` and ``end`` are the segments' bounds."""
    big = end - start >= 4 * block
    pos = ragged(start[big], end[big] - start[big] - block + 1)
    grams = span_hash(sums, pos, pos + block)
    order = np.argsort(grams, kind="stable")
    heads = run_starts(grams[order])
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    width = len(seg) + 4 * block + 1
    key = group * width + pos[order]
    anchor = np.flatnonzero(pos[order] % block == 0)
    a, base = pos[order][anchor], group[anchor] * width
    low = np.searchsorted(key, base + a + 2 * block)
    hits = np.maximum(0, np.searchsorted(key, base + np.minimum(a + 4 * block, end[seg[a]])) - low)
    if not hits.any():
        return None
    from_ = np.repeat(a, hits)
    lag = pos[order][ragged(low, hits)] - from_
    # of the blocks of one stretch the first is enough
    code = lag * width + from_
    follows = np.isin(code - block, code) & (from_ - block >= start[seg[from_]])
    from_, lag = from_[~follows], lag[~follows]
    ahead = _grow(sums, from_, lag, block, end[seg[from_]] - from_ - lag, 1)
    back = _grow(sums, from_, lag, 0, from_ - start[seg[from_]], -1)
    equal = ahead + back
    enough = equal >= lag
    return (from_ - back)[enough], (equal + lag)[enough], lag[enough]


def find(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of the texts whose words lie end to end
    (text ``i`` has those from ``first[i]`` on), by start and period."""
    start, end = segments(words, first, least)
    sizes = end - start
    at = ragged(start, sizes)
    x, seg = words[at], np.repeat(np.arange(len(start)), sizes)
    longest = int(sizes.max(initial=0))
    found = _short_lags(x, seg, longest, least)
    if longest >= 4 * BLOCK:
        sums, stop, block = value_prefix(x), np.cumsum(sizes), BLOCK
        while longest >= 4 * block:
            found += [f for f in [_octave(sums, stop - sizes, stop, seg, block)] if f]
            block *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    head, size, lag = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((lag, size, head))
    head, size, lag = head[order], size[order], lag[order]
    own = np.ones(len(head), dtype=bool)
    own[1:] = (head[1:] != head[:-1]) | (size[1:] != size[:-1])
    # a stretch is a run under its smallest lag, if it is long enough for that one
    head, size, lag = head[own], size[own], lag[own]
    order = np.lexsort((lag, head))
    return at[head[order]], size[order], lag[order]


def kept_words(n: int, head: np.ndarray, size: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Which words stay when each run keeps its first period alone."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, head + lag, 1)
    np.add.at(edge, head + size, -1)
    return np.cumsum(edge)[:n] == 0


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> pa.Array:
    """Words joined by single spaces, ``count`` words a text."""
    sizes = ends - starts + 1
    out = np.concatenate([buf, [np.uint8(0x20)]])[np.minimum(ragged(starts, sizes), len(buf))]
    stop = np.cumsum(sizes)
    out[stop - 1] = 0x20
    total = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)])]
    some = count > 0
    out = np.delete(out, total[1:][some] - 1)
    offsets = np.concatenate([[0], np.cumsum(np.diff(total) - some)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])


def _search(batches, least):
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "_text"]
        for i, j, buf, offsets in blocks(batch["_text"]):
            starts, ends = spans(buf, offsets)
            first = np.searchsorted(starts, offsets, "left")
            head, size, lag = find(span_hash(prefix(buf, lower=False), starts, ends), first, least)
            keep = kept_words(len(starts), head, size, lag)
            total = np.concatenate([[0], np.cumsum(keep)])
            text = _joined(buf, starts[keep], ends[keep], np.diff(total[first]))
            cut = np.searchsorted(head, first)
            own = np.repeat(first[:-1], np.diff(cut))
            runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(v, pa.int64()) for v in (head - own, size, lag)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch[n].slice(i, j - i) for n in rest] + [pa.array(np.diff(first), pa.int64()), runs, text.cast(pa.string())],
                names=[*rest, *RESULTS])


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period)
    and ``collapsed``, the words that stay, joined by single spaces."""
    frame = docs.select(*[c for c in docs.columns if c not in (*RESULTS, "_text")], F.col(text_col).alias("_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "_text")
    return frame.mapInArrow(Lean(_search, least=least),
                            f"{types}n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
