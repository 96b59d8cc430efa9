"""Token counts of piece models (BPE over characters with byte fallback).

The text is taken as the model's library takes it: a space before it, spaces as
the model's space mark, nothing else changed.  Two neighbouring characters that no
piece of the vocabulary holds side by side are never in one token, so a text is cut
there into pre-tokens whose merges do not depend on each other.  The pre-tokens of a
block are counted once each (by a 64-bit hash, remembered by the worker): their
symbols lie end to end in ragged arrays, and in each round every pre-token has its
pair of lowest rank merged, all at the same time, until no pre-token has a pair
left; the symbols that survive are counted.  A character outside the vocabulary
counts as many tokens as it has bytes.

Within a pre-token the library merges the leftmost pair of the best score, one at a
time.  Every place of that pair is merged in one round where no pair with the merged
piece has a rank as low as the piece's own (then nothing can come between); else the
leftmost alone.  A pre-token of more than ``LONG`` symbols (a long stretch without
any cut) would take as many rounds, each over all its symbols: its pairs are merged
in the same order from a heap.

Models whose text normalisation is not the plain one above are refused, by a
comparison with the library when the model is read.

Defined cases: a null or empty text has no bytes and no tokens; special strings are
ordinary text; repeated rows are counted each; columns of the input named like the
results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import Lean, ragged, run_starts
from driftwise.llm.hashing import blocks, span_hash, value_prefix

MARK = "▁"      # the library's sign for a space
POINTS = 0x110000
LONG = 4096
KNOWN = 1_000_000    # pre-tokens a worker remembers
NONE = np.int64(1) << 60
RESULTS = ("n_bytes", "n_tokens")


@dataclass(frozen=True)
class Merges:
    """``symbol``: id of each code point (-1: none).  ``beside``: may two symbols of
    single characters stand in one piece?  ``keys`` (sorted: left id * size + right id),
    ``ranks`` and ``merged`` say what a pair becomes; ``alone``: no pair with this piece
    ranks as low as the piece itself."""

    symbol: np.ndarray
    number: np.ndarray
    beside: np.ndarray
    size: int
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    alone: np.ndarray

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE``: no such pair) and place in the table of each pair."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at


def _ordinary(model: sentencepiece.SentencePieceProcessor) -> dict[str, int]:
    own = (i for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): i for i in own}


@functools.lru_cache(maxsize=2)
def read_model(path: str) -> Merges:
    """Tables of a model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " a  b ﬁÅ\n "
    if model.decode(model.encode(probe)) != probe or MARK not in _ordinary(model):
        raise ValueError(f"{path} normalises text in another way")
    pieces = _ordinary(model)
    scores = {i: model.get_score(i) for i in pieces.values()}
    rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    size = model.get_piece_size()
    symbol, number = np.full(POINTS, -1, np.int64), np.full(size, -1, np.int64)
    single = [p for p in pieces if len(p) == 1]
    for k, p in enumerate(single):
        symbol[ord(p)] = pieces[p]
        number[pieces[p]] = k
    beside, alone = np.zeros((len(single), len(single)), dtype=bool), np.ones(size, dtype=bool)
    table = {}
    for p, i in pieces.items():
        ids = [pieces.get(c) for c in p]
        for a, b in zip(ids[:-1], ids[1:], strict=True):
            if a is not None and b is not None:
                beside[number[a], number[b]] = True
        for k in range(1, len(p)):
            a, b = pieces.get(p[:k]), pieces.get(p[k:])
            if a is not None and b is not None:
                table[a * size + b] = (rank[scores[i]], i)
                for part in (a, b):
                    alone[part] &= number[part] >= 0 or scores[part] > scores[i]
    keys = np.array(sorted(table), np.int64)
    ranks, merged = (np.array([table[k][j] for k in keys.tolist()], np.int64) for j in (0, 1))
    found = Merges(symbol, number, beside, size, keys, ranks, merged, alone)
    data = np.frombuffer(probe.encode(), np.uint8)
    if count_block(data, np.array([0, len(data)]), Counter(found)).tolist() != [len(model.encode(probe))]:
        raise ValueError(f"{path} prepares texts in another way")
    return found


def _one_by_one(symbols: np.ndarray, merges: Merges) -> int:
    """Symbols left of one long pre-token, its pairs merged from a heap."""
    n = len(symbols)
    now, before, after = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    table = dict(zip(merges.keys.tolist(), zip(merges.ranks.tolist(), merges.merged.tolist(), strict=True), strict=True))
    heap = []

    def offer(a: int, b: int) -> None:
        found = table.get(now[a] * merges.size + now[b])
        if found:
            heapq.heappush(heap, (found[0], a, b, now[a], now[b], found[1]))

    for a in range(n - 1):
        offer(a, a + 1)
    left = n
    while heap:
        _, a, b, x, y, piece = heapq.heappop(heap)
        if now[a] != x or now[b] != y or after[a] != b:
            continue
        now[a], now[b] = piece, -1
        after[a] = after[b]
        left -= 1
        if after[a] < n:
            before[after[a]] = a
            offer(a, after[a])
        if before[a] >= 0:
            offer(before[a], a)
    return left


def count_symbols(symbols: np.ndarray, sizes: np.ndarray, merges: Merges, long: int = LONG) -> np.ndarray:
    """Symbols that survive in each sequence; the sequences lie end to end."""
    out = np.ones(len(sizes), np.int64)
    first = np.cumsum(sizes) - sizes
    for i in np.flatnonzero(sizes > long).tolist():
        out[i] = _one_by_one(symbols[first[i]:first[i] + sizes[i]], merges)
    live = np.flatnonzero((sizes > 1) & (sizes <= long))
    symbols = symbols[ragged(first[live], sizes[live])]
    sizes = sizes[live]
    while len(live):
        first = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(live)), sizes)
        rank, at = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        rank[:-1], at[:-1] = merges.look_up(symbols[:-1], symbols[1:])
        rank[first + sizes - 1] = NONE
        best = np.minimum.reduceat(rank, first)
        # of overlapping places of the pair every second one, from the left
        hit = np.flatnonzero((rank == best[own]) & (rank < NONE))
        chain = np.ones(len(hit), dtype=bool)
        chain[1:] = np.diff(hit) != 1
        head = hit[np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))] if len(hit) else hit
        hit = hit[(hit - head) % 2 == 0]
        becomes = merges.merged[at[hit]]
        wary = np.bincount(own[hit][~merges.alone[becomes]], minlength=len(live)) > 0
        leftmost = np.ones(len(hit), dtype=bool)
        leftmost[1:] = own[hit][1:] != own[hit][:-1]
        take = leftmost | ~wary[own[hit]]
        hit, becomes = hit[take], becomes[take]
        symbols = symbols.copy()
        symbols[hit] = becomes
        gone = np.zeros(len(symbols), dtype=bool)
        gone[hit + 1] = True
        sizes = sizes - np.bincount(own[hit], minlength=len(live))
        ended = (best == NONE) | (sizes == 1)
        out[live[ended]] = sizes[ended]
        symbols = symbols[~gone & ~ended[own]]
        live, sizes = live[~ended], sizes[~ended]
    return out


class Counter:
    """Counts of pre-tokens, each distinct one worked out once."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        keys = span_hash(value_prefix(symbols.astype(np.uint64)), starts, starts + sizes)
        order = np.argsort(keys)
        heads = run_starts(keys[order])
        distinct, pick = keys[order][heads], order[heads]
        which = np.empty(len(keys), np.int64)
        which[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
        if len(self.keys) > KNOWN:
            self.keys, self.counts = self.keys[:0], self.counts[:0]
        place = np.searchsorted(self.keys, distinct)
        seen = np.zeros(len(distinct), dtype=bool)
        inside = place < len(self.keys)
        seen[inside] = self.keys[place[inside]] == distinct[inside]
        found = np.empty(len(distinct), np.int64)
        found[seen] = self.counts[place[seen]]
        new = pick[~seen]
        found[~seen] = count_symbols(symbols[ragged(starts[new], sizes[new])], sizes[new], self.merges)
        self.keys = np.insert(self.keys, place[~seen], distinct[~seen])
        self.counts = np.insert(self.counts, place[~seen], found[~seen])
        return found[which]


def count_block(buf: np.ndarray, offsets: np.ndarray, counter: Counter) -> np.ndarray:
    """Tokens of each text of a block."""
    merges = counter.merges
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
    points = np.where(points == 0x20, ord(MARK), points)
    some = np.diff(offsets) > 0
    points = np.insert(points, chars[:-1][some], ord(MARK))
    first = chars + np.concatenate([[0], np.cumsum(some)])
    if not len(points):
        return np.zeros(len(offsets) - 1, np.int64)
    symbols = merges.symbol[points]
    strange = symbols < 0
    number = merges.number[np.maximum(symbols, 0)]
    new = np.ones(len(points), dtype=bool)
    new[1:] = strange[1:] | strange[:-1] | ~merges.beside[number[:-1], number[1:]]
    new[first[:-1][some]] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(points)))
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    counts = np.where(strange[starts], width[starts], 1)
    more = sizes > 1
    counts[more] = counter.count(symbols, starts[more], sizes[more])
    total = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(total[np.searchsorted(starts, first, "left")])


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(read_model(path))


def _count(batches, path):
    counter = _counter(path)
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "_text"]
        sizes, counts = [], []
        for _, _, buf, offsets in blocks(batch["_text"]):
            sizes.append(np.diff(offsets))
            counts.append(count_block(buf, offsets, counter))
        if counts:
            yield pa.RecordBatch.from_arrays(
                [batch[n] for n in rest] + [pa.array(np.concatenate(x), pa.int64()) for x in (sizes, counts)], names=[*rest, *RESULTS])


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` under the model file ``path``."""
    frame = docs.select(*[c for c in docs.columns if c not in (*RESULTS, "_text")], F.col(text_col).alias("_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "_text")
    return frame.mapInArrow(Lean(_count, path=path), f"{types}n_bytes long, n_tokens long")
