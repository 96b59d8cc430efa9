"""Vectorised word, line and shingle hashing over UTF-8 bytes.

All helpers work on one block: the bytes of several texts laid end to end and
the offset of each text.  Hashes are 64 bit: a polynomial over a fixed random
value per byte, taken from prefix sums modulo 2**64, then mixed.  Equal bytes
give equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = mix(np.arange(1, 257, dtype=_U))
_LOWER_BYTE = _BYTE[LOWER]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, dtype=_U)
        self.down = np.ones(1, dtype=_U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, step in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, step, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))
        return self.up, self.down


_POWERS = _Powers()


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first, last, bytes, offsets)`` over a string column, about
    ``size`` bytes at a time, a text never cut; null counts as empty.
    ``offsets`` has one entry more than there are texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes outside ``[\\x20\\x09-\\x0D]``);
    a word never crosses a text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.zeros(n + 2, dtype=bool)
    word[1:-1] = ~SPACE[buf]
    start, end = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    start[cut] |= word[cut + 1]
    end[cut - 1] |= word[cut]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def prefix(buf: np.ndarray, lower: bool = True) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span."""
    out = np.zeros(len(buf) + 1, dtype=_U)
    up, _ = _POWERS.of(len(buf) + 1)
    np.cumsum((_LOWER_BYTE if lower else _BYTE)[buf] * up[:len(buf)], out=out[1:])
    return out


def value_prefix(values: np.ndarray) -> np.ndarray:
    """Like :func:`prefix` over 64-bit values, each spread by :func:`mix`."""
    out = np.zeros(len(values) + 1, dtype=_U)
    up, _ = _POWERS.of(len(values) + 1)
    np.cumsum(mix(values) * up[:len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _POWERS.of(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased (A-Z) word, and the number of the first word of
    each text (one entry more than there are texts)."""
    starts, ends = spans(buf, offsets)
    hashes = span_hash(prefix(buf), starts, ends)
    return hashes, np.searchsorted(starts, offsets, "left")


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position (``len - n + 1`` entries)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    out, factor = np.zeros(m, dtype=_U), 1
    for i in range(n):
        out += hashes[i:i + m] * _U(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(out)


def sets(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text: the sorted hashes, text after
    text, and the offset of each text.  A text of fewer words has its whole
    sequence as its one shingle; a text without words has none."""
    docs = len(first) - 1
    lengths = np.diff(first)
    own = np.repeat(np.arange(docs), lengths)
    grams = ngrams(hashes, n)
    whole = own[:len(grams)] == own[n - 1:n - 1 + len(grams)]
    values, owner = grams[whole], own[:len(grams)][whole]
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        extra = np.zeros(len(short), dtype=_U)
        for k, d in enumerate(short):
            extra[k] = ngrams(hashes[first[d]:first[d + 1]], int(lengths[d]))[0] + _U(lengths[d])
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(docs + 1))
