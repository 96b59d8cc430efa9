"""Splitting text for byte-level BPE, vectorised, and encoding piece by piece.

The split pattern of the public rank files cuts a text into pieces that are merged
each on its own, so a block of texts needs each distinct piece encoded once.
Texts are split here on whole byte arrays, by a table with the class of every code
point.  The table ``LATIN`` stops at U+0240 and leaves U+001C to U+001F out, so a
caller that uses it names a function for texts beyond it (see ``encode_block``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from driftwise.llm.common import ragged, run_starts
from driftwise.llm.hashing import prefix, span_hash

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CACHE_PIECES = 1_000_000
CACHE_IDS = 1 << 24
POINTS = 0x110000


def _kind(point: int) -> int:
    c = chr(point)
    if point in (0x85, 0xA0) or point in range(9, 14) or point == 32:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


LATIN = np.zeros(POINTS, dtype=np.uint8)
LATIN[:0x240] = [_kind(i) for i in range(0x240)]
FOREIGN = np.zeros(256, dtype=bool)
FOREIGN[0xC9:] = True
FOREIGN[0x1C:0x20] = True


def foreign(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a character that ``LATIN`` does not know."""
    marks = np.concatenate([[0], np.cumsum(FOREIGN[buf], dtype=np.int64)])
    return marks[offsets[1:]] > marks[offsets[:-1]]


def classes(buf: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    kind = kinds[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    width = 2 + (buf[lead] >= 0xE0) + (buf[lead] >= 0xF0)
    for size, bits in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = lead[width == size]
        point = buf[at].astype(np.int32) & bits
        for i in range(1, size):
            point = (point << 6) | (buf[at + i] & 0x3F)
        found = kinds[point]
        for i in range(size):
            kind[at + i] = found
    return kind


def split(buf: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = LATIN) -> np.ndarray:
    """Start of every piece of the texts laid end to end in ``buf``; ``kinds`` is the class of every code point."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(buf, kinds)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    start = new.copy()
    # a run of white space before something else gives its last character away
    space = kind[runs] == SPACE
    a, b = runs[space], ends[space]
    led = ~first[b]
    a, b = a[led], b[led]
    last = b - 1
    for _ in range(3):
        last = last - ((buf[last] & 0xC0) == 0x80)
    start[last] = True
    start[b[buf[last] == 0x20]] = False
    # 's 't 'm 'd 're 've 'll after an apostrophe that starts a piece
    tick = runs[(buf[runs] == 0x27) & (ends - runs == 1)]
    tick = tick[start[tick]]
    tick = tick[(tick + 1 < n) & ~first[tick + 1]]
    x = buf[tick + 1]
    one = np.isin(x, (0x73, 0x74, 0x6D, 0x64))
    y = buf[np.minimum(tick + 2, n - 1)]
    two = ((x == 0x72) & (y == 0x65)) | ((x == 0x76) & (y == 0x65)) | ((x == 0x6C) & (y == 0x6C))
    two &= (tick + 2 < n) & ~first[np.minimum(tick + 2, n)]
    for hit, size in ((tick[one], 2), (tick[two], 3)):
        start[hit + 1] = False
        rest = hit + size
        rest = rest[rest < n]
        start[rest] |= kind[rest] == LETTER
    return np.flatnonzero(start)


class PieceEncoder:
    """Ids of pieces.  ``encode_new`` gives the ids of distinct pieces, one after the
    other, and how many each has; they are kept by the piece's 64-bit hash (which
    includes its length) while there are at most ``CACHE_PIECES`` and ``CACHE_IDS`` ids:
    two of so many pieces share a hash with a chance of about 3e-8."""

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode_new = encode_new
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        ids, sizes = self.encode_new(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, place, sizes)
        self.used += len(ids)

    def encode(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each piece has; pieces end where the next starts."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(buf))
        keys = span_hash(prefix(buf, lower=False), starts, ends)
        order = np.argsort(keys)
        runs = run_starts(keys[order])
        which = np.empty(len(keys), np.int64)
        which[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(keys))))
        pick = order[runs]
        distinct = keys[pick]
        if len(self.keys) > CACHE_PIECES or self.used > CACHE_IDS:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = np.ones(len(distinct), dtype=bool) if not len(self.keys) else self.keys[place] != distinct
        if new.any():
            data = buf.tobytes()
            self._learn(distinct[new], [data[a:b] for a, b in zip(starts[pick[new]].tolist(), ends[pick[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, distinct)
        at, size = self.at[place][which], self.size[place][which]
        return self.flat[ragged(at, size)], size


def encode_block(buf: np.ndarray, offsets: np.ndarray, encoder: PieceEncoder,
                 whole: Callable[[list[str]], list[list[int]]] | None, splitter=split, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, and how many each text has.  ``whole`` encodes texts beyond ``LATIN``
    and the texts marked in ``more``; without it ``splitter`` takes every text."""
    odd = foreign(buf, offsets) if whole else np.zeros(len(offsets) - 1, dtype=bool)
    if whole and more is not None:
        odd |= more
    if not odd.any():
        return _encode_plain(buf, offsets, encoder, splitter)
    plain = np.flatnonzero(~odd)
    sizes = np.diff(offsets)
    sub = buf[ragged(offsets[plain], sizes[plain])]
    ids, counts = _encode_plain(sub, np.concatenate([[0], np.cumsum(sizes[plain])]), encoder, splitter)
    parts = dict(zip(plain.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if len(plain) else {}
    others = np.flatnonzero(odd).tolist()
    for i, found in zip(others, whole([buf[offsets[i]:offsets[i + 1]].tobytes().decode() for i in others]), strict=True):
        parts[i] = np.asarray(found, np.uint32)
    every = [parts[i] for i in range(len(offsets) - 1)]
    return np.concatenate(every), np.array([len(x) for x in every], np.int64)


def _encode_plain(buf, offsets, encoder, splitter):
    starts = splitter(buf, offsets)
    ids, sizes = encoder.encode(buf, starts)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = total[np.searchsorted(starts, offsets, "left")]
    return ids, np.diff(at)
