"""Byte-level BPE encoding and decoding by a monoid tree.

An encoded stretch of text is the list of its pieces with the ids of each.  A text is
halved until its leaves hold at most ``leaf_bytes``; leaves are cut into pieces and
encoded as if they stood alone, and neighbours are joined up the tree.  To join, the
window from the last piece of the left side that ends well before the seam into the
right side is cut and encoded anew and grows (doubling) until one of its cuts meets a
cut of the right side far enough from the window's end.  The cut at a place depends
only on text from there to at most three characters past the piece's end, so pieces
before the window and after the meeting cut, and their ids, provably stay as they are.

A piece of more than ``PIECE_BYTES`` is a tree of its own: its halves are encoded
recursively, and at the seam a window of the last ids of the left and the first of the
right is encoded anew and doubles on the side where it does not fit yet.  It fits when
the ids on either side of its edge, taken as text, are encoded as those same two ids:
a list of ids is what the merges give exactly if every two neighbours in it are.

Decoding halves the ids, and concatenates the bytes up the tree.  Every text goes this
way, in whatever script: which code points are letters, numbers or white space is read
once a worker from the tokenizer library's own pattern engine.

Defined cases: a null text counts as empty and has no ids; repeated rows are
encoded each; special tokens do not exist, their strings are ordinary text;
columns of the input named like the results are replaced.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import Lean, ragged, ranks
from driftwise.llm.hashing import blocks
from driftwise.llm.pieces import LATIN, LETTER, NUMBER, POINTS, SPACE, PieceEncoder, split

LEAF_BYTES = 1 << 14
PIECE_BYTES = 1 << 10
LEAF_IDS = 1 << 14
SEAM = 16
RESULTS = ("ids", "n_tokens")


def leaves(buf: np.ndarray, lo: int, hi: int, leaf_bytes: int) -> list:
    """The tree of ``lo .. hi``: a pair of subtrees, or the bounds of a leaf."""
    if hi - lo <= leaf_bytes:
        return [lo, hi]
    mid = (lo + hi) // 2
    while mid > lo and buf[mid] & 0xC0 == 0x80:
        mid -= 1
    if mid == lo:
        return [lo, hi]
    return [leaves(buf, lo, mid, leaf_bytes), leaves(buf, mid, hi, leaf_bytes)]


def _bounds(tree: list) -> list[tuple[int, int]]:
    return [tuple(tree)] if isinstance(tree[0], int) else _bounds(tree[0]) + _bounds(tree[1])


@dataclass
class Encoded:
    """Pieces of the stretch ``lo .. hi``: where they start, how many ids each has, and the ids."""

    lo: int
    hi: int
    cuts: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray


def join(buf: np.ndarray, left: Encoded, right: Encoded, encoder: PieceEncoder, kinds: np.ndarray) -> Encoded:
    """A stretch from its two sides: what lies around the seam is cut and encoded anew."""
    seam, end = right.lo, right.hi
    at = max(0, int(np.searchsorted(left.cuts, seam - SEAM, "right")) - 1)
    start, reach = int(left.cuts[at]), 4 * SEAM
    while True:
        stop = min(end, seam + reach)
        while stop < end and buf[stop] & 0xC0 == 0x80:
            stop += 1
        fresh = split(buf[start:stop], np.array([0, stop - start]), kinds) + start
        met, after = stop, len(right.cuts)
        if stop < end:
            meet = np.intersect1d(fresh[(fresh >= seam) & (fresh <= stop - SEAM)], right.cuts, assume_unique=True)
            if not len(meet):
                reach *= 2
                continue
            met = int(meet[0])
            fresh, after = fresh[fresh < met], int(np.searchsorted(right.cuts, met))
        ids, sizes = encoder.encode(buf[start:met], fresh - start)
        return Encoded(left.lo, end, np.concatenate([left.cuts[:at], fresh, right.cuts[after:]]),
                       np.concatenate([left.sizes[:at], sizes, right.sizes[after:]]),
                       np.concatenate([left.ids[:int(left.sizes[:at].sum())], ids, right.ids[int(right.sizes[:after].sum()):]]))


def _joined(buf: np.ndarray, tree: list, leaf: dict[int, Encoded], encoder: PieceEncoder, kinds: np.ndarray) -> Encoded:
    if isinstance(tree[0], int):
        return leaf[tree[0]]
    return join(buf, _joined(buf, tree[0], leaf, encoder, kinds), _joined(buf, tree[1], leaf, encoder, kinds), encoder, kinds)


def encode_texts(buf: np.ndarray, offsets: np.ndarray, encoder: PieceEncoder, leaf_bytes: int = LEAF_BYTES,
                 kinds: np.ndarray = LATIN) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, and how many each has: all leaves are encoded at once, then joined."""
    counts = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return np.zeros(0, np.uint32), counts
    trees = [leaves(buf, int(offsets[i]), int(offsets[i + 1]), leaf_bytes) for i in some]
    bounds = [x for t in trees for x in _bounds(t)]
    edges = np.array([b[0] for b in bounds] + [len(buf)])
    cuts = split(buf, edges, kinds)
    ids, sizes = encoder.encode(buf, cuts)
    first = np.searchsorted(cuts, edges)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = total[first]
    if all(isinstance(t[0], int) for t in trees):       # every text is a leaf
        counts[some] = np.diff(at)
        return ids, counts
    leaf = {lo: Encoded(lo, hi, cuts[a:b], sizes[a:b], ids[x:y])
            for (lo, hi), a, b, x, y in zip(bounds, first[:-1], first[1:], at[:-1], at[1:], strict=True)}
    done = [_joined(buf, t, leaf, encoder, kinds).ids for t in trees]
    counts[some] = [len(x) for x in done]
    return np.concatenate(done), counts


def encode_long(piece: bytes, single: Callable[[bytes], list[int]], fits: Callable[[int, int], bool], tokens: list[bytes],
                leaf: int = PIECE_BYTES) -> list[int]:
    """Ids of one long piece: halves are encoded, then joined by windows of ids that grow around the seam."""
    if len(piece) <= leaf:
        return single(piece)
    mid = len(piece) // 2
    left, right = encode_long(piece[:mid], single, fits, tokens, leaf), encode_long(piece[mid:], single, fits, tokens, leaf)
    a = b = 1
    while True:
        window = single(b"".join(tokens[i] for i in (*left[-a:], *right[:b])))
        before = a == len(left) or fits(left[-a - 1], window[0])
        after = b == len(right) or fits(window[-1], right[b])
        if before and after:
            return left[:-a] + window + right[b:]
        a, b = (a if before else min(2 * a, len(left))), (b if after else min(2 * b, len(right)))


@functools.lru_cache(maxsize=1)
def library_kinds() -> np.ndarray:
    """The class of every code point, as the tokenizer library's pattern engine finds them."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, POINTS))))
    kinds = np.zeros(POINTS, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        finder = tiktoken.Encoding(f"kind-{kind}", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = finder.decode_bytes(finder.encode_ordinary(every)).decode()
        kinds[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return kinds


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> list[bytes]:
    """The bytes of every id."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out


@functools.lru_cache(maxsize=2)
def _codec(path: str) -> tuple[tiktoken.Encoding, PieceEncoder]:
    name = "own-" + hashlib.md5(path.encode()).hexdigest()
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})

    tokens = _tokens(path)
    single = encoding._encode_single_piece

    @functools.lru_cache(maxsize=1 << 16)
    def fits(x: int, y: int) -> bool:
        return single(tokens[x] + tokens[y]) == [x, y]

    def new(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [encoding.encode_ordinary(p.decode()) if len(p) <= PIECE_BYTES else encode_long(p, single, fits, tokens) for p in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    return encoding, PieceEncoder(new)


def _encode(batches, path, leaf_bytes):
    _, encoder = _codec(path)
    kinds = library_kinds()
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "_text"]
        for first, last, buf, offsets in blocks(batch["_text"]):
            ids, counts = encode_texts(buf, offsets, encoder, leaf_bytes, kinds)
            ends = np.cumsum(counts, dtype=np.int64) * 4
            packed = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch[n].slice(first, last - first) for n in rest] + [packed.cast(pa.binary()), pa.array(counts, pa.int64())],
                names=[*rest, "ids", "n_tokens"])


def encode(docs: DataFrame, path: str, text_col: str = "text", leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``."""
    frame = docs.select(*[c for c in docs.columns if c not in (*RESULTS, "_text")], F.col(text_col).alias("_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "_text")
    return frame.mapInArrow(Lean(_encode, path=path, leaf_bytes=leaf_bytes), f"{types}ids binary, n_tokens long")


@functools.lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = _tokens(path)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def decoded(ids: np.ndarray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, leaf_ids: int = LEAF_IDS) -> bytes:
    """The bytes of a list of ids: leaves are looked up, halves concatenated."""
    if len(ids) <= leaf_ids:
        return flat[ragged(at[ids], sizes[ids])].tobytes()
    mid = len(ids) // 2
    return decoded(ids[:mid], flat, at, sizes, leaf_ids) + decoded(ids[mid:], flat, at, sizes, leaf_ids)


def _decode(batches, path):
    table = _token_bytes(path)
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "_ids"]
        step = 256
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            out = [decoded(np.frombuffer(x or b"", "<u4"), *table) for x in part["_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part[n] for n in rest] + [pa.array(out, pa.binary())], names=[*rest, "decoded"])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids in ``ids_col`` (null: none)."""
    frame = encoded.select(*[c for c in encoded.columns if c not in ("decoded", "_ids")], F.col(ids_col).alias("_ids"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "_ids")
    return frame.mapInArrow(Lean(_decode, path=path), f"{types}decoded binary")


def _round_trip(batches, path, leaf_bytes):
    def coded():
        for b in _encode(batches, path, leaf_bytes):
            yield pa.RecordBatch.from_arrays([*b.columns, b["ids"]], names=[*b.schema.names, "_ids"])

    yield from _decode(coded(), path)


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded``: both steps in one worker, block by block."""
    frame = docs.select(*[c for c in docs.columns if c not in (*RESULTS, "decoded", "_text", "_ids")], F.col(text_col).alias("_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "_text")
    return frame.mapInArrow(Lean(_round_trip, path=path, leaf_bytes=leaf_bytes), f"{types}ids binary, n_tokens long, decoded binary")
