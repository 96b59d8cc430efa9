"""Token-ID store: raw id payloads in shard files with a minimal perfect hash index.

``write_store`` sorts documents by key across range partitions, encodes them and
writes shard files; ``fetch`` reads documents back by key.  A shard file holds, in
order: the ids of its documents (unsigned, 2 bytes where the vocabulary allows,
else 4), the keys, the record offsets, the index, and a fixed-size tail that says
where each begins.  The index is a minimal perfect hash over the shard's distinct
keys (levels of bit arrays; a key sits in the first level where no other key of
that level has its bit, and the number of bits set before it is its slot); each
slot stores a 32-bit fingerprint of its key, its first record and how many it has.
A lookup costs a few bit tests, one fingerprint and one slice, whatever the size.

Files are written under a name of the task attempt and then moved to their own,
so a task run again after a lost executor leaves one whole file.  They live below
the given folder, on whatever file system its URI names.

Texts are encoded as the tokenizers library does by default, strings of special tokens
included: a text that holds one goes to the library whole.

Defined cases: a null text counts as empty; a null key is stored under the
smallest 64-bit integer; keys are integers (cast to long); rows with one key are
separate records of that key, in the order of their text's hash; a missing key
gives no row; an empty table gives a store without shards.
"""

from __future__ import annotations

import functools
import json
import os
from dataclasses import dataclass
import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwise.llm.common import Lean, partitions, ragged, run_starts, stored
from driftwise.llm.hashing import blocks, mix
from driftwise.llm.pieces import PieceEncoder, encode_block, split

SHARD_BYTES = 64 << 20
NULL_KEY = -(1 << 63)
TAIL = 512
_U = np.uint64
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, first_key long, last_key long"


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys."""

    GAMMA = 2
    LEVELS = 48

    def __init__(self, levels: list[np.ndarray], spare: np.ndarray):
        self.levels, self.spare = levels, spare
        self.before, total = [], 0
        for bits in levels:
            self.before.append(total + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            total = int(self.before[-1][-1])
        self.total = total

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < cls.LEVELS:
            size = max(8, cls.GAMMA * len(keys))
            at = cls.place(keys, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels, np.sort(keys))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not indexed gets any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.place(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[level][at[hit]]
            open_ = open_[~hit]
        if len(self.spare) and len(open_):
            i = np.minimum(np.searchsorted(self.spare, keys[open_]), len(self.spare) - 1)
            same = self.spare[i] == keys[open_]
            out[open_[same]] = self.total + i[same]
        return out

    def dump(self) -> tuple[bytes, dict]:
        body = b"".join(np.packbits(x, bitorder="little").tobytes() for x in self.levels) + self.spare.tobytes()
        return body, {"sizes": [len(x) for x in self.levels], "spare": len(self.spare)}

    @classmethod
    def load(cls, body: bytes, head: dict) -> PerfectHash:
        levels, at = [], 0
        for size in head["sizes"]:
            n = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(body[at:at + n], np.uint8), count=size, bitorder="little").astype(bool))
            at += n
        return cls(levels, np.frombuffer(body[at:], _U))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _U(0xA5A5A5A55A5A5A5A)) >> _U(32)).astype(np.uint32)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 64):
            out += [e.ids for e in tokenizer.encode_batch(texts[i:i + 64], add_special_tokens=False)]
        return out

    def new(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of a space and letters are encoded many in one text: it splits at them again."""
        chained = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == 32 and (97 <= p[1] <= 122 or 65 <= p[1] <= 90)]
        sizes, parts, done = np.zeros(len(pieces), np.int64), [], []
        for at in range(0, len(chained), 500):
            part = chained[at:at + 500]
            e = tokenizer.encode(b"".join([pieces[i] for i in part]).decode(), add_special_tokens=False)
            owners = np.array(e.word_ids, np.int64)
            if owners[-1] == len(part) - 1:
                sizes[part] = np.bincount(owners)
                parts.append(np.array(e.ids, np.uint32))
                done += part
        rest = np.setdiff1d(np.arange(len(pieces)), np.array(done, np.int64)).tolist()
        for i, ids in zip(rest, whole([pieces[i].decode() for i in rest]), strict=True):
            sizes[i] = len(ids)
            parts.append(np.array(ids, np.uint32))
        order = np.array(done + rest, np.int64)
        at = np.empty(len(pieces), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(parts)[ragged(at, sizes)], sizes

    return tokenizer.get_vocab_size(), PieceEncoder(new), whole, added


def _holding(data: bytes, offsets: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Which texts of a block hold one of the tokenizer's added tokens: the library cuts a text there first."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    for token in added:
        at = data.find(token)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, "right")) - 1
            out[text] |= at + len(token) <= offsets[text + 1]
            at = data.find(token, at + 1)
    return out


class _Shard:
    """One shard file while it is written."""

    def __init__(self, fs, folder: str, name: str, width: int, attempt: int):
        self.fs, self.width = fs, width
        self.path, self.draft = f"{folder}/{name}", f"{folder}/.{name}.{attempt}"
        self.out, self.keys, self.counts, self.n = fs.open_output_stream(self.draft), [], [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(ids)

    def close(self) -> dict:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
        runs = run_starts(keys)
        distinct = keys[runs].view(_U)
        index = PerfectHash.build(distinct)
        slot = index.slot(distinct)
        entries = np.zeros(len(distinct), dtype=[("mark", "<u4"), ("first", "<u4"), ("n", "<u4")])
        entries["mark"][slot] = fingerprint(distinct)
        entries["first"][slot] = runs
        entries["n"][slot] = np.diff(np.append(runs, len(keys)))
        body, head = index.dump()
        head = json.dumps(head).encode()
        at, places = self.n * self.width, {}
        for name, part in (("keys", keys.astype("<i8").tobytes()), ("offsets", offsets.tobytes()), ("entries", entries.tobytes()), ("head", head), ("hash", body)):
            self.out.write(part)
            places[name] = [at, len(part)]
            at += len(part)
        self.out.write(json.dumps({"width": self.width, "ids": self.n} | places).encode().ljust(TAIL))
        self.out.close()
        if self.fs.get_file_info(self.path).type != FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.draft, self.path)
        return {"path": self.path, "n_docs": len(keys), "n_tokens": self.n, "first_key": int(keys[0]), "last_key": int(keys[-1])}


def _write(batches, root, tokenizer, end_id, shard_bytes):
    fs, folder = FileSystem.from_uri(root)
    size, encoder, whole, added = _tokenizer(tokenizer)
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    context = TaskContext.get()
    part, seq, shard, rows = context.partitionId(), 0, None, []
    for batch in batches:
        keys = batch["key"].fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
        for first, last, buf, offsets in blocks(batch["text"]):
            ids, counts = encode_block(buf, offsets, encoder, whole, split, _holding(buf.tobytes(), offsets, added))
            closed = np.full(len(ids) + len(counts), end_id, np.uint32)
            inner = np.ones(len(closed), dtype=bool)
            inner[np.cumsum(counts + 1) - 1] = False
            closed[inner] = ids
            if shard is None:
                shard = _Shard(fs, folder, f"shard-{part:06d}-{seq:04d}.ids", width, context.taskAttemptId())
            shard.add(keys[first:last], closed, counts + 1)
            if shard.n * width >= shard_bytes:
                rows.append({"part": part, "seq": seq} | shard.close())
                shard, seq = None, seq + 1
    if shard is not None:
        rows.append({"part": part, "seq": seq} | shard.close())
    if rows:
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)


@dataclass
class TokenStore:
    """A written store: its folder and one manifest row per shard, with ``start``,
    the ids of all documents before the shard."""

    root: str
    manifest: DataFrame


def write_store(docs: DataFrame, root: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> TokenStore:
    """Encode every text, close it with ``end_id`` and write the shards in ascending key order."""
    spark = docs.sparkSession
    fs, folder = FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))
    manifest = stored(dealt.mapInArrow(Lean(_write, root=root, tokenizer=tokenizer, end_id=end_id, shard_bytes=shard_bytes), MANIFEST), "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return TokenStore(root, manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))))


def read_shard(fs, path: str) -> dict:
    """The parts of a shard file but its ids."""
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        f.seek(size - TAIL)
        tail = json.loads(f.read(TAIL))

        def part(name: str) -> bytes:
            f.seek(tail[name][0])
            return f.read(tail[name][1])

        return {"width": tail["width"], "ids": tail["ids"], "keys": np.frombuffer(part("keys"), "<i8"),
                "offsets": np.frombuffer(part("offsets"), "<i8"),
                "entries": np.frombuffer(part("entries"), [("mark", "<u4"), ("first", "<u4"), ("n", "<u4")]),
                "hash": PerfectHash.load(part("hash"), json.loads(part("head")))}


def find(shard: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First record and number of records of each key (none: 0)."""
    keys = keys.view(_U)
    slot = shard["hash"].slot(keys)
    entry = shard["entries"][np.maximum(slot, 0)]
    n = np.where((slot >= 0) & (entry["mark"] == fingerprint(keys)), entry["n"], 0).astype(np.int64)
    return entry["first"].astype(np.int64), n


def _route(batches, shards):
    last = np.array([s[1] for s in shards.value], np.int64)
    first = np.array([s[0] for s in shards.value], np.int64)
    for batch in batches:
        keys = batch["key"].fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(last, keys, "left"), np.searchsorted(first, keys, "right")
        n = np.maximum(hi - lo, 0)
        at = np.repeat(np.arange(len(keys)), n)
        number = lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(at)), pa.array(number.astype(np.int32))], names=["key", "shard"])


def _fetch(batches, root, shards):
    fs, folder = FileSystem.from_uri(root)
    number, shard, f = None, None, None
    for batch in batches:
        numbers = batch["shard"].to_numpy()
        for a, b in zip(runs := run_starts(numbers), [*runs[1:], len(numbers)], strict=True):
            if number != numbers[a]:
                number = int(numbers[a])
                name, start = shards.value[number][2:]
                if f is not None:
                    f.close()
                shard, f = read_shard(fs, f"{folder}/{name}"), fs.open_input_file(f"{folder}/{name}")
            for c in range(a, b, 512):
                yield _records(batch["key"].slice(c, min(512, b - c)), shard, f, start)


def _records(keys: pa.Array, shard: dict, f, base: int) -> pa.RecordBatch:
    found = np.asarray(keys.fill_null(NULL_KEY).to_numpy(zero_copy_only=False), np.int64)
    first, n = find(shard, found)
    out, width = [], shard["width"]
    for i, (record, count) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
        for r in range(record, record + count):
            lo, hi = int(shard["offsets"][r]), int(shard["offsets"][r + 1])
            f.seek(lo * width)
            out.append((i, base + lo, hi - lo, np.frombuffer(f.read((hi - lo) * width), f"<u{width}").astype("<u4").tobytes()))
    at, starts, sizes, ids = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
        names=["key", "start", "n_tokens", "ids"])


def fetch(spark: SparkSession, store: TokenStore, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """For each row of ``keys`` the records of its key: key, ``start``, ``n_tokens``,
    ``ids`` (little-endian unsigned 32-bit integers).  The shards' key ranges (two
    numbers and a name a shard) go to all tasks; ids are read where they are used."""
    listed = [(r["first_key"], r["last_key"], r["path"].rsplit("/", 1)[-1], r["start"]) for r in store.manifest.orderBy("part", "seq").collect()]
    shards = spark.sparkContext.broadcast(listed)
    rows = keys.select(F.col(key_col).cast("long").alias("key"))
    routed = rows.mapInArrow(Lean(_route, shards=shards), "key long, shard int")
    dealt = routed.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "key")
    found = dealt.mapInArrow(Lean(_fetch, root=store.root, shards=shards), "key long, start long, n_tokens long, ids binary")
    return found.withColumnRenamed("key", key_col)
