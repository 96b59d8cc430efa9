"""Language-model scoring by deleted interpolation.

Tokens are the words of a text (A-Z lower-cased, split at ASCII white space) and one
end.  Every training word is a class of its own, and all words that training does not
know share one.  The class of a token is predicted by

    w2(b) * c(u, v) / c(u)  +  w1(b) * c(v) / N  +  w0(b) / classes

from counts of all training texts; ``b`` is the frequency bucket of the context
``u`` (the power of two of its count).  The mixture weights of each bucket are learned
by expectation-maximisation: counts are taken from one part of the training texts
and the likelihood is that of the pair counts of the other, held-out part.

Every count is exact and over all training texts.  The ``VOCABULARY`` most frequent
words are numbered and all tasks know their counts, which makes what is exchanged
small and changes no result.  What tasks exchange are packed arrays, byte plane by byte plane: a block of texts
sends each of its distinct pairs once to the shard of its hash, with the texts that
hold it; the shard adds up the counts, looks the probabilities up and returns one
partial sum per text.  What a block needs itself to put the answers together is made
in a second pass over its texts and meets them there, so it is shuffled once; both
passes mark their blocks, and a difference raises.  Other words, and the pairs that hold one, go under 64-bit hashes
and their counts come back to the block, which knows where they stand.  A word that
every text holds so costs one entry a block.  Only the vocabulary (a fixed number of
entries) and the histogram for the mixture weights (a fixed number of cells) pass the
driver.

Defined cases: a null or empty text is one end; a null id never trains; repeated rows
are scored each; without training texts every class is equally likely and no token is
known; ids are integers (cast to long).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import Lean, cuts, groups, of_planes, partitions, run_starts, stored, to_planes
from driftwise.llm.hashing import blocks, mix, words

VOCABULARY = 65_532
BLOCK_TOKENS = 1_000_000
BLOCK_DOCS = 60_000
ALPHA = 0.1
CELLS = 256     # steps of a quarter of a power of two: down to 2**-64
_U = np.uint64
END = mix(np.array([0xE0D], dtype=_U))[0]
START = mix(np.array([0x57A], dtype=_U))[0]
WORDS, PAIRS, HEAD, OPEN, CELL = range(5)
OUTSIDE = 1 << 16  # from here on, places among a block's words outside the vocabulary


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of a block, each text closed by an end, and where texts start."""
    hashes, first = words(buf, offsets)
    out = np.full(len(hashes) + len(offsets) - 1, END, dtype=_U)
    inner = np.ones(len(out), dtype=bool)
    inner[first[1:] + np.arange(len(offsets) - 1)] = False
    out[inner] = hashes
    return out, first + np.arange(len(offsets))


def _gathered(batches, names):
    """Blocks of about ``BLOCK_TOKENS`` tokens and at most ``BLOCK_DOCS`` texts: the block's id, its
    tokens, their text starts, and the named columns.  The id is made of ``place``, the number of
    the rows' partition, so two passes over the same rows give the same blocks."""
    held, at, columns, size, docs, number = [], [], {n: [] for n in names}, 0, 0, 0

    def made():
        nonlocal held, at, columns, size, docs, number
        sizes = np.concatenate(at)
        assert len(sizes) <= BLOCK_DOCS         # texts are numbered in 16 bits
        out = (place << 32) | number, np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)]), {n: pa.concat_arrays(c) for n, c in columns.items()}
        held, at, columns, size, docs, number = [], [], {n: [] for n in names}, 0, 0, number + 1
        return out

    for batch in batches:
        place = batch["place"][0].as_py() if batch.num_rows else 0
        for part in (batch.slice(i, BLOCK_DOCS) for i in range(0, batch.num_rows, BLOCK_DOCS)):
            for first, last, buf, offsets in blocks(part["text"]):
                if held and docs + last - first > BLOCK_DOCS:
                    yield made()
                found, starts = tokens(buf, offsets)
                held.append(found)
                at.append(np.diff(starts))
                for n in names:
                    columns[n].append(part[n].slice(first, last - first))
                size, docs = size + len(found), docs + last - first
                if size >= BLOCK_TOKENS:
                    yield made()
    if held:
        yield made()


# ------------------------------------------------------------ vocabulary
def _send_words(batches, shards):
    for _, found, starts, columns in _gathered(batches, ["part"]):
        part = np.repeat(columns["part"].to_numpy(), np.diff(starts))
        order = np.argsort(found)
        keys, held = found[order], part[order] == 1
        runs = run_starts(keys)
        counts = np.diff(np.append(runs, len(keys)))
        apart = np.add.reduceat(held.astype(np.int64), runs)
        keys = keys[runs]
        at = cuts(keys, shards)
        some = np.flatnonzero(np.diff(at)).tolist()
        cut = lambda x, t: pa.array([to_planes(x[at[s]:at[s + 1]].astype(t)) for s in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), cut(keys, _U), cut(counts, np.uint32), cut(apart, np.uint32)],
                                         names=["shard", "keys", "counts", "apart"])


def _all(rows, column, dtype) -> np.ndarray:
    return np.concatenate([of_planes(r[column], dtype) for r in rows])


def _count_words(batches, most):
    for _, rows in groups(batches, "shard"):
        keys, counts, apart = (_all(rows, c, t) for c, t in (("keys", _U), ("counts", np.uint32), ("apart", np.uint32)))
        order = np.argsort(keys)
        runs = run_starts(keys[order])
        total, apart = np.add.reduceat(counts[order].astype(np.int64), runs), np.add.reduceat(apart[order].astype(np.int64), runs)
        keys = keys[order][runs]
        top = np.lexsort((keys, -total))[:most]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([keys[top].view(np.int64), [0]])), pa.array(np.concatenate([total[top], [total.sum()]])),
             pa.array(np.concatenate([apart[top], [apart.sum()]])), pa.array(np.concatenate([np.zeros(len(top), np.int64), [len(keys)]]))],
            names=["key", "count", "apart", "types"])


class Model:
    """Vocabulary, totals and mixture weights; all of fixed size."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, apart: np.ndarray, total: int, total_apart: int, types: int, texts: int, texts_apart: int):
        order = np.argsort(keys)
        self.keys = keys[order]
        rest, rest_apart = total - counts.sum(), total_apart - apart.sum()
        # classes: the vocabulary, the rare words, and the start (as a context only)
        self.counts = np.concatenate([counts[order], [rest, texts]]).astype(np.float64)
        self.apart = np.concatenate([apart[order], [rest_apart, texts_apart]]).astype(np.float64)
        self.total, self.total_apart, self.types = total, total_apart, types
        self.rare, self.start = len(keys), len(keys) + 1
        self.weights = np.tile([0.2, 0.3, 0.5], (64, 1))  # of uniform, single, pair

    def classes(self, found: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(found), np.uint32)
        i = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return np.where(self.keys[i] == found, i, self.rare).astype(np.uint32)

    def pairs(self, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Context and token class of every token, as one number."""
        own = self.classes(found)
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[starts[:-1]] = self.start
        return (before << np.uint32(16)) | own

    def parts(self, pairs: np.ndarray, together: np.ndarray, fit_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of the context, and the pair and single estimates."""
        counts = self.counts - self.apart if fit_only else self.counts
        return self.estimates(counts[pairs >> np.uint32(16)], counts[pairs & np.uint32(0xFFFF)], together, fit_only)

    def estimates(self, context: np.ndarray, single: np.ndarray, together: np.ndarray, fit_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = self.total - self.total_apart if fit_only else self.total
        bucket = np.floor(np.log2(context + 1)).astype(np.int64)
        return bucket, together / np.maximum(context, 1), single / max(total, 1)

    def mixed(self, bucket: np.ndarray, pair: np.ndarray, single: np.ndarray) -> np.ndarray:
        w = self.weights[bucket]
        return np.log10(w[:, 0] / (self.types + 1) + w[:, 1] * single + w[:, 2] * pair)

    def log10(self, pairs: np.ndarray, together: np.ndarray) -> np.ndarray:
        return self.mixed(*self.parts(pairs, together, fit_only=False))

    def known(self, codes: np.ndarray, words: np.ndarray, fit_only: bool) -> np.ndarray:
        """Counts of classes, and of the block's ``words`` outside the vocabulary (from ``OUTSIDE`` on)."""
        counts = self.counts - self.apart if fit_only else self.counts
        out = counts[np.where(codes < OUTSIDE, codes, 0)]
        out[codes >= OUTSIDE] = words[codes[codes >= OUTSIDE] - OUTSIDE]
        return out


def vocabulary(texts: DataFrame, size: int) -> Model:
    spark = texts.sparkSession
    shards = max(4, partitions(spark))
    train = texts.where("part > 0")
    sent = train.select("text", "part", "place").mapInArrow(Lean(_send_words, shards=shards), "shard int, keys binary, counts binary, apart binary")
    # a shard's share of the vocabulary, with ample room: keys are dealt by hash
    counted = (sent.repartition(shards, "shard").sortWithinPartitions("shard")
               .mapInArrow(Lean(_count_words, most=4 * size // shards + 64), "key long, count long, apart long, types long"))
    top = counted.orderBy(F.desc("types"), F.desc("count"), "key").limit(size + shards).collect()
    totals = [r for r in top if r["types"]]
    kept = [r for r in top if not r["types"]][:size]
    texts_n = train.agg(F.count("*").alias("n"), F.count(F.when(F.col("part") == 1, 1)).alias("apart")).first()
    column = lambda rows, c: np.array([r[c] for r in rows], np.int64)
    return Model(column(kept, "key").view(_U), column(kept, "count"), column(kept, "apart"), int(column(totals, "count").sum()),
                 int(column(totals, "apart").sum()), int(column(totals, "types").sum()), texts_n["n"], texts_n["apart"])


# ------------------------------------------------------------ mixture weights
def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(keys) >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _distinct(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by shard, where each shard's start, and the place of every key among them."""
    names, inverse = np.unique(keys, return_inverse=True)
    which = _shard_of(names, shards)
    order = np.argsort(which, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return names[order], np.searchsorted(which[order], np.arange(shards + 1)), place[inverse]


def _outside(model: Model, found: np.ndarray, starts: np.ndarray, pairs: np.ndarray):
    """Where words outside the vocabulary stand, where pairs that hold one end, and the hashes of those pairs."""
    rare = (pairs & np.uint32(0xFFFF)) == model.rare
    open_ = rare | ((pairs >> np.uint32(16)) == model.rare)
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[starts[:-1]] = START
    return rare, open_, mix(mix(before[open_]) + found[open_])


def _codes(pairs: np.ndarray, rare_class: int, rare: np.ndarray, open_: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and token of the open pairs: classes, or places among the words outside the vocabulary."""
    own = pairs & np.uint32(0xFFFF)
    own[rare] = OUTSIDE + place
    at = np.flatnonzero(open_)
    context = pairs[at] >> np.uint32(16)
    outside = context == rare_class
    context[outside] = own[at[outside] - 1]
    return context, own[at]


TRAINED = "block long, shard int, kind int, keys binary, counts binary, apart binary, u binary, v binary"
_TRAINED = [x.split()[0] for x in TRAINED.split(", ")]


def _rows_of(names, block, kind, at, more=None, **columns):
    """One row a shard of arrays in the order of the shards."""
    more = more or {}
    for i in np.flatnonzero(np.diff(at)).tolist():
        yield _row(names, block=block, shard=i, kind=kind, **{n: to_planes(x[at[i]:at[i + 1]]) for n, x in columns.items()}, **more)


def _send_pairs(batches, model, shards):
    model = model.value
    for block, found, starts, columns in _gathered(batches, ["part"]):
        pairs = model.pairs(found, starts)
        apart = np.repeat(columns["part"].to_numpy(), np.diff(starts)) == 1
        rare, open_, hashes = _outside(model, found, starts, pairs)
        both = lambda place, n, held: (np.bincount(place, weights=w, minlength=n).astype(np.uint32) for w in (~held, held))
        keys, at, place = _distinct(pairs[~open_].astype(_U), shards)
        fit, held = both(place, len(keys), apart[~open_])
        yield from _rows_of(_TRAINED, block, PAIRS, at, keys=keys.astype(np.uint32), counts=fit, apart=held)
        if not open_.any():
            continue
        keys, at, place = _distinct(hashes, shards)
        fit, held = both(place, len(keys), apart[open_])
        yield from _rows_of(_TRAINED, block, OPEN, at, keys=keys, counts=fit, apart=held)
        keys, at, word = _distinct(found[rare], shards)
        u, v = _codes(pairs, model.rare, rare, open_, word)
        first = np.empty(len(held), np.int64)
        first[place] = np.arange(len(place))
        u, v = u[first[held > 0]], v[first[held > 0]]
        # of the words, only those in held-out pairs are answered
        asked = np.zeros(len(keys), bool)
        for codes in (u, v):
            asked[codes[codes >= OUTSIDE] - OUTSIDE] = True
        among = np.cumsum(asked) - 1
        for codes in (u, v):
            codes[codes >= OUTSIDE] = OUTSIDE + among[codes[codes >= OUTSIDE] - OUTSIDE]
        fit, _ = both(word, len(keys), apart[rare])
        yield from _rows_of(_TRAINED, block, WORDS, at, keys=keys, counts=fit, apart=asked.astype(np.uint32))
        if len(u):
            yield _row(_TRAINED, block=block, shard=block % shards, kind=HEAD, u=to_planes(u), v=to_planes(v), apart=to_planes(held[held > 0]))


def _told(rows, kind):
    """For each row of the kind, its keys' counts over all blocks."""
    rows = [r for r in rows if r["kind"] == kind]
    if not rows:
        return
    keys = [of_planes(r["keys"], _U) for r in rows]
    every = np.concatenate(keys)
    order = np.argsort(every)
    at = run_starts(every[order])
    counts = _all(rows, "counts", np.uint32).astype(np.int64)
    per = np.empty(len(every), np.int64)
    per[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.append(at, len(every))))
    yield from zip(rows, np.split(per, np.cumsum([len(k) for k in keys])[:-1]), strict=True)


CELL_NAMES = ("cell", "bucket", "n", "pair", "single")


def _cells(held, bucket, pair, single) -> dict[str, np.ndarray]:
    grid = lambda p: np.where(p > 0, 1 + np.clip(np.floor(-4 * np.log2(np.maximum(p, 1e-30))), 0, CELLS - 1), 0).astype(np.int64)
    cell = (bucket * (CELLS + 1) + grid(pair)) * (CELLS + 1) + grid(single)
    names, inverse = np.unique(cell, return_inverse=True)
    add = lambda x: np.bincount(inverse, weights=x, minlength=len(names)).astype(np.float64)
    return dict(zip(CELL_NAMES, (names, names // (CELLS + 1) ** 2, add(held), add(held * pair), add(held * single)), strict=True))


TOLD = "block long, shard int, kind int, told binary, u binary, v binary, apart binary, " + ", ".join(f"{c} binary" for c in CELL_NAMES)
_TOLD = [x.split()[0] for x in TOLD.split(", ")]


def _histogram(batches, model):
    """Held-out pair counts by bucket and by rounded logarithms of the two estimates;
    of words outside the vocabulary and their pairs, the counts for the blocks that asked."""
    for shard, rows in groups(batches, "shard"):
        pairs = [r for r in rows if r["kind"] == PAIRS]
        if pairs:
            keys, fit, held = (_all(pairs, c, np.uint32) for c in ("keys", "counts", "apart"))
            order = np.argsort(keys)
            runs = run_starts(keys[order])
            fit, held = np.add.reduceat(fit[order].astype(np.int64), runs), np.add.reduceat(held[order].astype(np.int64), runs)
            keys = keys[order][runs]
            found = _cells(held[held > 0], *model.value.parts(keys[held > 0], fit[held > 0], fit_only=True))
            yield _row(_TOLD, block=-1 - shard, shard=shard, kind=CELL, **{n: x.tobytes() for n, x in found.items()})
        for kind in (WORDS, OPEN):
            for r, counts in _told(rows, kind):
                asked = counts[of_planes(r["apart"], np.uint32) > 0]
                if len(asked):
                    yield _row(_TOLD, block=r["block"], shard=shard, kind=kind, told=to_planes(asked))
        for r in rows:
            if r["kind"] == HEAD:
                yield _row(_TOLD, **{n: r.get(n) for n in ("block", "shard", "kind", "u", "v", "apart")})


def _answers(rows, kind):
    """What the shards told a block, in the order in which it asked."""
    told = sorted((r["shard"], r["told"]) for r in rows if r["kind"] == kind)
    return np.concatenate([np.zeros(0, np.int64), *[of_planes(x, np.int64) for _, x in told]])


def _open_cells(batches, model):
    for block, rows in groups(batches, "block"):
        if block < 0:
            found = [{n: np.frombuffer(r[n], np.int64 if n in ("cell", "bucket") else np.float64) for n in CELL_NAMES} for r in rows]
        else:
            head = next((r for r in rows if r["kind"] == HEAD), None)
            if head is None:
                continue
            u, v, held = (of_planes(head[c], np.uint32) for c in ("u", "v", "apart"))
            words = _answers(rows, WORDS)
            context, single = (model.value.known(x, words, fit_only=True) for x in (u, v))
            found = [_cells(held, *model.value.estimates(context, single, _answers(rows, OPEN), fit_only=True))]
        for x in found:
            yield pa.RecordBatch.from_arrays([pa.array(x[n]) for n in CELL_NAMES], names=list(CELL_NAMES))


def mixture(rows: list, classes: int, rounds: int = 30) -> np.ndarray:
    """Weights of (uniform, single, pair) for each bucket by expectation-maximisation;
    a bucket without held-out pairs takes those of the nearest that has some."""
    weights = np.full((64, 3), np.nan)
    table = np.array([(r["bucket"], r["n"], r["single"], r["pair"]) for r in rows], np.float64).reshape(-1, 4)
    for b in np.unique(table[:, 0]).astype(int).tolist():
        n, single, pair = table[table[:, 0] == b, 1:].T
        p = np.stack([np.full(len(n), 1 / classes), single / n, pair / n], axis=1)
        w = np.array([0.2, 0.3, 0.5])
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = np.maximum(n @ share / n.sum(), 1e-6)
            w /= w.sum()
        weights[b] = w
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    if not len(known):
        return np.tile([0.2, 0.3, 0.5], (64, 1))
    return weights[known[np.abs(np.arange(64)[:, None] - known[None, :]).argmin(axis=1)]]


def placed(texts: DataFrame) -> DataFrame:
    """``texts`` with ``place``, the number of each row's partition.  Blocks are made twice, so
    texts that come out of a shuffle, whose order may change, are stored first."""
    if "Exchange" in texts._jdf.queryExecution().executedPlan().toString():
        texts = stored(texts, "model-texts")
    return texts.withColumn("place", F.spark_partition_id().cast("long"))


def train(texts: DataFrame, size: int = VOCABULARY) -> Model:
    """The model of the rows of ``texts`` (text, part, place) whose part is not 0; part 1 is held out for the weights."""
    spark = texts.sparkSession
    if not 0 < size <= VOCABULARY:
        raise ValueError(f"the vocabulary holds 1 to {VOCABULARY} words")
    model = vocabulary(texts, size)
    shards = max(4, partitions(spark))
    shared = spark.sparkContext.broadcast(model)
    sent = (texts.where("part > 0").select("text", "part", "place")
            .mapInArrow(Lean(_send_pairs, model=shared, shards=shards), TRAINED))
    told = sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(Lean(_histogram, model=shared), TOLD)
    cells = (told.repartition(partitions(spark), "block").sortWithinPartitions("block")
             .mapInArrow(Lean(_open_cells, model=shared), "cell long, bucket long, n double, pair double, single double")
             .groupBy("cell", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "pair", "single")]))
    model.weights = mixture(cells.collect(), model.types + 1)
    return model


# ------------------------------------------------------------ scores
SCORED = "block long, mark long, shard int, kind int, keys binary, counts binary, runs binary, docs binary, train binary"


def _row(names, **values):
    kinds = {"block": pa.int64(), "mark": pa.int64(), "shard": pa.int32(), "kind": pa.int32(), "ids": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds.get(n, pa.binary())) for n in names], names=names)


_NAMES = [x.split()[0] for x in SCORED.split(", ")]


def _by_shard(block, mark, kind, keys, docs, which, shards, train):
    """One row a shard: distinct keys, how many occurrences each has, and their texts."""
    order = np.lexsort((keys, which))
    keys, docs, which = keys[order], docs[order], which[order]
    at = np.searchsorted(which, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(at)).tolist():
        own = keys[at[s]:at[s + 1]]
        runs = run_starts(own)
        yield _row(_NAMES, block=block, mark=mark, shard=s, kind=kind, keys=to_planes(own[runs]), train=train,
                   runs=to_planes(np.diff(np.append(runs, len(own))).astype(np.uint32)), docs=to_planes(docs[at[s]:at[s + 1]]))


def _mark(found: np.ndarray, starts: np.ndarray) -> int:
    """A number of a block's tokens in their order: both passes must have seen the same."""
    place = np.arange(1, len(found) + 1, dtype=_U)
    return int((mix(found + place).sum(dtype=_U) + mix(starts.astype(_U)).sum(dtype=_U)).view(np.int64))


def _send_scores(batches, model, shards):
    """What a block asks the shards: its distinct pairs and words."""
    model = model.value
    for block, found, starts, columns in _gathered(batches, ["part"]):
        n, mark = len(starts) - 1, _mark(found, starts)
        docs = np.repeat(np.arange(n, dtype=np.uint16), np.diff(starts))
        trains = columns["part"].to_numpy() > 0
        pairs = model.pairs(found, starts)
        rare, open_, hashes = _outside(model, found, starts, pairs)
        yield from _by_shard(block, mark, PAIRS, pairs[~open_], docs[~open_], _shard_of(pairs[~open_].astype(_U), shards), shards, np.packbits(trains).tobytes())
        weight = trains[docs].astype(np.int64)
        for kind, wanted, own in ((WORDS, found[rare], weight[rare]), (OPEN, hashes, weight[open_])):
            keys, at, place = _distinct(wanted, shards)
            yield from _rows_of(_NAMES, block, kind, at, {"mark": mark}, keys=keys, counts=np.bincount(place, weights=own, minlength=len(keys)).astype(np.uint32))


ANSWERED = ("block long, mark long, shard int, kind int, told binary, ids array<long>, docs binary, pairs binary, base binary, n binary, known binary, "
            "u binary, v binary, runs binary")
_ANSWER = [x.split()[0] for x in ANSWERED.split(", ")]


def _heads(batches, model, shards):
    """What a block needs to put its answers together: the second pass over the texts, which goes
    straight to where the answers arrive."""
    model = model.value
    for block, found, starts, columns in _gathered(batches, ["id"]):
        n = len(starts) - 1
        docs = np.repeat(np.arange(n, dtype=np.uint16), np.diff(starts))
        pairs = model.pairs(found, starts)
        own = pairs & np.uint32(0xFFFF)
        rare, open_, hashes = _outside(model, found, starts, pairs)
        base = np.bincount(docs[~rare], weights=np.log10(model.counts[own[~rare]] + ALPHA), minlength=n)
        known = np.bincount(docs[~rare], minlength=n)
        _, _, word = _distinct(found[rare], shards)
        keys, _, place = _distinct(hashes, shards)
        u, v = _codes(pairs, model.rare, rare, open_, word)
        order = np.argsort(place, kind="stable")
        first = order[run_starts(place[order])]
        yield _row(_ANSWER, block=block, mark=_mark(found, starts), kind=HEAD, ids=columns["id"].to_pylist(), base=base.tobytes(),
                   n=np.diff(starts).astype(np.int64).tobytes(), known=known.astype(np.int64).tobytes(), u=to_planes(u[first]), v=to_planes(v[first]),
                   runs=to_planes(np.bincount(place, minlength=len(keys)).astype(np.uint32)), docs=to_planes(docs[open_][order]))


def _values(rows, kind, dtype, value):
    """For each row, per occurrence: its text and what ``value`` says of the training counts."""
    rows = [r for r in rows if r["kind"] == kind]
    if not rows:
        return
    keys = [of_planes(r["keys"], dtype) for r in rows]
    runs = [of_planes(r["runs"], np.uint32) for r in rows]
    docs = [of_planes(r["docs"], np.uint16) for r in rows]
    counts = []
    for r, n, d in zip(rows, runs, docs, strict=True):
        flags = np.unpackbits(np.frombuffer(r["train"], np.uint8))[d].astype(np.int64)
        counts.append(np.add.reduceat(flags, np.cumsum(n, dtype=np.int64) - n))
    every = np.concatenate(keys)
    order = np.argsort(every)
    at = run_starts(every[order])
    total = np.add.reduceat(np.concatenate(counts)[order], at)
    per = np.empty(len(every), np.int64)
    per[order] = np.repeat(total, np.diff(np.append(at, len(every))))
    for r, k, n, d, c in zip(rows, keys, runs, docs, np.split(per, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
        yield r, d, np.repeat(value(k, c), n)


def _answer(batches, model):
    """Partial sums per text, one row a block and shard, and the counts for what is outside the vocabulary."""
    model = model.value
    for shard, rows in groups(batches, "shard"):
        for r, docs, value in _values(rows, PAIRS, np.uint32, model.log10):
            sums = np.bincount(docs, weights=value)
            touched = np.flatnonzero(np.bincount(docs))
            yield _row(_ANSWER, block=r["block"], mark=r["mark"], shard=shard, kind=PAIRS, docs=to_planes(touched.astype(np.uint16)),
                       pairs=to_planes(sums[touched]))
        for kind in (WORDS, OPEN):
            for r, counts in _told(rows, kind):
                yield _row(_ANSWER, block=r["block"], mark=r["mark"], shard=shard, kind=kind, told=to_planes(counts))


def _total(batches, model):
    model = model.value
    for _, rows in groups(batches, "block"):
        head = next((r for r in rows if r["kind"] == HEAD), None)
        if head is None or any(r["mark"] != head["mark"] for r in rows):
            raise RuntimeError("the texts came in another order the second time: store them first")
        n, base, known = (np.frombuffer(head[c], t).copy() for c, t in (("n", np.int64), ("base", np.float64), ("known", np.int64)))
        u, v, runs = (of_planes(head[c], np.uint32) for c in ("u", "v", "runs"))
        docs, words_ = of_planes(head["docs"], np.uint16), _answers(rows, WORDS)
        context, single = (model.known(x, words_, fit_only=False) for x in (u, v))
        value = model.mixed(*model.estimates(context, single, _answers(rows, OPEN), fit_only=False))
        pairs = np.zeros(len(n)) + np.bincount(docs, weights=np.repeat(value, runs), minlength=len(n))
        outside = v >= OUTSIDE
        base += np.bincount(docs, weights=np.repeat(np.where(outside, np.log10(single + ALPHA), 0), runs), minlength=len(n))
        known += np.bincount(docs[np.repeat(outside & (single > 0), runs)], minlength=len(n))
        for r in sorted((r for r in rows if r["kind"] == PAIRS), key=lambda r: r["shard"]):
            pairs[of_planes(r["docs"], np.uint16)] += of_planes(r["pairs"], np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(head["ids"], pa.int64()), pa.array(n), pa.array(np.where(model.total > 0, known, 0)),
             pa.array(base - n * np.log10(model.total + ALPHA * (model.types + 1))), pa.array(pairs)],
            names=["id", "n_tokens", "n_known", "base_score", "score"])


def score(texts: DataFrame, model: Model) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``texts``
    (id, text, part, place): ``score`` is the model's log10 probability of the text and
    ``base_score`` that of single smoothed words; rows of part 0 add nothing to counts."""
    spark = texts.sparkSession
    shards = max(4, partitions(spark))
    shared = spark.sparkContext.broadcast(model)
    sent = texts.select("text", "part", "place").mapInArrow(Lean(_send_scores, model=shared, shards=shards), SCORED)
    answers = sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(Lean(_answer, model=shared), ANSWERED)
    heads = texts.select("id", "text", "place").mapInArrow(Lean(_heads, model=shared, shards=shards), ANSWERED)
    total = (answers.union(heads).repartition(partitions(spark), "block").sortWithinPartitions("block")
             .mapInArrow(Lean(_total, model=shared), "id long, n_tokens long, n_known long, base_score double, score double"))
    return total.select("id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_corpus(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text", size: int = VOCABULARY) -> DataFrame:
    """Train on the rows of ``docs`` whose ``part`` is not 0 (1: held out for the weights) and score all."""
    texts = placed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                               F.when(F.col(id_col).isNull(), 0).otherwise(part).cast("int").alias("part")))
    return score(texts, train(texts, size)).withColumnRenamed("id", id_col)
