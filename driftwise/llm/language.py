"""Language ID by a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of
byte n-grams (1 to 4 bytes, A-Z lower-cased) that both hold, over the geometric
mean of the numbers that each holds.  Nystroem landmarks (``per_language`` texts of each
language) turn it into features, and one-versus-rest kernel ridge regression is solved
on them.  Landmarks and regression come from at most ``fit_rows`` labelled texts, those
of the smallest hashed id; the model (the landmarks' n-grams, a bit per n-gram and
landmark, and one matrix) has a size set by the parameters, the number of languages and
the landmarks' lengths.

The kernel is exact.  In a block each n-gram gets a number of its own: a pair of bytes its
rank among the block's pairs, three bytes a pair and a byte, four bytes two pairs.  So
a text's distinct n-grams are found with one small table, and those that some landmark
holds by a second one; blocks with too many pairs for such tables are sorted instead.
The rows of landmark bits of all hits are added up text by text, which is the sparse
matrix product of texts and landmarks, and a second product gives the scores.  Every
text is scored in one pass without a shuffle.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; so
does every text when nothing can be learned; null labels and ids are not learned
from; of several rows of one id the smallest (label, text) counts; a language with no
row among those that are fitted is never predicted.  Equal scores go to the language
that sorts first.  Columns named like the results are replaced.
"""

from __future__ import annotations

import pickle
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import Lean
from driftwise.llm.hashing import LOWER, blocks

SPECTRUM = 4
MOST_PAIRS = 4096       # pairs of bytes in a block, up to which tables are used
PRODUCT = 1 << 22       # bits of landmarks that are added up at once
FIT_ROWS = 8_000
PER_LANGUAGE = 16
MOST_LANDMARKS = 1024
RIDGE = 1e-3
UNKNOWN = "und"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def grams(text: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one text as sorted numbers: the length above the bytes."""
    low = LOWER[text].astype(np.uint64)
    found, value = [], np.zeros(len(low), np.uint64)
    for n in range(1, min(SPECTRUM, len(low)) + 1):
        value = (value[:len(low) - n + 1] << np.uint64(8)) | low[n - 1:]
        found.append(value | np.uint64(n << 32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _among(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in the sorted ``keys`` of those of ``found`` that are there."""
    at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
    return at[keys[at] == found] if len(keys) else at[:0]


def spectra(buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text of a block the number of its distinct n-grams; and which of the sorted ``keys``
    are among them, text after text, with each text's start."""
    size, hits = np.zeros(len(offsets) - 1, np.int64), []
    bounds = list(enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)))
    low = LOWER[buf]
    pair = (low[:-1].astype(np.int32) << 8) | low[1:]
    present = np.zeros(1 << 16, dtype=bool)
    present[pair] = True
    pairs = int(present.sum())
    if pairs > MOST_PAIRS:
        for i, (a, b) in bounds:
            own = grams(buf[a:b])
            size[i] = len(own)
            hits.append(_among(own, keys))
    else:
        rank = (np.cumsum(present) - 1).astype(np.int32)
        ranks = rank[pair]
        codes = [low.astype(np.int32), ranks, ranks[:-1] * 256 + low[2:], ranks[:-2] * pairs + ranks[2:]]
        tables = []
        for n, slots in enumerate((256, pairs, 256 * pairs, pairs * pairs), 1):
            own = np.flatnonzero(keys >> np.uint64(32) == n)
            value = (keys[own] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            head, tail = (value, None) if n < 3 else (value >> 8 * (n - 2), value & (256 ** (n - 2) - 1))
            inside = np.ones(len(own), dtype=bool) if n == 1 else present[head] & (present[tail] if n == 4 else True)
            head, own, tail = head[inside], own[inside], None if tail is None else tail[inside]
            code = head if n == 1 else rank[head] if n == 2 else rank[head] * 256 + tail if n == 3 else rank[head] * pairs + rank[tail]
            table = np.full(max(1, slots), -1, np.int32)
            table[code] = own
            tables.append(table)
        place, count = np.empty(max(256, 256 * pairs, pairs * pairs), np.int32), np.arange(int(np.diff(offsets).max(initial=0)), dtype=np.int32)
        for i, (a, b) in bounds:
            found = []
            for n in range(1, min(SPECTRUM, b - a) + 1):
                own = codes[n - 1][a:b - n + 1]
                place[own] = count[:len(own)]
                own = own[place[own] == count[:len(own)]]      # the last place of each n-gram
                size[i] += len(own)
                known = tables[n - 1][own]
                found.append(known[known >= 0])
            hits.append(np.concatenate(found) if found else np.zeros(0, np.int32))
    first = np.concatenate([[0], np.cumsum([len(h) for h in hits])]).astype(np.int64)
    return size, np.concatenate([np.zeros(0, np.int64), *hits]).astype(np.int64), first


def kernel(buf: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    """Kernel of each text of a block with each landmark: the hits' rows of landmark bits, added
    up text by text."""
    size, hits, first = spectra(buf, offsets, model["keys"])
    width = len(model["sizes"])
    both = np.zeros((len(size), width), np.int64)
    step = max(1, PRODUCT // max(1, width))
    for at in range(0, len(hits), step):
        rows = np.unpackbits(model["bits"][hits[at:at + step]], axis=1, count=width)
        a = int(np.searchsorted(first, at, "right")) - 1
        starts = np.maximum(first[a:-1], at)
        starts = starts[starts < at + len(rows)]
        texts = a + np.flatnonzero(np.diff(np.append(starts, at + len(rows))))      # texts with a hit here
        both[texts] += np.add.reduceat(rows, first[texts].clip(at) - at, axis=0, dtype=np.int64)
    return both / np.sqrt(np.maximum(size, 1)[:, None] * model["sizes"][None, :])


def landmark_model(landmarks: list[np.ndarray]) -> dict:
    """The landmarks' n-grams and, for each, a bit per landmark that holds it."""
    keys = np.unique(np.concatenate(landmarks))
    holds = np.zeros((len(keys), len(landmarks)), dtype=bool)
    for j, own in enumerate(landmarks):
        holds[np.searchsorted(keys, own), j] = True
    return {"keys": keys, "bits": np.packbits(holds, axis=1), "sizes": np.array([len(x) for x in landmarks], np.float64)}


def _block(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def _kernels(texts: list[str], model: dict) -> np.ndarray:
    return np.concatenate([kernel(*_block(texts[i:i + 64]), model) for i in range(0, len(texts), 64)])


def fit(rows: list[tuple[str, str]], per_language: int = PER_LANGUAGE, ridge: float = RIDGE) -> dict:
    """Landmarks, languages and the matrix from kernel values to scores, of (text, language) rows."""
    names = sorted({lang for _, lang in rows})
    share = max(1, min(per_language, MOST_LANDMARKS // max(1, len(names))))
    taken, landmarks = dict.fromkeys(names, 0), []
    for text, lang in rows:
        if taken[lang] < share and text:
            taken[lang] += 1
            landmarks.append(text)
    if not landmarks:
        return {"names": []}
    model = landmark_model([grams(_block([t])[0]) for t in landmarks])
    values, vectors = np.linalg.eigh(_kernels(landmarks, model))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    x = _kernels([t for t, _ in rows], model) @ whiten
    y = np.array([[lang == n for n in names] for _, lang in rows], np.float64)
    weights = np.linalg.solve(x.T @ x + ridge * len(rows) * np.eye(x.shape[1]), x.T @ y)
    return model | {"names": names, "matrix": whiten @ weights}


def _fitted(batches, per_language):
    rows = [r for batch in batches for r in batch.to_pylist()]
    rows.sort(key=lambda r: (r["ord"], r["lang"], r["text"]))
    model = fit([(r["text"], r["lang"]) for r in rows], per_language)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          fit_rows: int = FIT_ROWS, per_language: int = PER_LANGUAGE) -> dict:
    """The model learned from the texts and labels of ``docs``."""
    some = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = (some.groupBy(F.col(id_col).alias("_id")).agg(F.min(lang_col).alias("lang"))
              .withColumn("ord", F.xxhash64("_id")).orderBy("ord", "_id").limit(fit_rows))
    picked = (some.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
              .groupBy("_id").agg(F.min("lang").alias("lang"), F.min("ord").alias("ord"), F.min("text").alias("text")).select("lang", "ord", "text"))
    found = picked.repartition(1).mapInArrow(Lean(_fitted, per_language=per_language), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else {"names": []}


def _lettered(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    marks = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int64)])
    out = marks[offsets[1:]] > marks[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, buf[offsets[i]:offsets[i + 1]].tobytes().decode()))
    return out


def _predict(batches, model):
    model = model.value
    names = np.array([*model["names"], UNKNOWN], dtype=object)
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "_text"]
        for first, last, buf, offsets in blocks(batch["_text"]):
            best, score = np.full(last - first, len(names) - 1), np.zeros(last - first)
            if model["names"]:
                values = kernel(buf, offsets, model) @ model["matrix"]
                known = _lettered(buf, offsets)
                best = np.where(known, values.argmax(axis=1), best)
                score = np.where(known, np.clip(values.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch[n].slice(first, last - first) for n in rest] + [pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))],
                names=[*rest, "lang_pred", "score"])


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1)."""
    frame = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "_text")], F.col(text_col).alias("_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return frame.mapInArrow(Lean(_predict, model=shared), f"{types}lang_pred string, score double")
