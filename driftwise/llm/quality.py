"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

A text's features are the buckets of its distinct words and word pairs (a word
after itself is one pair, whatever the word), each with the value ``1 / sqrt(their number)``; a score is the sparse dot product with
the weights, through the logistic function.  Training takes at most ``fit_rows``
labelled rows (those of the smallest hashed id), dealt to ``learners`` tasks that
each run ``epochs`` of FTRL over their share; their weights are averaged.  The model
is one float per bucket: its size does not depend on the data.  Scoring is one
pass over the texts without a shuffle.

Defined cases: null and empty texts (no features) get the score of the intercept;
null labels and ids are not learned from; of several label rows of one id the
largest label counts and of several texts of one id the smallest; without any
labelled row every score is 0.5.  Columns of the input named like the results are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import Lean
from driftwise.llm.hashing import blocks, ngrams, words

BUCKET_BITS = 18
FIT_ROWS = 20_000
LEARNERS = 1
EPOCHS = 3
THRESHOLD = 0.3
# The one pair for any word that follows itself.
SAME = np.uint64(0x5A3E000000000000)


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, text after text, and where each text starts."""
    hashes, first = words(buf, offsets)
    docs = len(offsets) - 1
    own = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(first))
    pairs = ngrams(hashes, 2)
    pairs[hashes[1:] == hashes[:-1]] = SAME
    inside = own[:len(pairs)] == own[1:1 + len(pairs)] if len(own) else np.zeros(0, bool)
    shift, width = np.uint64(64 - bits), np.uint64(bits)
    keys = np.concatenate([(own << width) | (hashes >> shift), (own[:len(pairs)][inside] << width) | (pairs[inside] >> shift)])
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    at = np.searchsorted(keys, np.arange(docs + 1, dtype=np.uint64) << width)
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int32), at


def _featured(batches, bits):
    for batch in batches:
        for first, last, buf, offsets in blocks(batch["text"]):
            found, at = features(buf, offsets, bits)
            yield pa.RecordBatch.from_arrays(
                [batch["label"].slice(first, last - first), batch["ord"].slice(first, last - first), batch["share"].slice(first, last - first),
                 pa.array([found[at[i]:at[i + 1]].tobytes() for i in range(last - first)], pa.binary())],
                names=["label", "ord", "share", "feats"])


def ftrl(rows: list[tuple[np.ndarray, float]], bits: int, epochs: int,
         alpha: float = 5.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4) -> np.ndarray:
    """Weights (the intercept last) after ``epochs`` over (buckets, label) rows."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for found, label in rows:
            i = np.append(found, size - 1)
            value = np.full(len(i), 1 / np.sqrt(max(1, len(found))))
            value[-1] = 1.0
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ value, -35, 35)))
            g = (p - label) * value
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32)


def _learn(batches, bits, epochs):
    shares: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            shares.setdefault(r["share"], []).append((r["ord"], np.frombuffer(r["feats"], np.int32), float(r["label"])))
    for share in sorted(shares):
        rows = [(f, y) for _, f, y in sorted(shares[share], key=lambda r: r[0])]
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([ftrl(rows, bits, epochs).tobytes()], pa.binary())], names=["n", "weights"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          bits: int = BUCKET_BITS, fit_rows: int = FIT_ROWS, learners: int = LEARNERS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from ``labels`` (id, 0/1 label); at most ``fit_rows`` rows are used."""
    marked = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
              .withColumn("ord", F.xxhash64("_id")).orderBy("ord", "_id").limit(fit_rows))
    picked = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
              .join(F.broadcast(marked), "_id")
              .groupBy("_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("ord").alias("ord"))
              .select("text", "label", "ord", F.pmod(F.col("ord"), F.lit(learners)).cast("int").alias("share")))
    rows = picked.mapInArrow(Lean(_featured, bits=bits), "label double, ord long, share int, feats binary")
    fits = rows.repartition(learners, "share").mapInArrow(Lean(_learn, bits=bits, epochs=epochs), "n long, weights binary").collect()
    if not fits:
        return np.zeros((1 << bits) + 1, np.float32)
    return np.average([np.frombuffer(r["weights"], np.float32) for r in fits], axis=0, weights=[r["n"] for r in fits]).astype(np.float32)


def _scores(batches, weights, bits, threshold):
    w = weights.value
    for batch in batches:
        out = []
        for _, _, buf, offsets in blocks(batch["_text"]):
            found, at = features(buf, offsets, bits)
            sums = np.concatenate([[0.0], np.cumsum(w[found], dtype=np.float64)])
            n = np.diff(at)
            out.append((sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(n, 1)))
        margin = np.concatenate(out) + w[-1] if out else np.zeros(0)
        score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        arrays = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"}
        arrays |= {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32))}
        yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def score_texts(docs: DataFrame, weights: np.ndarray, text_col: str = "text", bits: int = BUCKET_BITS,
                threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    rest = [c for c in docs.columns if c not in ("score", "predicted", "_text")]
    frame = docs.select(*rest, F.col(text_col).alias("_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "_text")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return frame.mapInArrow(Lean(_scores, weights=shared, bits=bits, threshold=threshold), f"{types}score double, predicted int")
