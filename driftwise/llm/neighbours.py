"""Approximate nearest neighbours by an adaptive scan of dimensions.

Unit vectors are turned by one random rotation and dealt to the lists of the
nearest of ``lists`` centres (k-means on at most ``fit_rows`` vectors, those of the
smallest hash; every row is indexed).  A query looks into the ``probe_share`` of the
lists that are nearest to it (vectors without clusters need a large share: on the
test tables 0.7 finds 96 of 100 true neighbours, 0.2 finds 60).  There, partial squared distances are summed over blocks of ``BLOCK`` rotated
columns; after each block the hypothesis that a candidate is among the best is
tested, and candidates whose partial distance is too large for the current k-th
best are left.  What remains is scored by the exact cosine of the original vectors.

Equal vectors: of each distinct vector only the ``k + 1`` smallest distinct ids, and
``k`` rows of each, can be in any answer (ties go to the smaller id and a query leaves
out all rows of its own id and no others), so the rest are not searched, and queries
with equal vectors are searched once.  The best rows of a query are cut alike: ``k + 1``
distinct ids, ``k`` rows of each.  Lists longer than ``LIST_ROWS`` are split, and so
are their queries.

Defined cases: rows whose id or vector is null, whose vector is zero, holds a null
or non-finite component, or has another length than most, take no part; rows of one
id are separate candidates but none of them answers a query of that id; fewer than
``k`` candidates: all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import Lean, partitions, stored

FIT_ROWS = 8192
PROBE_SHARE = 0.7
BLOCK = 16
LIST_ROWS = 4096
QUERY_ROWS = 4096
EPSILON = 2.1


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means of unit vectors; an empty list takes the point farthest from its centre."""
    rng = np.random.default_rng(11)
    out = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = sample @ out.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=len(out))
        far = np.argsort(near.max(axis=1), kind="stable")
        for j, i in zip(np.flatnonzero(size == 0), far, strict=False):
            sums[j] = sample[i]
        out = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _deal(batches, model, probes):
    """Rows by list: for candidates the nearest (``probes`` 1), for queries more."""
    turn, middle = model.value
    for batch in batches:
        if not batch.num_rows:
            continue
        turned = unit(_matrix(batch["vec"], len(turn))) @ turn
        near = turned @ middle.T
        n = min(probes, len(middle))
        cells = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(middle) else np.tile(np.arange(n), (len(near), 1))
        rows = pa.array(np.repeat(np.arange(len(near)), n))
        turned32 = [r.tobytes() for r in turned.astype(np.float32)]
        yield pa.RecordBatch.from_arrays(
            [batch["id"].take(rows), batch["vec"].take(rows), pa.array(turned32, pa.binary()).take(rows), pa.array(cells.ravel().astype(np.int32))],
            names=["id", "vec", "turned", "cell"])


def scan(queries: np.ndarray, block: np.ndarray, k: int, lead: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) that the tests did not abandon; the first
    ``lead`` rows are of different ids, and the k-th best of them is the limit."""
    n, dims = block.shape
    first = ((queries[:, None, :] - block[None, :lead, :]) ** 2).sum(axis=2)
    best = np.partition(first, k - 1, axis=1)[:, k - 1] if lead >= k else np.full(len(queries), np.inf)
    q, c = np.indices((len(queries), n - lead)).reshape(2, -1)
    c = c + lead
    so_far = np.zeros(len(q))
    for d in range(0, dims, BLOCK):
        e = min(dims, d + BLOCK)
        if d == 0:
            a, b = queries[:, :e], block[lead:, :e]
            step = ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T).ravel()
        else:
            step = ((block[c, d:e] - queries[q, d:e]) ** 2).sum(axis=1)
        so_far = so_far + step
        limit = best[q] * (e / dims) * ((1 + epsilon / np.sqrt(e)) ** 2 if e < dims else 1)
        stay = so_far <= limit * (1 + 1e-5) + 1e-6
        q, c, so_far = q[stay], c[stay], so_far[stay]
    lq, lc = np.indices((len(queries), lead)).reshape(2, -1)
    return np.concatenate([lq, q]), np.concatenate([lc, c])


def _within(q: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each query's rows, best first, those of the first ``k + 1`` ids, ``k`` rows of each."""
    order = np.lexsort((ids, q))  # stable: the rows of an id stay best first
    fresh = np.ones(len(q), dtype=bool)
    fresh[1:] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    head = np.flatnonzero(fresh)
    turn = np.empty(len(q), np.int64)
    turn[order] = np.arange(len(q)) - head[np.cumsum(fresh) - 1] if len(q) else 0
    names = np.concatenate([[0], np.cumsum(turn == 0)])  # ids that appeared before each row
    so_far = names[1:] - names[np.searchsorted(q, q, "left")]
    return (so_far <= k + 1) & (turn < k)


def _search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(candidates) and len(queries):
        block = np.frombuffer(b"".join(candidates["turned"]), np.float32).reshape(len(candidates), -1)
        asked = np.frombuffer(b"".join(queries["turned"]), np.float32).reshape(len(queries), -1)
        first = np.sort(np.unique(candidates["id"].to_numpy(), return_index=True)[1])[:4 * (k + 1)]
        order = np.concatenate([first, np.setdiff1d(np.arange(len(candidates)), first)])
        candidates, block = candidates.iloc[order], block[order]
        ids, names = candidates["id"].to_numpy(), queries["id"].to_numpy()
        exact, vecs = np.stack(candidates["vec"].to_numpy()), np.stack(queries["vec"].to_numpy())
        norms, own = np.linalg.norm(exact, axis=1), np.linalg.norm(vecs, axis=1)
        step = max(1, (1 << 20) // len(block))
        for at in range(0, len(asked), step):
            q, c = scan(asked[at:at + step], block, k + 1, len(first))
            q = q + at
            score = np.einsum("ij,ij->i", vecs[q], exact[c]) / (own[q] * norms[c])
            order = np.lexsort((ids[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            keep = _within(q, ids[c], k)
            out.append(pd.DataFrame({"query": names[q[keep]], "id": ids[c[keep]], "score": score[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as doubles, hash of the vector) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0.0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else -1)).withColumns({"h1": F.xxhash64("vec"), "h2": F.hash("vec")})


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
           lists: int | None = None, probe_share: float = PROBE_SHARE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest rows of ``vectors``: query_id, rank, id, score."""
    spark = vectors.sparkSession
    same = Window.partitionBy("h1", "h2").orderBy("id")
    base = (valid(vectors, id_col, vec_col).groupBy("h1", "h2", "id").agg(F.first("vec").alias("vec"), F.least(F.count("*"), F.lit(k)).alias("times"))
            .withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
            .select("id", "vec", "h1", "h2", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("n")).drop("n"))
    base = stored(base, "neighbour-base")
    asked = valid(queries, id_col, vec_col)
    sample = base.groupBy("h1", "h2").agg(F.min_by("vec", "id").alias("vec")).orderBy("h1", "h2").limit(fit_rows).select("vec").collect()
    kind = "query_id long, rank int, id long, score double"
    if not sample:
        return spark.createDataFrame([], kind).withColumnRenamed("id", id_col)
    points = unit(np.array([r["vec"] for r in sample], np.float64))
    turn = rotation(points.shape[1])
    middle = centres(points @ turn, lists or int(np.clip(np.sqrt(base.count()) / 4, 1, 1024)))
    probes = int(np.ceil(probe_share * len(middle)))
    model = spark.sparkContext.broadcast((turn, middle))
    shape = "id long, vec array<double>, turned binary, cell int"
    dealt = stored(base.select("id", "vec").mapInArrow(Lean(_deal, model=model, probes=1), shape), "neighbour-lists")
    once = asked.withColumn("n", F.row_number().over(same)).where("n = 1")
    probing = once.select("id", "vec").mapInArrow(Lean(_deal, model=model, probes=probes), shape)
    # a list of many rows, or with many queries, is worked on in several groups
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    loads = probing.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("turns"))
    plan = F.broadcast(sizes.join(F.broadcast(loads), "cell"))
    left = (dealt.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
            .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("parts", "turns"))
    right = (probing.join(plan, "cell").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "turns"))
    keys = ["cell", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda a, b: _search(a, b, k), "query long, id long, score double")
    alike = Window.partitionBy("query", "id").orderBy(F.desc("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "n")
    top = (found.repartition(partitions(spark), "query").withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k)
           .withColumn("ids", F.sum((F.col("n") == 1).cast("int")).over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
           .where(F.col("ids") <= k + 1).drop("n", "ids"))
    heads = once.select("h1", "h2", F.col("id").alias("query"))
    answers = top.join(heads, "query").select("h1", "h2", "id", "score")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (asked.select(F.col("id").alias("query_id"), "h1", "h2").distinct().join(answers, ["h1", "h2"])
            .where("query_id != id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
