"""Inputs on which an operator once did less than the whole job."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwise.llm import hashing, jaccard_join, language_model, line_dedup, neighbours, queries, substring_dedup
from tests.llm import brute


def _docs(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def _family(r, base, n, edits):
    """Copies of ``base`` with up to ``edits`` words changed, in one stretch."""
    out = []
    for _ in range(n):
        w, at = list(base), r.randrange(len(base))
        for k in range(at, min(len(base), at + r.randint(1, edits))):
            w[k] = f"x{r.randrange(10 ** 9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("seed", "shift"), [(0, 14), (1, 9)])
def test_families_in_divided_cells(spark, seed, shift):
    """Two families that are barely linked (or not) share regions, which are divided three times."""
    r = random.Random(100 * shift + seed)
    base = [f"w{i}" for i in range(100)]
    other = [*base[:100 - shift], *(f"v{i}" for i in range(shift))]
    texts = [t for b in (base, other, other[::-1], [*other[shift:], *(f"u{i}" for i in range(shift))]) for t in _family(r, b, 30, 4)]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in jaccard_join.join(_docs(spark, docs), leaf_points=3, pivots=2, depth=3).collect()}
    assert got == {i: c for i, (_, c) in brute.components(docs).items()}


def _links(spark, sets, kinds, pivots):
    """What ``divide`` makes of one region: its edges and its cells."""
    points = spark.createDataFrame([(p, np.array(sorted(s), np.uint64).tobytes()) for p, s in sets.items()], "s1 long, shingles binary")
    big = spark.createDataFrame([(1, p, kinds[p]) for p in sets], "region long, p long, kind int")
    edges, cells = jaccard_join.divide(big, points, 80, 3, pivots)
    rows = {}
    for r in cells.collect():
        rows.setdefault(r.region, {})[r.p] = r.kind
    return {frozenset((e.u, e.v)) for e in edges.collect()}, [c for c in rows.values() if 1 in c.values() and len(c) > 1]


def test_a_connected_set_that_is_not_taken_is_compared(spark):
    """Seven copies of P, b linked to P; a, connected before, is linked to b alone."""
    p = set(range(1, 101))
    b = set(range(11, 101)) | set(range(201, 206))
    a = set(range(21, 101)) | set(range(201, 216))
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert near(p, b) and near(b, a) and not near(p, a)
    sets = {10 + i: p for i in range(7)} | {20: b, 30: a}
    edges, cells = _links(spark, sets, {k: 2 if k == 30 else 1 for k in sets}, 1)
    together = [c for c in cells if 20 in c and 30 in c]
    assert frozenset((20, 30)) in edges or any(1 in (c[20], c[30]) for c in together)


@pytest.mark.parametrize("seed", range(10))
def test_random_tables_with_tiny_leaves(spark, seed):
    """Five tables of near copies a seed, in one table of their own words each."""
    docs = []
    for table in range(5):
        r = random.Random(1000 * seed + table)
        base = [f"t{table}w{i}" for i in range(60)]
        texts = [base]
        for _ in range(r.randint(8, 14)):
            w = list(r.choice(texts))
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"t{table}x{r.randrange(40)}"
            texts.append(w)
        docs += [(100 * table + i, " ".join(w)) for i, w in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in jaccard_join.join(_docs(spark, docs), leaf_points=3, pivots=2, depth=3).collect()}
    assert got == {i: c for i, (_, c) in brute.components(docs).items()}


def test_substrings_of_every_period(spark):
    """Periodic texts, alone and as copies: each unit has letters of its own, so periods do not meet."""
    r = random.Random(4)
    docs = []
    for period in range(1, 111):
        unit = "".join(chr(r.randrange(0x100, 0x800)) if k % 2 and period % 2 == 0 else r.choice("abcdefghijklmnopqrstuvwxyz") for k in range(period))
        size = 4 * period + 200
        alone = (unit * (size // period + 1))[:size]
        twin = (unit[::-1].upper() * (size // period + 1))[:size]
        docs += [(3 * period, alone), (3 * period + 1, twin), (3 * period + 2, twin)]
    docs += [(1000, "".join(r.choice("0123456789") for _ in range(50)).join(["", *["\n"] * 40, ""]))]
    got = substring_dedup.dedup_substrings(_docs(spark, docs)).collect()
    want = brute.substrings(docs)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got} == want
    assert want[1000][1] > 0


def _hot(n=240, seed=12):
    """A passage and lines that most texts hold, smaller ids behind larger ones, and one id with a third of the rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    passage, line = " ".join(word() for _ in range(45)), " ".join(word() for _ in range(6))
    docs = []
    for i in range(n):
        own = " ".join(word() for _ in range(r.randint(0, 30)))
        docs.append((1000 - i if i % 3 else i, f"{line.upper()}\n{own} {passage}\n\t{line} \n{passage}{r.choice(['', ' end', chr(10) + passage])}"))
    return docs, [(5000, docs[0][1])] * (n // 3)


@pytest.mark.parametrize("parts", [1, 5])
def test_hot_passages_and_lines(spark, parts):
    """Equal entries of a block are decided there; what they decide must hold for all blocks."""
    docs, again = _hot()
    frame = _docs(spark, [*docs, *again]).repartition(parts)
    got = substring_dedup.dedup_substrings(frame).collect()
    want = brute.substrings([*docs, again[0]])
    assert len(got) == len(docs) + len(again)
    assert {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got} == {(i, *v) for i, v in want.items()}
    got = line_dedup.dedup_lines(frame).collect()
    want = brute.lines([*docs, again[0]])
    assert len(got) == len(docs) + len(again)
    assert {(x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in got} == {(i, *v) for i, v in want.items()}
    texts = {i: v for i, v in [*docs, again[0]]}
    named = spark.createDataFrame([(f"d{i:05}", v) for i, v in texts.items()], "doc_id string, text string").repartition(parts)
    assert {(int(x.doc_id[1:]), x.n_dropped) for x in line_dedup.dedup_lines(named).collect()} == {(i, v[1]) for i, v in want.items()}
    split = spark.createDataFrame([(i + 0.5, v) for i, v in texts.items()], "doc_id double, text string").repartition(parts)
    assert {(int(x.doc_id), x.n_dropped) for x in line_dedup.dedup_lines(split).collect()} == {(i, v[1]) for i, v in want.items()}


def test_hot_entries_meet_once_a_block():
    """What one block sends of a line and a passage that all its texts hold does not grow with their number."""
    class Every:
        value = type("All", (), {"has": staticmethod(lambda keys: np.ones(len(keys), dtype=bool))})

    sizes = []
    for n in (60, 240):
        docs, _ = _hot(n)
        texts = pa.array([t for _, t in docs])
        ids = pa.array([i for i, _ in docs], pa.int64())
        batch = pa.RecordBatch.from_arrays([ids, ids, texts], names=["doc", "tag", "text"])
        lines = pa.Table.from_batches(line_dedup._suspects([batch], Every, 10)).to_pylist()
        first = min(i for i, _ in docs)
        hot = docs[0][1].split("\n")[0].lower()
        assert {x["doc"] for x in lines if x["key"] == hot} == {first}
        assert sum(x["key"] is None for x in lines) >= 2 * (n - 1)
        _, _, buf, offsets = next(substring_dedup._texts([batch], 100))
        _, least, _ = substring_dedup._least(buf, offsets, 100)
        start, end, own = substring_dedup._runs(least, offsets)
        prints = hashing.span_hash(hashing.prefix(buf, lower=False), start, end + 99)
        late = substring_dedup._late(np.arange(len(start)), least[start], prints, ids.to_numpy()[own], start - offsets[own])[2]
        common = {p for p, k in zip(*np.unique(prints, return_counts=True), strict=True) if k >= n}
        assert common
        sizes.append(sum(p in common for p in prints[~late]))
    assert sizes[0] == sizes[1]


def _random_texts(n, size, seed=21):
    r = np.random.default_rng(seed)
    texts = pa.array(["".join(map(chr, r.integers(97, 123, size).tolist())) for _ in range(n)])
    ids = pa.array(range(n), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, texts], names=["doc", "tag", "text"])


def test_smallest_ranks_fill_shards_alike():
    """Smallest ranks lie near zero: one shard of 32 had most of them."""
    sizes = {}
    for batch in substring_dedup._anchors([_random_texts(4, 100_000)], 32, 100):
        for row in batch.to_pylist():
            sizes[row["shard"]] = sizes.get(row["shard"], 0) + len(row["keys"])
    assert len(sizes) == 32
    assert max(sizes.values()) < 1.5 * sum(sizes.values()) / 32


def test_rows_of_runs_do_not_grow_with_blocks_times_shards(monkeypatch):
    """Blocks whose shards hold few entries each go together; all their runs are sent."""
    class Every:
        value = type("All", (), {"has": staticmethod(lambda keys: np.ones(len(keys), dtype=bool))})

    rows, shards = [], 2000
    for n in (3, 9):
        monkeypatch.setattr(substring_dedup, "block_ids", lambda: iter(range(100)))
        batch = _random_texts(n, 300_000)
        assert len(list(substring_dedup._texts([batch], 100))) == n
        sent = [r for b in substring_dedup._send_runs([batch], Every, shards, 100) for r in b.to_pylist()]
        runs = 0
        for _, _, buf, offsets in substring_dedup._texts([batch], 100):
            runs += len(substring_dedup._runs(substring_dedup._least(buf, offsets, 100)[1], offsets)[0])
        assert sum(len(r["places"]) // 4 for r in sent) == runs
        rows.append(len(sent))
    assert rows[1] < 1.5 * rows[0]


@pytest.mark.parametrize("parts", [1, 3])
def test_substrings_of_several_blocks(spark, parts):
    """Texts of several blocks share passages, one of them an empty text's neighbour, one id twice."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(40)]
    docs = [(500 - i if i % 2 else i, "\n".join(r.choice(shared) if r.random() < 0.3 else " ".join(word() for _ in range(60)) for _ in range(150))) for i in range(34)]
    docs += [(600, ""), (601, "ab" * 400), (602, None)]
    frame = _docs(spark, [*docs, docs[3]])
    got = substring_dedup.dedup_substrings(frame.repartition(parts, "doc_id") if parts > 1 else frame.coalesce(1)).collect()
    want = brute.substrings(docs)
    assert len(got) == len(docs) + 1
    assert {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got} == {(i, *v) for i, v in want.items()}


@pytest.mark.parametrize("times", [2, 7])
def test_neighbours_of_repeated_rows(spark, times):
    """Each row stands several times, and one id holds many near vectors."""
    r = np.random.default_rng(6)
    x = r.standard_normal((60, 8)).astype(np.float32)
    near = x[0] + r.standard_normal((12, 8)).astype(np.float32) / 100
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * times + [(0, v.tolist()) for v in near]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 60, 6)], frame.schema)
    for row in neighbours.search(frame, asked, lists=4, probe_share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.score)
    ids, vecs = np.array([i for i, _ in rows]), neighbours.unit(np.array([v for _, v in rows]))
    for q in range(0, 60, 6):
        assert got[q] == pytest.approx(np.sort((vecs @ neighbours.unit(x[q:q + 1])[0])[ids != q])[::-1][:5], abs=1e-6)


def test_known_words_of_a_long_text(spark):
    """More words outside the vocabulary in one text and shard than 16 bits count."""
    frame = _docs(spark, [(1, " ".join(map(str, range(600_000))))])
    row = language_model.score_corpus(frame, F.lit(2), size=5).first()
    assert (row.n_tokens, row.n_known) == (600_001, 600_001)


def test_scores_do_not_depend_on_the_vocabulary(spark):
    """Pairs and contexts exist for words outside the vocabulary too."""
    r = random.Random(8)
    docs = [(i, " ".join(f"w{min(r.randrange(1, 400), r.randrange(1, 400))}" for _ in range(r.randrange(60)))) for i in range(300)]
    part = F.when(F.col("doc_id") % 10 == 0, 0).when(F.col("doc_id") % 10 == 1, 1).otherwise(2)
    whole, few, one = ({x.doc_id: tuple(x)[1:] for x in language_model.score_corpus(_docs(spark, docs), part, **o).collect()}
                       for o in ({}, {"size": 30}, {"size": 1}))
    for other in (few, one):
        assert {i: x[:3] for i, x in other.items()} == {i: x[:3] for i, x in whole.items()}
        assert all(other[i] == pytest.approx(x, rel=1e-5) for i, x in whole.items())


def _prose(seed, n, most=60):
    r = random.Random(seed)
    return [(i, " ".join(f"w{min(r.randrange(1, 400), r.randrange(1, 400))}" for _ in range(r.randrange(most)))) for i in range(n)]


@pytest.mark.parametrize("size", [65_532, 40])
def test_scores_of_plain_deleted_interpolation(spark, size):
    """Score and weights against plain counts and plain expectation-maximisation over them."""
    docs = [*_prose(8, 300), (900, None), (901, ""), (902, "never seen words"), (903, "w1 w1 unseen w1")]
    parts = {i: (0 if i % 10 == 0 or i >= 900 else 1 if i % 10 in (1, 2, 3) else 2) for i, _ in docs}
    part = F.when((F.col("doc_id") % 10 == 0) | (F.col("doc_id") >= 900), 0).when(F.col("doc_id") % 10 < 4, 1).otherwise(2)
    want, weights = brute.interpolated(docs, parts)
    got = {x.doc_id: x.score for x in language_model.score_corpus(_docs(spark, docs), part, size=size).collect()}
    assert all(got[i] == pytest.approx(x, rel=5e-3) for i, x in want.items())
    frame = _docs(spark, docs).select(part.alias("part"), "text")
    model = language_model.train(language_model.placed(frame), size)
    assert np.abs(model.weights[:8] - np.array(weights[:8])).max() < 0.03


def test_cells_tell_small_probabilities_apart():
    small = np.array([1.0, 1e-2, 1e-3, 1e-4, 1e-6, 1e-12, 0.0])
    names = language_model._cells(np.ones(7), np.zeros(7, np.int64), small, np.full(7, 0.5))["cell"]
    assert len(names) == 7


def test_more_short_texts_than_a_block_numbers(spark):
    """Long texts fill a block with tokens; thousands of empty and short ones follow in the same partition."""
    r = random.Random(2)
    docs = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(240))) for i in range(4000)]
    docs += [(4000 + i, "") for i in range(65_000)] + [(69_000 + i, "w1 w2 other") for i in range(1000)]
    part = F.when(F.col("doc_id") % 10 == 0, 0).when(F.col("doc_id") % 10 == 1, 1).otherwise(2)
    rows = language_model.score_corpus(_docs(spark, docs).coalesce(1), part, size=20).collect()
    assert len(rows) == len(docs)
    for x in rows:
        n = 241 if x.doc_id < 4000 else 1 if x.doc_id < 69_000 else 4
        assert (x.n_tokens, x.n_known) == (n, n) and x.score < 0 and x.base_score < 0
    empty = {(round(x.score, 9), round(x.base_score, 9)) for x in rows if 4000 <= x.doc_id < 69_000}
    short = {(round(x.score, 9), round(x.base_score, 9)) for x in rows if x.doc_id >= 69_000}
    assert len(empty) == len(short) == 1 and min(empty) > min(short)


def test_texts_out_of_a_shuffle(spark):
    docs = _prose(9, 200)
    part = F.when(F.col("doc_id") % 10 == 0, 0).when(F.col("doc_id") % 10 == 1, 1).otherwise(2)
    first, again = ({x.doc_id: x.score for x in language_model.score_corpus(d, part).collect()}
                    for d in (_docs(spark, docs), _docs(spark, docs).repartition(5, "doc_id")))
    assert set(first) == set(again) and all(again[i] == pytest.approx(x, rel=1e-9) for i, x in first.items())


def test_recall_of_the_query(spark):
    """The registered query, as it stands, against the exact nearest five."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    column = next(c for c in rows[0].__fields__ if c != "vec_id" and isinstance(rows[0][c], list))
    ids, x = np.array([r.vec_id for r in rows]), neighbours.unit(np.array([r[column] for r in rows], np.float64))
    got = {}
    for r in queries.op9_neighbours(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = x @ x[q]
        near[q] = -2
        best = set(ids[np.lexsort((ids, -near))[:5]].tolist())
        hits, total = hits + len(best & got[int(ids[q])]), total + 5
    assert total and hits >= 0.9 * total
