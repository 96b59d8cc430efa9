"""Periodic runs, token counts and importance resampling against plain versions."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from driftwise.llm import importance, periodic_runs, queries, token_counts
from driftwise.llm.hashing import blocks
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "one two"), (905, "a " * 3000), (906, "b" * 5000),
       (907, "É é x\x0by z"), (908, "\x1c<s> </s>\x00▁")]
SCHEMA = "doc_id bigint, text string, runs string, n_tokens int, score string, `a b` int"


def _frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 5, "y", 1) for i, t in docs], SCHEMA)


def _periodic(seed, n, vocabulary=(1, 2, 3, 5, 50), sizes=(0, 1, 11, 12, 13, 30, 100, 400)):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        k, size = r.choice(vocabulary), r.choice(sizes)
        w = [f"w{r.randrange(k)}" for _ in range(size)]
        for _ in range(r.randint(0, 3) if size > 4 else 0):
            a = r.randrange(size)
            p = 1 + r.randrange(max(1, (size - a) // 2))
            for i in range(a, min(size, a + r.randint(2 * p, 5 * p))):
                w[i] = w[a + (i - a) % p]
        out.append(w)
    return out


@pytest.mark.parametrize("block", [16, 6])
def test_runs_of_every_kind(monkeypatch, block):
    """Random texts of few and many words with periods planted over each other."""
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    docs = _periodic(1, 600)
    number = {f"w{i}": i for i in range(50)}
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    head, size, lag = periodic_runs.find(np.array([number[w] for d in docs for w in d], np.uint64), first)
    cut = np.searchsorted(head, first)
    for i, d in enumerate(docs):
        got = list(zip((head - first[i])[cut[i]:cut[i + 1]].tolist(), size[cut[i]:cut[i + 1]].tolist(), lag[cut[i]:cut[i + 1]].tolist(), strict=True))
        assert got == brute.runs(d)


def test_splitting_is_stable():
    """No word of a surviving segment is too rare in it, and no run is cut."""
    docs = _periodic(2, 200)
    words = np.array([int(w[1:]) for d in docs for w in d], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    start, end = periodic_runs.segments(words, first)
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        own, half = words[s:e].tolist(), (e - s) // 2
        assert e - s >= 12 and all(own[i] in own[max(0, i - half):i] + own[i + 1:i + half + 1] for i in range(len(own)))
    inside = np.zeros(len(words) + 1, np.int64)
    inside[start] += 1
    inside[end] -= 1
    inside = np.cumsum(inside)
    for d, a in zip(docs, first.tolist()):
        assert all(inside[a + s:a + s + size].all() for s, size, _ in brute.runs(d))


def test_a_long_chain_of_splits():
    """Each cut makes one more word rare: more rounds than are taken change nothing."""
    words = [x for i in range(2000) for x in (i, i - 1)] + ["p", "q"] * 20
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words], np.uint64)
    head, size, lag = periodic_runs.find(ids, np.array([0, len(ids)]))
    assert list(zip(head.tolist(), size.tolist(), lag.tolist(), strict=True)) == [(4000, 40, 2)]


def test_find_runs(spark):
    docs = [*ODD, *((i, " ".join(w)) for i, w in enumerate(_periodic(3, 150))), (905, "a " * 3000), (910, "x y z " * 30000)]
    got = periodic_runs.find_runs(_frame(spark, docs[:-1]))
    assert got.columns == ["doc_id", "text", "n_tokens", "score", "a b", "n_words", "runs", "collapsed"]
    rows = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    want = []
    for i, t in docs[:-1]:
        w = brute.plain_words(t)
        want.append((i, len(w), brute.runs(w) if i != 905 else [(0, 3000, 1)], brute.collapsed(w, brute.runs(w)) if i != 905 else "a"))
    assert rows == sorted(want)
    long = periodic_runs.find_runs(_frame(spark, [docs[-1], (None, "u " * 12)])).collect()
    assert {(r.doc_id, r.collapsed, tuple(r.runs[0])) for r in long} == {(910, "x y z", (0, 90000, 3)), (None, "u", (0, 12, 1))}
    assert periodic_runs.find_runs(_frame(spark, docs[:1]).limit(0)).count() == 0
    shorter = periodic_runs.find_runs(spark.createDataFrame([(1, "q a b a b a c")], "doc_id bigint, text string"), least=5).first()
    assert [tuple(x) for x in shorter.runs] == [(1, 5, 2)] and shorter.collapsed == "q a b c"


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got == {d.doc_id: brute.run_row(*d) for d in docs}
    assert any(r[0] for r in got.values())


def test_planting(spark):
    docs = [(i, " ".join(w)) for i, w in enumerate(_periodic(4, 300, (50,)))] + ODD
    got = {r.doc_id: r.text for r in queries.with_planted_runs(_frame(spark, [*docs, (None, "a b")]).select("doc_id", "text")).collect()}
    assert got.pop(None) == "a b"
    assert {i: brute.plain_words(t) for i, t in got.items()} == {i: brute.planted(i, brute.plain_words(t)) for i, t in docs}


def _texts():
    r = random.Random(1)
    parts = [*"abestlmdrvABC019  \t\n'!., é\x85×¼-_\r▁", "the", " the", "ing", "   ", " " * 17, "日本", "執", "\x1c\x00",
             *"жΩéع۳नि한Ⅷ²🙂𝒜́​﻿　", "<s>", "<unk>", "</s>", "<0x0A>", "aaaa", "=====", "--------"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    out += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(100)]
    return out + ["".join(r.choice(" ab") for _ in range(200)) for _ in range(100)] + ["", " ", " " * 100, "a" * 500, "=-" * 300, "▁"]


@pytest.mark.parametrize("long", [token_counts.LONG, 6])
def test_counts_match_the_library(monkeypatch, long):
    """Also where pairs of long pre-tokens are merged from a heap."""
    monkeypatch.setattr(token_counts.count_symbols, "__defaults__", (long,))
    path, texts, got = public_tokenizers.path(queries.PIECES), _texts(), []
    counter = token_counts.Counter(token_counts.read_model(path))
    for _, _, buf, offsets in blocks(pa.array(texts), 1 << 14):
        got += token_counts.count_block(buf, offsets, counter).tolist()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == [len(x) for x in library.encode(texts, num_threads=1)]


def test_count_tokens(spark):
    path = public_tokenizers.path(queries.PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = [*ODD, (None, "no key"), (905, "a " * 3000), (911, " " * 30000), (912, "qzx" * 200_000)]
    got = token_counts.count_tokens(_frame(spark, docs), path)
    assert got.columns == ["doc_id", "text", "runs", "score", "a b", "n_bytes", "n_tokens"]
    rows = [(r.doc_id, r.text, r.n_bytes, r.n_tokens) for r in got.collect()]
    want = [(i, t, len((t or "").encode()), len(library.encode(t or ""))) for i, t in docs]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(_frame(spark, docs[:1]).limit(0), path).count() == 0
    query = {r.doc_id: tuple(r)[1:] for r in queries.op12_token_counts(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        n = len(library.encode(d.text or ""))
        assert query[d.doc_id] == (len((d.text or "").encode()), n, n > 4096)


def test_resample_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_importance(spark, SF).collect()}
    assert got == brute.importance([tuple(d) for d in docs], items)


def test_resample(spark):
    r = random.Random(5)
    docs = [(i, r.choice([" ", "-", ", ", "\n"]).join(r.choice(["Éa", "b1", "C", "d"]) for _ in range(r.randint(0, 60)))) for i in range(200)] + ODD
    items = ["b1 c", None, "", "d d d"]
    target = spark.createDataFrame([(t, 1) for t in items], "text string, score int")
    frame = _frame(spark, docs).withColumn("buckets", F.lit("mine"))
    for buckets, percent, least in ((10_000, 25, 20), (7, 100, 0), (70_000, 60, 1)):
        got = importance.resample(frame, target, buckets=buckets, percent=percent, least_words=least)
        rows = {x.doc_id: (x.n_features, x.weight, x.score, x["rank"]) for x in got.collect()}
        assert rows == brute.importance(docs, items, buckets, least, percent)
    # one id in several rows, and none: each is a candidate
    again = importance.resample(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b"), (2, "z")], "doc_id bigint, text string"),
                                target, percent=100, least_words=1).collect()
    assert sorted(x["rank"] for x in again) == [1, 2, 3, 4]
    assert importance.resample(frame.limit(0), target).count() == 0
    none = importance.resample(frame, target.limit(0)).agg(F.count("rank"), F.count("*")).first()
    assert tuple(none) == (sum(x[1][3] is not None for x in brute.importance(docs, []).items()), len(docs))
    three = importance.features(_frame(spark, [(1, "A b, c d")]), longest=3).first()
    assert (three.n_words, len(three.buckets)) == (4, 2 * (4 + 3 + 2))
