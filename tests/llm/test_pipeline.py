import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from driftwise.llm import quality, queries
from driftwise.llm.common import ranks
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage but the last keeps the columns, and its decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert ids["line_dedup"] == ids["quality"] and ids["tokens"] == ids["decontaminate"] < ids["line_dedup"]
    lined = [(r.doc_id, r.text) for r in seen["line_dedup"]]
    assert ids["near_copies"] == {c for _, c in brute.components(lined).values()}
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns named like results, an empty table."""
    odd = [(1, None, "x"), (2, "", None), (None, "some words here", "y"), (3, "one two three", "z"), (3, "one two three", "z"),
           (4, "very long " * 50_000, "w"), (5, " \n\t", "v"), (6, "A line that many hold\nown words six", "u"), (7, "a line THAT many hold\nother words seven", "t")]
    docs = spark.createDataFrame([(i, t, "en", s, 7, 0.25, "mine", 3) for i, t, s in odd],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted string, n_lines int")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stored(stage(spark, at, SF), name)
            rows = out.collect()
            if name != "tokens":
                assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
                assert {(r.score, r.predicted, r.n_lines) for r in rows} <= {(0.25, "mine", 3)}
            assert empty == (not rows) or name == "quality"
            if name == "line_dedup" and not empty:
                assert sorted(r.text for r in rows if r.doc_id in (6, 7)) == ["A line that many hold\nown words six", "other words seven"]


def test_whole_run_against_plain_code(spark):
    """Every stage again in plain Python and the tokenizer library: the same documents, the same digests."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    order = {r.doc_id: r.o for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}

    def buckets(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return quality.features(data, np.array([0, len(data)]), quality.BUCKET_BITS)[0].tolist()

    found = {i: buckets(t) for i, t in docs}
    weights = brute.ftrl([(found[i], labels[i]) for i in sorted((i for i in labels if i in found), key=order.get)], quality.EPOCHS, 5.0, 1.0, 0.02, 1e-4)
    margin = {i: sum(weights.get(b, 0.0) for b in f) / max(1, len(f)) ** 0.5 + weights.get(None, 0.0) for i, f in found.items()}
    score = {i: 1 / (1 + math.exp(-max(-35.0, min(35.0, m)))) for i, m in margin.items()}
    assert all(abs(s - quality.THRESHOLD) > 1e-5 for s in score.values())       # no decision hangs on the last digit
    kept = [(i, t) for i, t in docs if score[i] >= quality.THRESHOLD]
    keys = defaultdict(set)
    for i, t in kept:
        for line in (t or "").split("\n"):
            keys[brute.lower(line.strip(" \t\n\x0b\f\r"))].add(i)
    lined = []
    for i, t in kept:
        own = [(x, brute.lower(x.strip(" \t\n\x0b\f\r"))) for x in (t or "").split("\n")]
        lined.append((i, "\n".join(x for x, k in own if not (len(k) >= 10 and len(keys[k]) > 1 and min(keys[k]) != i))))
    first = {c for _, c in brute.components(lined).values()}
    clean = [(i, t) for i, t in lined if i in first and not brute.holds_item(t, items)]
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(public_tokenizers.path(queries.BPE_RANKS)), special_tokens={})
    want = {}
    for i, t in clean:
        ids = encoding.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)
