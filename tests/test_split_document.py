"""One huge split document read by byte ranges, and documents written where the rows lie."""

import json
import os
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwise.operators.roundtrip import content_differences
from driftwise.sources.split_document import read_split_document
from driftwise.sources.split_json import read_split_json, split_documents, write_split_json
from tests.conftest import SF001

NASTY = ["],[", "\\", "\\\\", '"', '\\"', "[[", "]]}", "a,b", "", None, "{\"data\": [", "é 日", "\n", "]", ",", "x" * 300, '","', "\\],["]
SCHEMA = "a bigint, s string, f double, t string"


def _file(folder, text, name="doc.json"):
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)
    return os.path.join(folder, name)


def _frame(n, seed=1):
    r = random.Random(seed)
    return pd.DataFrame({"a": [r.randrange(10 ** 6) for _ in range(n)], "s": [r.choice(NASTY) for _ in range(n)],
                         "f": [r.choice([1.5, -0.25, None]) for _ in range(n)], "t": [r.choice(NASTY) for _ in range(n)]})


def _expect(doc):
    names = [c if isinstance(c, str) else str(c) for c in doc["columns"]]
    rows = []
    for k, row in enumerate(doc["data"]):
        cells = dict(zip(names, row))
        f = cells.get("f")
        rows.append((doc["index"][k] if "index" in doc else k, cells.get("a"), cells.get("s"), None if f is None else float(f), cells.get("t")))
    return rows


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_every_cut_gives_the_same_rows(spark, tmp_dir, size):
    """Strings full of brackets, quotes and backslashes; ranges from a few bytes to the whole file."""
    text = _frame(25 if size == 7 else 150).to_json(orient="split")
    path = _file(tmp_dir, text)
    got = [tuple(r) for r in read_split_document(spark, path, SCHEMA, range_bytes=size).collect()]
    assert sorted(got, key=repr) == sorted(_expect(json.loads(text)), key=repr)


def test_sections_in_any_order_with_blanks(spark, tmp_dir):
    doc = json.loads(_frame(40, 2).to_json(orient="split"))
    turned = {"other": {"x": [[1], "],["]}, "data": doc["data"], "index": [i * 7 - 3 for i in range(40)], "name": None, "columns": doc["columns"]}
    for k, (d, indent) in enumerate([(turned, None), (turned, 2), ({"columns": doc["columns"], "data": doc["data"]}, 1)]):
        path = _file(tmp_dir, "\n " + json.dumps(d, indent=indent) + "\n", f"d{k}.json")
        got = read_split_document(spark, path, SCHEMA, range_bytes=100)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(_expect(d), key=repr)
        assert read_split_document(spark, path, "f double", index_col=None, range_bytes=100).columns == ["f"]


def test_a_million_rows_are_read_by_many_tasks(spark, tmp_dir):
    n = 1_000_000
    pdf = pd.DataFrame({"k": range(n), "s": ["],[" if i % 3 else '"\\' for i in range(n)]}, index=range(5, n + 5))
    pdf.to_json(os.path.join(tmp_dir, "big.json"), orient="split")
    got = read_split_document(spark, os.path.join(tmp_dir, "big.json"), "k bigint, s string", range_bytes=4 << 20)
    per_task = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 3 and max(r["count"] for r in per_task) < n / 3
    facts = got.agg(F.count("*"), F.sum("k"), F.min("index"), F.max("index"), F.count_if(F.col("index") == F.col("k") + 5),
                    F.count_if(F.col("s") == F.when(F.col("k") % 3 != 0, "],[").otherwise('"\\'))).first()
    assert tuple(facts) == (n, n * (n - 1) // 2, 5, n + 4, n, n)
    whole = read_split_json(spark, os.path.join(tmp_dir, "big.json"), "k bigint, s string", multi_line=True)
    assert tuple(content_differences(got, whole).first()) == (0, 0)


def test_a_folder_of_documents(spark, tmp_dir):
    orders = spark.read.parquet(f"{SF001}/orders.parquet").repartition(3)
    write_split_json(orders, f"{tmp_dir}/parts", rows_per_doc=2 ** 31)      # one document a file
    back = read_split_document(spark, f"{tmp_dir}/parts", orders.schema, index_col=None, range_bytes=5000)
    assert tuple(content_differences(orders, back).first()) == (0, 0)
    indexed = read_split_document(spark, f"{tmp_dir}/parts", "o_orderkey bigint", range_bytes=5000)
    lines = read_split_json(spark, f"{tmp_dir}/parts", "o_orderkey bigint")
    assert tuple(content_differences(indexed, lines).first()) == (0, 0)


@pytest.mark.parametrize("text", ['{"columns":["a"],"data":[[1],[2]', '{"columns":["a"],"data":[["1]]}', '{"data":[[1]]}', '{"columns":["a"]}',
                                  '{"columns":["a"],"index":[0],"data":[[1],[2]]}', '{"columns":["a"],"data":[[1,]]}',
                                  '{"columns":["a"],"data":[[1]]}\n{"columns":["a"],"data":[[2]]}'])
def test_malformed_documents_raise(spark, tmp_dir, text):
    path = _file(tmp_dir, text)
    with pytest.raises(Exception, match="MALFORMED|JSON|more than one|fewer"):
        read_split_document(spark, path, "a bigint", range_bytes=9).collect()


def test_cells_that_do_not_convert(spark, tmp_dir):
    path = _file(tmp_dir, '{"columns":["a",3],"index":[4],"data":[["x",true]]}')
    with pytest.raises(Exception, match="not a bigint"):
        read_split_document(spark, path, "a bigint").collect()
    row = read_split_document(spark, path, "a bigint, `3` boolean, gone string", bad_cells="null").first()
    assert tuple(row) == (4, None, True, None)
    empty = _file(tmp_dir, '{"columns":["a"],"index":[],"data":[]}', "empty.json")
    assert read_split_document(spark, empty, "a bigint").count() == 0
    with pytest.raises(FileNotFoundError):
        read_split_document(spark, f"{tmp_dir}/none.json", "a bigint")


@pytest.mark.parametrize("rows_per_doc", [2, 7, 1000, 2 ** 31])
def test_documents_are_grouped_without_a_shuffle(spark, rows_per_doc):
    df = spark.range(0, 100, 1, 3).select((F.col("id") * 3).alias("k"), F.lit('q"\\\n').alias("s t"), F.lit(None).cast("int").alias("n"))
    docs = split_documents(df, rows_per_doc)
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
    seen, ids = [], []
    for r in docs.collect():
        doc = json.loads(r.value)
        assert doc["columns"] == ["k", "s t", "n"] and 0 < len(doc["data"]) == len(doc["index"]) <= rows_per_doc
        assert doc["index"] == list(range(doc["index"][0], doc["index"][0] + len(doc["index"])))
        seen += doc["data"]
        ids += doc["index"]
    assert sorted(int(x[0]) for x in seen) == list(range(0, 300, 3)) and len(set(ids)) == 100
    assert {(s, n) for _, s, n in seen} == {('q"\\\n', None)}
    assert split_documents(df.limit(0), rows_per_doc).count() == 0


def test_large_partition_numbers_keep_exact_ids(spark):
    """Ids of high partitions do not fit a double; they are integers all the way."""
    docs = split_documents(spark.range(0, 3000, 1, 1500), 2)
    ids = sorted(i for r in docs.collect() for i in json.loads(r.value)["index"])
    assert ids == sorted((p << 33) + k for p in range(1500) for k in range(2))


@pytest.mark.parametrize("rows_per_doc", [2, 300, 2 ** 31])
def test_documents_written_in_pieces_stay_one_a_line(spark, tmp_dir, rows_per_doc):
    """More rows, characters and index entries than a piece holds; strings that look like its ends."""
    nasty = F.element_at(F.array(*[F.lit(x) for x in NASTY]), (F.col("id") % len(NASTY) + 1).cast("int"))
    df = spark.range(0, 12_000, 1, 2).select((F.col("id") * 3).alias("k"), nasty.alias("s"), F.repeat(F.lit("é,"), 100).alias("t"))
    write_split_json(df, f"{tmp_dir}/j", rows_per_doc)
    ids, files = [], [f for f in os.listdir(f"{tmp_dir}/j") if f.startswith("part-")]
    assert len(files) == 2
    for f in files:
        with open(f"{tmp_dir}/j/{f}") as lines:
            docs = [json.loads(line) for line in lines]
        assert len(docs) == -(-6000 // rows_per_doc)
        for d in docs:
            assert d["columns"] == ["k", "s", "t"] and 0 < len(d["data"]) == len(d["index"]) <= rows_per_doc
            ids += d["index"]
    assert sorted(ids) == [(p << 33) + k for p in range(2) for k in range(6000)]
    back = read_split_json(spark, f"{tmp_dir}/j", df.schema, index_col=None)
    assert tuple(content_differences(df, back).first()) == (0, 0)
    if rows_per_doc == 2 ** 31:
        indexed = read_split_document(spark, f"{tmp_dir}/j", df.schema, range_bytes=100_000)
        assert tuple(content_differences(read_split_json(spark, f"{tmp_dir}/j", df.schema), indexed).first()) == (0, 0)
    write_split_json(df.limit(0), f"{tmp_dir}/none", rows_per_doc)
    assert read_split_json(spark, f"{tmp_dir}/none", df.schema).count() == 0


def test_a_task_holds_pieces_and_no_document(spark, tmp_dir, monkeypatch):
    """What a writing task has taken in and not given out stays small, whatever the document's size."""
    df, given = spark.range(3).select("id", F.lit("x").alias("s")), []
    whole = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: given.append(f) or whole(self, f, *a, **b))
    write_split_json(df, f"{tmp_dir}/j", rows_per_doc=2 ** 31)
    taken = passed = most = 0

    def batches():
        nonlocal taken, most
        for k in range(200):
            most = max(most, taken - passed)
            rows = [json.dumps([str(k), "x" * 1000]) for _ in range(200)]
            taken += sum(map(len, rows))
            yield pa.RecordBatch.from_arrays([pa.array(range(200 * k, 200 * k + 200)), pa.array(rows)], names=["_i", "_row"])

    texts = []
    for out in given[0](batches()):
        texts += out["value"].to_pylist()
        passed = sum(map(len, texts))
    doc = json.loads(" ".join(texts))
    assert doc["index"] == list(range(40_000)) and len(doc["data"]) == 40_000 and taken > 40_000_000
    assert most < 4_000_000
