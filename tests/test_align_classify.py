import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwise import ColumnGroups, DatasetSpec, compare_frames, compare_groups
from driftwise.operators.align import align_positional, id_first, project_side, reconcile
from driftwise.operators.classify import classify, define, definition_table
from driftwise.operators.contract import (DRIFT_GROUPS, SELECTION_GROUPS, check_contract,
                                          contract_violations)
from driftwise.spec import DataDefinition

# Made fixture: the two sample files' contents (comma + space separated).
SAMPLE_REF = "str, int, flo, dat\na, 1, 1.5, 2025-04-04\nb, 2, 3.0, 2025-17-03\nc, 3, 4.5, 2025-27-07\n"
SAMPLE_CUR = "str, int, flo, dat\na, 2, 3.5, 2025-04-05\nb, 3, 2.7, 2025-17-01\nc, 3, 4.5, 2025-27-07\n"
SAMPLE_SCHEMA = "str string, int bigint, flo double, dat string"


@pytest.fixture
def sample(spark, tmp_dir):
    from driftwise.sources.files import read_csv
    paths = []
    for name, text in (("ref.txt", SAMPLE_REF), ("cur.txt", SAMPLE_CUR)):
        p = f"{tmp_dir}/{name}"
        with open(p, "w") as fh:
            fh.write(text)
        paths.append(p)
    return [read_csv(spark, p, SAMPLE_SCHEMA) for p in paths]


def test_csv_reads_blank_after_separator(sample):
    ref, _ = sample
    assert ref.columns == ["str", "int", "flo", "dat"]
    assert [tuple(r) for r in ref.collect()][0] == ("a", 1, 1.5, "2025-04-04")


def test_classify_kinds(spark):
    df = spark.createDataFrame([], "i int, l bigint, d double, m decimal(10,2), s string, b boolean, "
                                   "t timestamp, a array<int>")
    d = classify(df.schema, id_col="l")
    assert d.numerical == ("i", "d", "m")
    assert d.categorical == ("s",)
    assert d.other == ("b", "t", "a")   # booleans and undeclared timestamps are not scored
    assert d.id_column == "l"


def test_absent_datetime_is_dropped_and_long_id_excluded(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "customer_id bigint, s string, v double")
    d = classify(df.schema, id_col="customer_id", datetime_cols=("nope",))
    assert d.datetime == ()
    assert "customer_id" not in d.numerical  # the whole name, not its first letter


def test_coercion_without_and_with_format(sample):
    ref, _ = sample
    coerced, d = define(ref, None, ["dat"])
    assert d.datetime == ("dat",)
    got = [r.dat for r in coerced.orderBy("str").collect()]
    assert got == [dt.datetime(2025, 4, 4), None, None]
    coerced2, _ = define(ref, None, ["dat"], datetime_format="yyyy-dd-MM")
    got2 = [r.dat for r in coerced2.orderBy("str").collect()]
    assert got2 == [dt.datetime(2025, 4, 4), dt.datetime(2025, 3, 17), dt.datetime(2025, 7, 27)]


def test_numeric_datetime_is_epoch_millis(spark):
    df = spark.createDataFrame([(1735689600000,)], "t bigint")
    coerced, _ = define(df, None, ["t"])
    assert coerced.first().t == dt.datetime(2025, 1, 1)


def test_sample_pair_drift(sample):
    ref, cur = sample
    spec = DatasetSpec(features=("str", "int", "flo"), datetimes=("dat",))
    rep = compare_frames(ref, cur, spec, spec)
    got = {r.column_name: (r.kind, r.ref_count, r.cur_count) for r in rep.columns.collect()}
    assert got == {"str": ("categorical", 3, 3), "int": ("numerical", 3, 3), "flo": ("numerical", 3, 3)}
    assert {r.column_name for r in rep.columns.collect() if r.psi == 0.0} == {"str"}


def test_project_relabel_and_id_first(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 9)], "a bigint, b double, c string, idc bigint")
    spec = DatasetSpec(features=("b", "c"), id="idc", labels={"b": "B"})
    out = project_side(df, spec)
    assert out.columns == ["idc", "B", "c"]
    assert id_first(df, "idc").columns == ["idc", "a", "b", "c"]


def test_positional_alignment_uses_current_names(spark):
    ref = spark.createDataFrame([(1, 2.0, "x")], "rid bigint, rv double, rs string")
    cur = spark.createDataFrame([(1, 3.0, "y")], "cid bigint, cv double, cs string")
    rs = DatasetSpec(features=("rv", "rs"), id="rid")
    cs = DatasetSpec(features=("cv", "cs"), id="cid")
    al = align_positional(ref, cur, rs, cs)
    assert al.ref.columns == ["cid", "cv", "cs"]
    assert al.spec.id == "cid"  # the aligned id name is used on both sides


def test_strict_alignment_rejects_shape_mismatch(spark):
    ref = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    cur = spark.createDataFrame([(1.0, 2.0)], "c double, d double")
    with pytest.raises(ValueError, match="shape"):
        align_positional(ref, cur, DatasetSpec(("a", "b", "c")), DatasetSpec(("c", "d")))
    # without strict, a, b, c -> c, d, c would duplicate a name: refused
    with pytest.raises(ValueError, match="duplicate"):
        align_positional(ref, cur, DatasetSpec(("a", "b", "c")), DatasetSpec(("c", "d")), strict=False)
    # an id on one side only
    with pytest.raises(ValueError, match="shape"):
        align_positional(ref, cur, DatasetSpec(("b", "c"), id="a"), DatasetSpec(("c", "d")))


def test_non_strict_alignment_drops_excess(spark):
    ref = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, x double")
    cur = spark.createDataFrame([(1.0, 2.0)], "c double, d double")
    al = align_positional(ref, cur, DatasetSpec(("a", "b", "x")), DatasetSpec(("c", "d")), strict=False)
    assert al.ref.columns == ["c", "d"] and al.spec.features == ("c", "d")


def test_mixed_kinds(spark):
    r = DataDefinition(None, ("v",), ("s",), ())
    c = DataDefinition(None, ("s",), ("v",), ())
    with pytest.raises(ValueError, match="in the reference and"):
        reconcile(r, c)
    d = reconcile(r, c, strict=False)
    assert d.numerical == () and d.categorical == () and set(d.other) == {"s", "v"}


def test_definition_table_counts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 3.0, None)], "k bigint, v double, s string")
    coerced, d = define(df, "k")
    got = {(r.column_name, r.kind, r.non_null) for r in definition_table(coerced, d).collect()}
    assert got == {("k", "id", 2), ("v", "numerical", 1), ("s", "categorical", 1)}


def test_contracts(spark):
    df = spark.createDataFrame([], "nid bigint, n_price double, n_flag string, n_ts timestamp, "
                                   "rid bigint, r_price double, r_flag string, r_ts timestamp, b boolean")
    ok = {"newdata_id": ["nid"], "newdata": ["n_price", "n_flag"], "newdata_date": ["n_ts"],
          "refdata_id": ["rid"], "refdata": ["r_price", "r_flag"], "refdata_date": ["r_ts"]}
    assert check_contract(df.schema, ok) == []
    bad = dict(ok, newdata=[], refdata_id=["rid", "nid"], refdata=["b"])
    problems = {(g, c, p.split(" ")[0]) for g, c, p in check_contract(df.schema, bad)}
    assert ("newdata", None, "needs") in problems
    assert ("refdata_id", None, "allows") in problems
    assert ("refdata", "b", "type") in problems
    v = contract_violations(spark, df, bad)
    assert v.count() == len(problems)
    sel = spark.createDataFrame([], "run bigint, bld double")
    assert check_contract(sel.schema, {"Simulationslauf": ["run"], "Gebäude": ["bld"]}, SELECTION_GROUPS)


def test_column_groups_end_to_end(spark):
    rows = [(i, float(i), i % 3, "a" if i % 2 else "b", i + 1, float(i) * 2, i % 3, "b" if i % 2 else "a")
            for i in range(40)]
    df = spark.createDataFrame(rows, "nid bigint, n_price double, n_qty bigint, n_flag string, "
                                     "rid bigint, r_price double, r_qty bigint, r_flag string")
    groups = ColumnGroups(new_features=("n_price", "n_qty", "n_flag"), ref_features=("r_price", "r_qty", "r_flag"),
                          new_id="nid", ref_id="rid", labels={"n_flag": "flag", "r_flag": "label"})
    rep = compare_groups(df, groups)
    got = {r.column_name: r for r in rep.columns.collect()}
    assert set(got) == {"n_price", "n_qty", "flag"}
    assert got["n_qty"].psi == 0.0 and got["flag"].psi == 0.0   # same multisets on both sides
    assert got["n_price"].psi > 0.1
    with pytest.raises(ValueError, match="contract"):
        compare_groups(df, ColumnGroups(new_features=(), ref_features=("r_price",)))


def test_split_keeps_labels_and_drops_null_condition(spark):
    from driftwise import compare_split
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (None, 9.0, "z"), (3, 1.0, "a")],
                               "g bigint, v double, s string")
    spec = DatasetSpec(features=("v", "s"), labels={"v": "value", "s": "flag"})
    rep = compare_split(df, spec, F.col("g") >= 2)
    got = {r.column_name: (r.ref_count, r.cur_count) for r in rep.columns.collect()}
    assert got == {"value": (1, 2), "flag": (1, 2)}   # the row with a null g belongs to neither side


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1, 1.0, "x", 2.0, "y"), (2, 2.0, "x", 4.0, "z")],
                               "`id.x` bigint, `a.b` double, `c d` string, `e``f` double, g string")
    rs = DatasetSpec(features=("a.b", "c d"), id="id.x")
    cs = DatasetSpec(features=("e`f", "g"), id="id.x")
    rep = compare_frames(df, df, rs, cs)
    got = {r.column_name: r.kind for r in rep.columns.collect()}
    assert got == {"e`f": "numerical", "g": "categorical"}
    assert id_first(df, "c d").columns[0] == "c d"


def test_combined_drift_table_fixture(spark):
    """FIXTURES §2: six groups in one table, nulls on one side, a constant
    column, NaN and infinity, and labels that swap two names."""
    import datetime as _dt
    from tests.helpers import psi_categorical, psi_numeric
    rows = []
    for i in range(60):
        rows.append((i, float("nan") if i == 3 else i * 1.5, 7, "a" if i % 3 else "b", _dt.datetime(2024, 1, 1 + i % 28),
                     i + 100, float("inf") if i == 5 else (i % 10) * 2.0, None, "c" if i % 4 else "a",
                     _dt.datetime(2023, 1, 1 + i % 28)))
    schema = ("nid bigint, n_price double, n_qty bigint, n_flag string, n_ts timestamp, "
              "rid bigint, r_price double, r_qty bigint, r_flag string, r_ts timestamp")
    df = spark.createDataFrame(rows, schema)
    groups = ColumnGroups(
        new_features=("n_price", "n_qty", "n_flag"), ref_features=("r_price", "r_qty", "r_flag"),
        new_id="nid", ref_id="rid", new_datetimes=("n_ts",), ref_datetimes=("r_ts",),
        # the new side's labels swap two names
        labels={"n_price": "qty", "n_qty": "price", "r_price": "p", "r_qty": "q"})
    rep = compare_groups(df, groups)
    got = {r.column_name: r for r in rep.columns.collect()}
    assert set(got) == {"qty", "price", "n_flag"}            # current-side labels, by position
    cur = {"qty": [r[1] for r in rows], "price": [r[2] for r in rows], "n_flag": [r[3] for r in rows]}
    ref = {"qty": [r[6] for r in rows], "price": [r[7] for r in rows], "n_flag": [r[8] for r in rows]}
    # "qty" holds n_price (NaN dropped) against r_price (inf dropped)
    psi, bins = psi_numeric(ref["qty"], cur["qty"])
    assert got["qty"].psi == pytest.approx(psi, abs=1e-7) and got["qty"].bins == bins
    assert (got["qty"].ref_count, got["qty"].cur_count) == (59, 59)
    # "price" is the constant n_qty against an all-null r_qty: no reference values
    assert got["price"].psi is None and got["price"].ref_count == 0
    psi, bins = psi_categorical(ref["n_flag"], cur["n_flag"])
    assert got["n_flag"].psi == pytest.approx(psi, abs=1e-7)
    assert got["n_flag"].kind == "categorical" and got["qty"].kind == "numerical"
    # datetimes and ids are carried, never scored
    assert {r.column_name for r in rep.columns.collect()}.isdisjoint({"n_ts", "nid"})


def test_parse_timestamp_offsets(spark):
    from driftwise.functions.scalar import parse_timestamp
    rows = [("2025-01-01T10:00:00+02:00",), ("2025-01-01T10:00:00Z",), ("2025-01-01 10:00:00",),
            ("2025-01-01",), ("garbage",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    z = spark.createDataFrame([("01/01/2025 10:00 +0200",), ("01/01/2025 10:00 +0000",)], "t string")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r.p for r in df.select(parse_timestamp("t").alias("p")).collect()]
            assert got == [dt.datetime(2025, 1, 1, 8), dt.datetime(2025, 1, 1, 10), dt.datetime(2025, 1, 1, 10),
                           dt.datetime(2025, 1, 1), None, None], zone
            got = [r.p for r in z.select(parse_timestamp("t", "dd/MM/yyyy HH:mm xx").alias("p")).collect()]
            assert got == [dt.datetime(2025, 1, 1, 8), dt.datetime(2025, 1, 1, 10)], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_csv_inferred_types_for_the_sample(spark, tmp_dir):
    from driftwise.sources.files import read_csv
    p = f"{tmp_dir}/s.txt"
    with open(p, "w") as fh:
        fh.write(SAMPLE_REF)
    df = read_csv(spark, p)                      # no schema: types inferred (exploration only)
    types = dict(df.dtypes)
    assert types["str"] == "string" and types["flo"] == "double"
    assert types["int"] in ("int", "bigint")
    assert types["dat"] == "string"              # "2025-17-03" is not a date, so the column stays text
    spec = DatasetSpec(features=("str", "int", "flo"), datetimes=("dat",))
    got = {r.column_name: r.kind for r in compare_frames(df, df, spec).columns.collect()}
    assert got == {"str": "categorical", "int": "numerical", "flo": "numerical"}


def test_definition_table_chunks(spark):
    df = spark.createDataFrame([(1, 2.0, "a", None, 5), (2, None, "b", "x", 6)],
                               "k bigint, v double, s string, t string, n int")
    coerced, d = define(df, "k")
    whole = {tuple(r) for r in definition_table(coerced, d).collect()}
    chunked = {tuple(r) for r in definition_table(coerced, d, chunk=2).collect()}
    assert whole == chunked == {("k", "id", 2), ("v", "numerical", 1), ("n", "numerical", 2),
                                ("s", "categorical", 2), ("t", "categorical", 1)}


def test_spec_rejects_clashing_labels():
    with pytest.raises(ValueError, match="labels"):
        DatasetSpec(features=("a", "b"), labels={"a": "x", "b": "x"})
    with pytest.raises(ValueError, match="role"):
        DatasetSpec(features=("a",), id="a")
    with pytest.raises(ValueError, match="feature"):
        DatasetSpec(features=())
