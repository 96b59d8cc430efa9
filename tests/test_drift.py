import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwise import DatasetSpec, compare_frames
from driftwise.operators.align import CUR, REF, SIDE
from driftwise.operators.drift import drift_columns, drift_report, sturges_bins
from driftwise.spec import DataDefinition
from tests.conftest import SF01
from tests.helpers import psi_categorical, psi_numeric, sturges

NUM = DataDefinition(None, ("x",), (), ())
CAT = DataDefinition(None, (), ("s",), ())


def paired_num(spark, ref, cur):
    rows = [(REF, v) for v in ref] + [(CUR, v) for v in cur]
    return spark.createDataFrame(rows, f"{SIDE} tinyint, x double")


def paired_cat(spark, ref, cur):
    rows = [(REF, v) for v in ref] + [(CUR, v) for v in cur]
    return spark.createDataFrame(rows, f"{SIDE} tinyint, s string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_sturges_exact_at_powers_of_two(spark):
    ns = [1, 2, 3, 4, 5, 1023, 1024, 1025, 2 ** 29, 2 ** 29 + 1, 15000]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    got = {r.n: r.k for r in df.select("n", sturges_bins("n").alias("k")).collect()}
    for n in ns:
        expected = 1 if n <= 1 else (n - 1).bit_length() + 1
        assert got[n] == expected, n
        assert sturges(n) == expected


def test_identical_sides_score_zero(spark):
    vals = [float(i % 37) * 1.5 for i in range(500)]
    r = one(drift_columns(paired_num(spark, vals, vals), NUM))
    assert r.psi == 0.0 and r.drifted is False


def test_nulls_nan_inf_are_dropped(spark):
    ref = [1.0, 2.0, None, float("nan"), float("inf"), 3.0, 3.0]
    cur = [1.0, 5.0, float("-inf"), None, 4.0]
    r = one(drift_columns(paired_num(spark, ref, cur), NUM))
    psi, bins = psi_numeric(ref, cur)
    assert (r.ref_count, r.cur_count) == (4, 3)
    assert r.psi == pytest.approx(psi, abs=1e-8)
    assert r.bins == bins


def test_constant_column_scores_zero(spark):
    r = one(drift_columns(paired_num(spark, [7.0] * 10, [7.0] * 3), NUM))
    assert r.psi == 0.0 and r.bins == 1


def test_one_side_empty_gives_null(spark):
    r = one(drift_columns(paired_num(spark, [1.0, 2.0], [None, float("nan")]), NUM))
    assert r.psi is None and r.drifted is None and r.cur_count == 0


def test_categorical_matches_brute_force(spark):
    ref = list("aaabbbcccd") + [None]
    cur = list("aabbbbbeee")
    r = one(drift_columns(paired_cat(spark, ref, cur), CAT))
    psi, bins = psi_categorical(ref, cur)
    assert r.psi == pytest.approx(psi, abs=1e-8) and r.bins == bins


finite = st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False), st.sampled_from([float("nan")]))


@settings(max_examples=8, deadline=None)
@given(st.lists(finite, min_size=0, max_size=40), st.lists(finite, min_size=0, max_size=40))
def test_numeric_psi_property(spark, ref, cur):
    r = one(drift_columns(paired_num(spark, ref, cur), NUM))
    psi, _ = psi_numeric(ref, cur)
    if psi is None:
        assert r.psi is None
    else:
        assert r.psi >= 0
        assert r.psi == pytest.approx(psi, abs=1e-7)
        # symmetric: swapping the sides gives the same score
        s = one(drift_columns(paired_num(spark, cur, ref), NUM))
        assert s.psi == pytest.approx(r.psi, abs=1e-7)


def test_invariant_under_partitioning(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    spec = DatasetSpec(features=("o_totalprice", "o_orderpriority"))
    a = orders.where("o_orderdate < TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    b = orders.where("o_orderdate >= TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    base = {r.column_name: r.psi for r in compare_frames(a, b, spec, spec).columns.collect()}
    shuffled = {r.column_name: r.psi for r in compare_frames(
        a.repartition(13).orderBy(F.rand(1)), b.repartition(3), spec, spec).columns.collect()}
    assert base == shuffled
    assert base["o_totalprice"] == pytest.approx(0.00260074)
    assert base["o_orderpriority"] == pytest.approx(0.00044812)


def test_shifted_prices_drift(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    spec = DatasetSpec(features=("o_totalprice",))
    rep = compare_frames(orders, orders.withColumn("o_totalprice", F.col("o_totalprice") * 1.5), spec, spec)
    r = one(rep.columns)
    assert r.psi == pytest.approx(2.15317588) and r.bins == 16 and r.drifted
    s = one(rep.summary)
    assert (s.scored_columns, s.drifted_columns, s.drifted_share, s.dataset_drifted) == (1, 1, 1.0, True)
    tests = {(t.test, t.column_name): t.status for t in rep.tests.collect()}
    assert tests == {("column_drift", "o_totalprice"): "FAIL", ("drifted_share", None): "FAIL"}


def test_report_threshold_parameters(spark):
    p = paired_cat(spark, list("aab"), list("abb"))
    rep = drift_report(p, CAT, threshold=0.01, share=0.9)
    r = one(rep.columns)
    assert r.threshold == 0.01 and r.drifted
    assert one(rep.summary).dataset_drifted is True
    rep2 = drift_report(p, CAT, threshold=10.0)
    assert one(rep2.columns).drifted is False


def test_plan_reads_only_scored_columns(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    spec = DatasetSpec(features=("o_totalprice",))
    plan = compare_frames(orders, orders, spec, spec).columns._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_value_and_high_cardinality(spark):
    """One value holds a third of the rows; another column is near-unique."""
    import random
    rnd = random.Random(11)
    n = 3000
    ref = [("hot" if i % 3 == 0 else f"v{rnd.randrange(50)}", f"u{i}") for i in range(n)]
    cur = [("hot" if i % 2 == 0 else f"v{rnd.randrange(60)}", f"u{i + n // 2}") for i in range(n)]
    rows = [(REF, a, b) for a, b in ref] + [(CUR, a, b) for a, b in cur]
    paired = spark.createDataFrame(rows, f"{SIDE} tinyint, s string, u string").repartition(7)
    got = {r.column_name: r for r in drift_columns(paired, DataDefinition(None, (), ("s", "u"), ())).collect()}
    for col, idx in (("s", 0), ("u", 1)):
        psi, bins = psi_categorical([x[idx] for x in ref], [x[idx] for x in cur])
        assert got[col].psi == pytest.approx(psi, abs=1e-7) and got[col].bins == bins


def test_numeric_bins_and_category_counts(spark):
    from driftwise.operators.drift import category_counts, numeric_bins
    p = paired_num(spark, [0.0, 1.0, 2.0, 10.0], [10.0, 10.0])
    bins = sorted((r.bin, r.lower, r.upper, r.ref_count, r.cur_count) for r in numeric_bins(p, NUM).collect())
    # n = 6 -> k = 4 bins of width 2.5; 10.0 falls in the last bin
    assert bins == [(0, 0.0, 2.5, 3, 0), (3, 7.5, 10.0, 1, 2)]
    c = paired_cat(spark, ["a", "a", None], ["b"])
    assert sorted(tuple(r) for r in category_counts(c, CAT).collect()) == [("s", "a", 2, 0), ("s", "b", 0, 1)]


def test_many_columns_take_three_scans(spark):
    """150 columns, numerical and categorical: every column equals its brute-force PSI."""
    import random
    rnd = random.Random(5)
    n_num, n_cat, rows_per_side = 80, 70, 60
    num = [f"x{i}" for i in range(n_num)]
    cat = [f"s{i}" for i in range(n_cat)]

    def row(side):
        return ((side,) + tuple(rnd.choice([None, rnd.gauss(i, 3)]) for i in range(n_num))
                + tuple(rnd.choice([None, "a", "b", "c", f"d{side}"]) for _ in range(n_cat)))

    data = [row(REF) for _ in range(rows_per_side)] + [row(CUR) for _ in range(rows_per_side)]
    schema = ", ".join([f"{SIDE} tinyint"] + [f"{c} double" for c in num] + [f"{c} string" for c in cat])
    paired = spark.createDataFrame(data, schema)
    got = {r.column_name: r for r in drift_columns(paired, DataDefinition(None, tuple(num), tuple(cat), ())).collect()}
    assert len(got) == n_num + n_cat
    for j, c in enumerate(num + cat):
        ref = [r[1 + j] for r in data if r[0] == REF]
        cur = [r[1 + j] for r in data if r[0] == CUR]
        psi, bins = (psi_numeric if c in num else psi_categorical)(ref, cur)
        assert got[c].psi == pytest.approx(psi, abs=1e-7), c
        assert got[c].bins == bins, c


def test_three_hundred_columns_are_scanned_twice(spark, tmp_dir):
    """Range, counts and bins of any number of columns: two scans, no aggregate that grows with the width."""
    wide = 300
    spark.range(200).selectExpr(f"CAST(id % 2 AS TINYINT) AS {SIDE}", *[f"CAST(id * {i} % 97 AS DOUBLE) AS x{i}" for i in range(wide)]).write.parquet(f"{tmp_dir}/w")
    paired = spark.read.parquet(f"{tmp_dir}/w")
    names = tuple(f"x{i}" for i in range(wide))
    result = drift_columns(paired, DataDefinition(None, names, (), ()))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Generate posexplode") == 2
    rows = {r.column_name: r for r in result.collect()}
    assert set(rows) == set(names)
    for i in (0, 1, 150, 299):
        ref, cur = ([float(k * i % 97) for k in range(200) if k % 2 == side] for side in (0, 1))
        psi, bins = psi_numeric(ref, cur)
        assert rows[f"x{i}"].psi == pytest.approx(psi, abs=1e-7) and rows[f"x{i}"].bins == bins


def test_range_at_double_limits(spark):
    ref = [-1.7e308, -1e308, 0.0, 1e308]
    cur = [1.7e308, 1.6e308, 0.0, -1.7e308]
    r = one(drift_columns(paired_num(spark, ref, cur), NUM))
    assert r.bins >= 2 and r.psi is not None and r.psi >= 0
    # same bins as an exact computation with rational arithmetic
    from fractions import Fraction
    pooled = ref + cur
    lo, hi, k = Fraction(min(pooled)), Fraction(max(pooled)), sturges(len(pooled))
    def b(v):
        return min(int((Fraction(v) - lo) / ((hi - lo) / k)), k - 1)
    assert r.bins == len({b(v) for v in pooled})


_cell = {
    "bigint": st.one_of(st.none(), st.integers(-5, 5)),
    "double": st.one_of(st.none(), st.floats(-100, 100),
                        st.sampled_from([float("nan"), float("inf"), float("-inf")])),
    "string": st.one_of(st.none(), st.sampled_from(["x", "y", "z"])),
    "boolean": st.one_of(st.none(), st.booleans()),
}
_types = ["bigint", "double", "string", "boolean"]


@settings(max_examples=5, deadline=None)
@given(st.data())
def test_compare_frames_end_to_end_property(spark, data):
    types = data.draw(st.lists(st.sampled_from(_types), min_size=1, max_size=5))
    names = [f"c{i}" for i in range(len(types))]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))

    def table():
        return data.draw(st.lists(st.tuples(*[_cell[t] for t in types]), max_size=25))

    ref, cur = table(), table()
    spec = DatasetSpec(features=tuple(names))
    scored = [n for n, t in zip(names, types) if t != "boolean"]
    if not scored:
        return
    got = {r.column_name: r for r in compare_frames(spark.createDataFrame(ref, schema),
                                                    spark.createDataFrame(cur, schema), spec, empty="null").columns.collect()}
    assert set(got) == set(scored)      # booleans are not scored
    for j, (n, t) in enumerate(zip(names, types)):
        if t == "boolean":
            continue
        fn = psi_categorical if t == "string" else psi_numeric
        psi, bins = fn([r[j] for r in ref], [r[j] for r in cur])
        if psi is None:
            assert got[n].psi is None, n
        else:
            assert got[n].psi == pytest.approx(psi, abs=1e-7), n
            assert got[n].bins == bins, n


def test_groups_share_one_scan_a_pass(spark):
    """Both sides of a combined table come from one scan: one for the ranges, one for the bins."""
    from driftwise import ColumnGroups, compare_groups
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cols = compare_groups(df, ColumnGroups(new_features=("l_quantity", "l_tax"), ref_features=("l_discount", "l_extendedprice"))).columns
    plan = cols._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_side_column_name(spark):
    from driftwise import DatasetSpec, compare_split
    df = spark.createDataFrame([(float(i), i) for i in range(20)], "_side double, k int")
    assert one(compare_split(df, DatasetSpec(features=("_side",)), F.col("k") >= 10).columns).ref_count == 10
    with pytest.raises(ValueError, match="label"):
        compare_split(df.withColumnRenamed("_side", SIDE), DatasetSpec(features=(SIDE,)), F.col("k") >= 10)
