import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from driftwise.operators import links
from driftwise.operators.links import CAP, LIST_LINKS, RUN_LINKS, first_cell, id_pages

bounded_ids, view_links = partial(links.bounded_ids, cap=CAP), partial(links.view_links, cap=CAP)


def brute(rows, cap=CAP):
    """Per run: (ids text, flag) computed in plain Python."""
    out = {}
    for run in {r for r, _ in rows}:
        ids = sorted(i for r, i in rows if r == run and i is not None)
        listed = ids[:cap]
        out[run] = (",".join(map(str, listed)) or "0", int(len(ids) > cap))
    return out


def run_ids(spark, rows, **kw):
    df = spark.createDataFrame(rows, "run bigint, bid bigint")
    return {r.run: (r.ids, r.max) for r in bounded_ids(df, "run", "bid", **kw).collect()}


def test_cap_boundaries_and_nulls(spark):
    rows = [(1, i) for i in range(130)] + [(1, None)]          # 130 ids + a null: no overflow
    rows += [(2, i) for i in range(131)]                        # 131 ids: overflow
    rows += [(3, None), (3, None)]                              # only nulls: '0'
    rows += [(4, 5), (4, 5), (4, 1)]                            # duplicates kept
    got = run_ids(spark, rows)
    assert got[1][1] == 0 and got[1][0].count(",") == 129
    assert got[2][1] == 1 and got[2][0].split(",")[-1] == "129"
    assert got[3] == ("0", 0)
    assert got[4] == ("1,5,5", 0)
    assert got == brute(rows)


def test_empty_selection_gives_no_rows(spark):
    assert run_ids(spark, []) == {}


def test_hot_run_two_level_equals_brute_force(spark):
    rnd = random.Random(7)
    rows = [(0, rnd.randrange(10_000)) for _ in range(3000)]           # one run holds most rows
    rows += [(r, rnd.randrange(10_000)) for r in range(1, 40) for _ in range(rnd.randrange(0, 200))]
    rows += [(5, None)] * 20
    want = brute(rows)
    df = spark.createDataFrame(rows, "run bigint, bid bigint").repartition(16)
    for salts in (1, 4):
        got = {r.run: (r.ids, r.max) for r in bounded_ids(df, "run", "bid", salts=salts).collect()}
        assert got == want


def test_plan_uses_group_limit(spark):
    df = spark.createDataFrame([(1, 2)], "run bigint, bid bigint")
    plan = bounded_ids(df, "run", "bid")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    salted = bounded_ids(df, "run", "bid", salts=4)._jdf.queryExecution().executedPlan().toString()
    assert salted.count("WindowGroupLimit") >= 2


def test_url_formats(spark):
    df = spark.createDataFrame([(7, 3), (7, 1), (8, None)], "run bigint, bid bigint")
    got = {(r.run, r.link): r.url for r in view_links(df, list(LIST_LINKS)[:1], "run", "bid",
                                                       base_url="http://h/").collect()}
    assert got[(7, "2d-individuelle-gebaeudefaerbung-wms")] == \
        "http://h/app/2d-db-geb-eigfaerb-wms?rechenlauf=7&gebid=1,3&max=0"
    assert got[(8, "2d-individuelle-gebaeudefaerbung-wms")].endswith("gebid=0&max=0")
    run_only = view_links(df, list(RUN_LINKS), "run", base_url="http://h/")
    assert run_only.count() == 2 * len(RUN_LINKS)
    u = {r.url for r in run_only.where("run = 7").collect()}
    assert "http://h/app/2d-db-geb-allefaerbung-wms?rechenlauf=7" in u


def test_list_kind_without_id_column(spark):
    df = spark.createDataFrame([(7,), (7,)], "run bigint")
    rows = view_links(df, ["3d-wms-simulationsdaten"], "run").collect()
    assert len(rows) == 1 and rows[0].url == "/app/3d-wms-base-gel-db-geb?rechenlauf=7&gebid=0&max=0"


def test_unknown_kind(spark):
    df = spark.createDataFrame([(7,)], "run bigint")
    with pytest.raises(ValueError):
        view_links(df, ["nope"], "run")


def test_first_cell(spark):
    df = spark.createDataFrame([(3, 30), (1, 10), (2, 20)], "k bigint, v bigint")
    assert first_cell(df, "k", "v").collect()[0].v == 10


def test_two_levels_everywhere(spark):
    rows = [(0, i) for i in range(500)] + [(1, i) for i in range(10)]
    df = spark.createDataFrame(rows, "run bigint, bid bigint").repartition(100)
    plan = bounded_ids(df, "run", "bid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4      # partial and final, twice
    for salts in (1, 10, 16):
        got = {r.run: (r.ids, r.max, r.n_ids) for r in bounded_ids(df, "run", "bid", salts=salts).collect()}
        assert got == {k: (*v, 500 if k == 0 else 10) for k, v in brute(rows).items()}


def _big(spark):
    rnd = random.Random(3)
    rows = [(0, rnd.randrange(50_000)) for _ in range(20_000)] + [(1, i) for i in range(5_000)] + [(2, i) for i in range(5_001)]
    rows += [(3, None), (4, 7), (4, 7), (None, 3), (None, None)] + [(5, None)] * 50 + [(1, None)]
    return rows, spark.createDataFrame(rows, "run bigint, bid bigint").repartition(9)


@pytest.mark.parametrize("cap", [1_000, 5_000, 30_000])
def test_caps_beyond_the_group_limit(spark, cap):
    """The list, the flag and the count stay exact; no window holds a whole run."""
    rows, df = _big(spark)
    got = {r.run: (r.ids, r.max, r.n_ids) for r in links.bounded_ids(df, "run", "bid", cap).collect()}
    assert got == {k: (*v, sum(r == k and i is not None for r, i in rows)) for k, v in brute(rows, cap).items()}
    listed = links.bounded_ids(df, "run", "bid", cap, count=False)
    assert listed.columns == ["run", "ids", "max"] and {r.run: (r.ids, r.max) for r in listed.collect()} == brute(rows, cap)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and "row_number() windowspecdefinition(run" in plan and ", slice" in plan.split("row_number()")[1][:200]
    assert links.bounded_ids(df.limit(0), "run", "bid", cap).count() == 0
    with pytest.raises(TypeError):
        links.bounded_ids(df, "run", "bid")


def test_links_do_not_count(spark):
    """View links need no second pass for a number that they do not show."""
    df = spark.createDataFrame([(1, 2)], "run bigint, bid bigint")
    with_count, without = (links.bounded_ids(df, "run", "bid", CAP, count=c)._jdf.queryExecution().executedPlan().toString() for c in (True, False))
    links_plan = view_links(df, list(LIST_LINKS), "run", "bid")._jdf.queryExecution().executedPlan().toString()
    assert "Union" in with_count and "Union" not in without and "Union" not in links_plan


@pytest.mark.parametrize("cap", [1, 7, 130, 1500])
def test_pages_lose_no_id(spark, cap):
    rows = [(0, i % 900) for i in range(2000)] + [(1, 3), (1, None), (2, None), (None, 4)]
    df = spark.createDataFrame(rows, "run bigint, bid bigint").repartition(7)
    got = {(r.run, r.page): (r.ids, r.n_ids) for r in id_pages(df, "run", "bid", cap).collect()}
    want = {}
    for run in (0, 1, None):
        ids = sorted(i for r, i in rows if r == run and i is not None)
        for page in range(0, len(ids), cap):
            part = ids[page:page + cap]
            want[run, page // cap] = (",".join(map(str, part)), len(part))
    assert got == want


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 400))), max_size=400),
       st.integers(1, 140))
def test_bounded_ids_property(spark, rows, cap):
    df = spark.createDataFrame(rows, "run bigint, bid bigint")
    got = {r.run: (r.ids, r.max) for r in bounded_ids(df, "run", "bid", cap=cap, salts=3).collect()}
    assert got == brute(rows, cap)


def test_selection_contract(spark):
    df = spark.createDataFrame([(7, 1.5)], "run bigint, bid double")
    with pytest.raises(ValueError, match="contract"):
        view_links(df, list(LIST_LINKS)[:1], "run", "bid")


def test_mixed_kinds_in_one_call(spark):
    df = spark.createDataFrame([(7, 3), (7, 1)], "run bigint, bid bigint")
    kinds = [list(LIST_LINKS)[0], list(RUN_LINKS)[0]]
    rows = {r.link: r for r in view_links(df, kinds, "run", "bid").collect()}
    assert rows[kinds[0]].ids == "1,3" and rows[kinds[0]].max == 0
    assert rows[kinds[1]].ids is None and rows[kinds[1]].url.endswith("rechenlauf=7")


def test_first_cell_skips_null_order_values(spark):
    df = spark.createDataFrame([(None, 99), (2, 20), (1, 10)], "k bigint, v bigint")
    assert [r.v for r in first_cell(df, "k", "v").collect()] == [10]
    assert first_cell(df.where("false"), "k", "v").count() == 0
