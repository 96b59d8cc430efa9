"""A report is replaced in one step: readers never meet tables of different runs."""

import os

import pytest

from driftwise import DatasetSpec, compare_frames
from driftwise.sources import report as sink
from driftwise.sources.report import current_version, old_versions, read_report, write_report
from tests.conftest import SF001


def _report(spark, features):
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    spec = DatasetSpec(features=features)
    return compare_frames(orders, orders, spec, spec)


def _seen(stored):
    return stored.columns.count(), stored.summary.first().scored_columns, stored.tests.count()


@pytest.mark.parametrize("dies", ["drift_summary", "drift_tests", "_publish"])
def test_a_write_that_dies_changes_nothing(spark, tmp_dir, monkeypatch, dies):
    """Killed between any two steps, the report before it is still whole."""
    path = f"{tmp_dir}/report"
    first = write_report(spark, _report(spark, ("o_totalprice", "o_orderstatus")), path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sink, dies, killed)
        with pytest.raises(KeyboardInterrupt):
            write_report(spark, _report(spark, ("o_totalprice",)), path)
    assert current_version(spark, path) == first.version and _seen(read_report(spark, path)) == (2, 2, 3)
    assert len(old_versions(spark, path)) == 1                      # what the killed job left
    again = write_report(spark, _report(spark, ("o_totalprice",)), path)
    assert _seen(read_report(spark, path)) == (1, 1, 2) and current_version(spark, path) == again.version
    assert first.version in old_versions(spark, path)
    assert _seen(first) == (2, 2, 3)                                # a reader that had opened it goes on


def test_no_report_yet(spark, tmp_dir, monkeypatch):
    with pytest.raises(FileNotFoundError):
        read_report(spark, f"{tmp_dir}/none")
    monkeypatch.setattr(sink, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        write_report(spark, _report(spark, ("o_totalprice",)), f"{tmp_dir}/r")
    with pytest.raises(FileNotFoundError):
        read_report(spark, f"{tmp_dir}/r")


def test_the_pointer_is_one_small_file(spark, tmp_dir):
    path = f"file://{tmp_dir}/report/"
    for k in range(3):
        stored = write_report(spark, _report(spark, ("o_totalprice",)), path, fmt="json")
    names = [n for n in os.listdir(f"{tmp_dir}/report") if not n.endswith(".crc")]
    assert sum(n.startswith("v-") for n in names) == 3 and [n for n in names if not n.startswith("v-")] == ["_current"]
    with open(f"{tmp_dir}/report/_current") as f:
        assert f.read() == stored.version
    assert read_report(spark, path, "json").tests.count() == 2
