from driftwise.__main__ import main
from driftwise.sources.report import read_report
from tests.conftest import SF001


def test_cli_drift_links_convert(spark, tmp_dir, capsys):
    assert main(["drift", "--reference", f"{SF001}/orders.parquet", "--current", f"{SF001}/orders.parquet",
                 "--features", "o_totalprice,o_orderpriority", "--out", f"{tmp_dir}/r"]) == 0
    cols = read_report(spark, f"{tmp_dir}/r").columns.collect()
    assert {r.column_name for r in cols} == {"o_totalprice", "o_orderpriority"}
    assert all(r.psi == 0.0 for r in cols)
    assert main(["links", "--selection", f"{SF001}/orders.parquet", "--run", "o_custkey",
                 "--ids", "o_orderkey", "--kinds", "run", "--out", f"{tmp_dir}/l"]) == 0
    assert spark.read.parquet(f"{tmp_dir}/l").select("link").distinct().count() == 4
    with open(f"{tmp_dir}/in.csv", "w") as fh:
        fh.write("a,b\nx,1\ny,2\n")
    assert main(["convert", "--csv", f"{tmp_dir}/in.csv", "--parquet", f"{tmp_dir}/o.parquet",
                 "--schema", "a string, b bigint"]) == 0
    assert "contents: identical" in capsys.readouterr().out
