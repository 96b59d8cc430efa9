"""Command line: run the library's entry points as batch jobs.

    python -m driftwise drift --reference R --current C --features a,b --out DIR
    python -m driftwise links --selection S --run run_id [--ids building_id] --out DIR
    python -m driftwise convert --csv IN --parquet OUT

On a cluster, ship the package and submit this file:
``spark-submit --py-files driftwise.zip driftwise/__main__.py drift ...``.

Inputs are read with ``spark.read.format(--format)`` (Parquet by default);
results are written below ``--out`` (the drift report as three tables) and a
short summary is printed.  The session comes from ``spark-submit`` or is
built locally.
"""

from __future__ import annotations

import argparse
import sys

from driftwise.operators.compare import compare_frames
from driftwise.operators.links import CAP, LIST_LINKS, RUN_LINKS, view_links
from driftwise.operators.roundtrip import compare_tables
from driftwise.session import get_session
from driftwise.sources.files import csv_to_parquet, read_csv
from driftwise.sources.report import write_report
from driftwise.spec import DatasetSpec


def _names(text: str | None) -> tuple[str, ...]:
    return tuple(n.strip() for n in text.split(",") if n.strip()) if text else ()


def _drift(spark, a) -> int:
    ref = spark.read.format(a.format).load(a.reference)
    cur = spark.read.format(a.format).load(a.current)
    ref_spec = DatasetSpec(_names(a.features), a.id, _names(a.datetimes))
    cur_spec = DatasetSpec(_names(a.current_features) or ref_spec.features,
                           a.current_id or a.id, _names(a.current_datetimes) or ref_spec.datetimes)
    report = compare_frames(ref, cur, ref_spec, cur_spec, strict=not a.loose,
                            datetime_format=a.datetime_format, threshold=a.threshold, share=a.share)
    stored = write_report(spark, report, a.out)
    stored.summary.show(truncate=False)
    return 0


def _links(spark, a) -> int:
    sel = spark.read.format(a.format).load(a.selection)
    kinds = {"all": list(LIST_LINKS) + list(RUN_LINKS), "list": list(LIST_LINKS),
             "run": list(RUN_LINKS)}.get(a.kinds) or list(_names(a.kinds))
    out = view_links(sel, kinds, a.run, a.ids, base_url=a.base_url, cap=CAP)
    out.write.mode("overwrite").parquet(a.out)
    print(f"links written to {a.out}")
    return 0


def _convert(spark, a) -> int:
    source = read_csv(spark, a.csv, a.schema)
    converted = csv_to_parquet(spark, a.csv, a.parquet, source.schema)
    rows = compare_tables(spark, source, converted).collect()   # three rows
    for r in rows:
        print(f"{r.check}: {r.result} ({r.differences} differences)")
    return 0 if all(r.result == "identical" for r in rows) else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="driftwise")
    sub = p.add_subparsers(dest="command", required=True)

    d = sub.add_parser("drift", help="PSI drift of a current table against a reference table")
    d.add_argument("--reference", required=True)
    d.add_argument("--current", required=True)
    d.add_argument("--features", required=True, help="comma list (reference side)")
    d.add_argument("--id")
    d.add_argument("--datetimes")
    d.add_argument("--current-features", help="comma list when the current names differ")
    d.add_argument("--current-id")
    d.add_argument("--current-datetimes")
    d.add_argument("--datetime-format")
    d.add_argument("--threshold", type=float, default=0.1)
    d.add_argument("--share", type=float, default=0.5)
    d.add_argument("--loose", action="store_true", help="allow sides of different shape")
    d.add_argument("--format", default="parquet")
    d.add_argument("--out", required=True)

    k = sub.add_parser("links", help="bounded id lists and view links per run")
    k.add_argument("--selection", required=True)
    k.add_argument("--run", required=True)
    k.add_argument("--ids")
    k.add_argument("--kinds", default="all", help="all, list, run, or a comma list of link names")
    k.add_argument("--base-url", default="/")
    k.add_argument("--format", default="parquet")
    k.add_argument("--out", required=True)

    c = sub.add_parser("convert", help="CSV to Parquet with a round-trip check")
    c.add_argument("--csv", required=True)
    c.add_argument("--parquet", required=True)
    c.add_argument("--schema", help="DDL schema; inferred when omitted")

    a = p.parse_args(argv)
    spark = get_session()
    return {"drift": _drift, "links": _links, "convert": _convert}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
