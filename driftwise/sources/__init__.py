"""Scans and sinks: CSV / Parquet, split-oriented JSON, exported tracking
tables and the drift report."""

from driftwise.sources.files import csv_to_parquet, read_csv, read_exact_csv, read_parquet, write_csv, write_parquet
from driftwise.sources.report import StoredReport, read_report, write_report
from driftwise.sources.split_document import read_split_document
from driftwise.sources.split_json import read_split_json, split_documents, write_split_json
from driftwise.sources.tracking import experiments, has_rows, latest_runs, merge_runs, read_export, runs

__all__ = [
    "StoredReport",
    "csv_to_parquet",
    "experiments",
    "has_rows",
    "latest_runs",
    "merge_runs",
    "read_csv",
    "read_exact_csv",
    "read_export",
    "read_parquet",
    "read_report",
    "read_split_document",
    "read_split_json",
    "runs",
    "split_documents",
    "write_csv",
    "write_parquet",
    "write_report",
    "write_split_json",
]
