"""driftwise: dataset drift comparison and selection links on Spark."""

from driftwise.operators.align import ColumnGroups, align_positional, project_side
from driftwise.operators.classify import classify, define, definition_table
from driftwise.operators.compare import compare_frames, compare_groups, compare_split
from driftwise.operators.contract import check_contract, contract_violations, require_contract
from driftwise.operators.drift import (
    DriftReport,
    category_counts,
    drift_columns,
    drift_report,
    drift_summary,
    drift_tests,
    numeric_bins,
)
from driftwise.operators.links import bounded_ids, first_cell, view_links
from driftwise.operators.roundtrip import column_differences, compare_tables, content_differences, roundtrip_check, row_differences
from driftwise.spec import DataDefinition, DatasetSpec

__all__ = [
    "ColumnGroups",
    "DataDefinition",
    "DatasetSpec",
    "DriftReport",
    "align_positional",
    "bounded_ids",
    "category_counts",
    "check_contract",
    "classify",
    "column_differences",
    "compare_frames",
    "compare_groups",
    "compare_split",
    "compare_tables",
    "content_differences",
    "contract_violations",
    "define",
    "definition_table",
    "drift_columns",
    "drift_report",
    "drift_summary",
    "drift_tests",
    "first_cell",
    "numeric_bins",
    "project_side",
    "require_contract",
    "roundtrip_check",
    "row_differences",
    "view_links",
]
