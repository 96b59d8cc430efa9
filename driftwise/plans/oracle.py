"""DuckDB SQL that states, independently of the Spark plans, what each
registered query must return.  Tables are the driver's pre-registered views.
"""

from __future__ import annotations

from driftwise.operators.links import LIST_LINKS, RUN_LINKS

CAP = 130  # stated here on its own: the check must not follow the code

THRESHOLD = 0.1
SHARE = 0.5


def _num_branch(src: str, col: str, i: int) -> tuple[str, str]:
    ctes = f"""
u{i} AS (SELECT side, CAST({col} AS DOUBLE) AS v FROM ({src}) s
         WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))
           AND abs(CAST({col} AS DOUBLE)) < CAST('infinity' AS DOUBLE)),
a{i} AS (SELECT min(v) AS lo, max(v) AS hi,
                count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS nc
         FROM u{i}),
k{i} AS (SELECT lo, hi, nr, nc,
                CASE WHEN nr + nc <= 1 THEN 1 ELSE length(bin(nr + nc - 1)) + 1 END AS k FROM a{i}),
b{i} AS (SELECT side, CASE WHEN hi = lo THEN 0
                ELSE least(CAST(floor((v - lo) / ((hi - lo) / k)) AS INTEGER), k - 1) END AS bin
         FROM u{i}, k{i}),
g{i} AS (SELECT bin, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS c
         FROM b{i} GROUP BY bin),
p{i} AS (SELECT '{col}' AS column_name, 'numerical' AS kind, count(g{i}.bin) AS bins,
                sum((CASE WHEN c = 0 THEN 0.0001 ELSE c / nc END - CASE WHEN r = 0 THEN 0.0001 ELSE r / nr END)
                    * ln(CASE WHEN c = 0 THEN 0.0001 ELSE c / nc END / CASE WHEN r = 0 THEN 0.0001 ELSE r / nr END)) AS psi_raw,
                any_value(nr) AS nr, any_value(nc) AS nc
         FROM k{i} LEFT JOIN g{i} ON true)"""
    return ctes, f"p{i}"


def _cat_branch(src: str, col: str, i: int) -> tuple[str, str]:
    ctes = f"""
u{i} AS (SELECT side, CAST({col} AS VARCHAR) AS v FROM ({src}) s WHERE {col} IS NOT NULL),
a{i} AS (SELECT count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS nc FROM u{i}),
g{i} AS (SELECT v, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS c
         FROM u{i} GROUP BY v),
p{i} AS (SELECT '{col}' AS column_name, 'categorical' AS kind, count(g{i}.v) AS bins,
                sum((CASE WHEN c = 0 THEN 0.0001 ELSE c / nc END - CASE WHEN r = 0 THEN 0.0001 ELSE r / nr END)
                    * ln(CASE WHEN c = 0 THEN 0.0001 ELSE c / nc END / CASE WHEN r = 0 THEN 0.0001 ELSE r / nr END)) AS psi_raw,
                any_value(nr) AS nr, any_value(nc) AS nc
         FROM a{i} LEFT JOIN g{i} ON true)"""
    return ctes, f"p{i}"


def drift_columns_sql(src: str, numerical: list[str], categorical: list[str],
                      threshold: float = THRESHOLD) -> str:
    """Per-column PSI.  ``src`` yields ``side`` (0 reference, 1 current) and
    the named columns."""
    ctes, parts = [], []
    for i, c in enumerate(numerical):
        t, p = _num_branch(src, c, i)
        ctes.append(t)
        parts.append(p)
    for j, c in enumerate(categorical):
        t, p = _cat_branch(src, c, len(numerical) + j)
        ctes.append(t)
        parts.append(p)
    union = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
    return f"""WITH {','.join(ctes)},
allp AS ({union}),
fin AS (SELECT column_name, kind, CAST(bins AS BIGINT) AS bins, CAST(nr AS BIGINT) AS ref_count,
               CAST(nc AS BIGINT) AS cur_count,
               CASE WHEN nr > 0 AND nc > 0 THEN round(psi_raw, 8) END AS psi
        FROM allp)
SELECT column_name, kind, bins, ref_count, cur_count, psi, CAST({threshold} AS DOUBLE) AS threshold,
       psi >= {threshold} AS drifted
FROM fin"""


def drift_summary_sql(columns_sql: str, share: float = SHARE) -> str:
    return f"""WITH c AS ({columns_sql}),
s AS (SELECT CAST(count(psi) AS BIGINT) AS scored_columns,
             CAST(count(*) FILTER (WHERE drifted) AS BIGINT) AS drifted_columns FROM c)
SELECT scored_columns, drifted_columns,
       CASE WHEN scored_columns > 0 THEN round(drifted_columns / scored_columns, 8) END AS drifted_share,
       CASE WHEN scored_columns > 0 THEN round(drifted_columns / scored_columns, 8) END >= {share} AS dataset_drifted
FROM s"""


def drift_tests_sql(columns_sql: str, share: float = SHARE) -> str:
    return f"""WITH c AS ({columns_sql}),
s AS ({drift_summary_sql(columns_sql, share)})
SELECT 'column_drift' AS test, column_name, psi AS value, threshold AS "limit",
       CASE WHEN psi IS NULL THEN 'SKIPPED' WHEN drifted THEN 'FAIL' ELSE 'SUCCESS' END AS status
FROM c
UNION ALL
SELECT 'drifted_share', CAST(NULL AS VARCHAR), drifted_share, CAST({share} AS DOUBLE),
       CASE WHEN drifted_share IS NULL THEN 'SKIPPED' WHEN dataset_drifted THEN 'FAIL' ELSE 'SUCCESS' END
FROM s"""


def numeric_bins_sql(src: str, col: str) -> str:
    return f"""WITH u AS (SELECT side, CAST({col} AS DOUBLE) AS v FROM ({src}) s
         WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))
           AND abs(CAST({col} AS DOUBLE)) < CAST('infinity' AS DOUBLE)),
a AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM u),
k AS (SELECT lo, hi, CASE WHEN n <= 1 THEN 1 ELSE length(bin(n - 1)) + 1 END AS k FROM a),
b AS (SELECT side, lo, hi, k, CASE WHEN hi = lo THEN 0
             ELSE least(CAST(floor((v - lo) / ((hi - lo) / k)) AS INTEGER), k - 1) END AS bin
      FROM u, k)
SELECT '{col}' AS column_name, CAST(bin AS BIGINT) AS bin,
       round(lo + bin * ((hi - lo) / k), 8) AS lower,
       round(CASE WHEN hi = lo THEN hi ELSE lo + (bin + 1) * ((hi - lo) / k) END, 8) AS upper,
       count(*) FILTER (WHERE side = 0) AS ref_count, count(*) FILTER (WHERE side = 1) AS cur_count
FROM b GROUP BY bin, lo, hi, k"""


def category_counts_sql(src: str, col: str) -> str:
    return f"""SELECT '{col}' AS column_name, CAST({col} AS VARCHAR) AS value,
       count(*) FILTER (WHERE side = 0) AS ref_count, count(*) FILTER (WHERE side = 1) AS cur_count
FROM ({src}) s WHERE {col} IS NOT NULL GROUP BY {col}"""


def bounded_ids_sql(selection: str, cap: int = CAP) -> str:
    """``selection`` yields ``run_id`` and ``building_id``."""
    return f"""WITH r AS (SELECT run_id, building_id,
                  row_number() OVER (PARTITION BY run_id ORDER BY building_id NULLS LAST) AS rn
           FROM ({selection}) s)
SELECT run_id,
       coalesce(nullif(string_agg(CAST(building_id AS VARCHAR), ',' ORDER BY building_id)
                       FILTER (WHERE rn <= {cap}), ''), '0') AS ids,
       CAST(max(CASE WHEN rn > {cap} AND building_id IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS max,
       count(building_id) AS n_ids
FROM r GROUP BY run_id"""


def id_pages_sql(selection: str, cap: int = CAP) -> str:
    return f"""WITH r AS (SELECT run_id, building_id,
                  (row_number() OVER (PARTITION BY run_id ORDER BY building_id) - 1) // {cap} AS page
           FROM ({selection}) s WHERE building_id IS NOT NULL)
SELECT run_id, page, string_agg(CAST(building_id AS VARCHAR), ',' ORDER BY building_id) AS ids, count(*) AS n_ids
FROM r GROUP BY run_id, page"""


def view_links_no_ids_sql(selection: str, base_url: str = "/") -> str:
    kinds = " UNION ALL ".join(f"SELECT '{k}' AS link, '{p}' AS path" for k, p in LIST_LINKS.items())
    return f"""WITH b AS (SELECT DISTINCT run_id FROM ({selection}) s), k AS ({kinds})
SELECT run_id, link, '0' AS ids, CAST(0 AS INTEGER) AS max,
       '{base_url}' || path || '?rechenlauf=' || CAST(run_id AS VARCHAR) || '&gebid=0&max=0' AS url
FROM b, k"""


def view_links_list_sql(selection: str, base_url: str = "/", cap: int = CAP) -> str:
    kinds = " UNION ALL ".join(f"SELECT '{k}' AS link, '{p}' AS path" for k, p in LIST_LINKS.items())
    return f"""WITH b AS ({bounded_ids_sql(selection, cap)}), k AS ({kinds})
SELECT run_id, link, ids, max,
       '{base_url}' || path || '?rechenlauf=' || CAST(run_id AS VARCHAR) || '&gebid=' || ids
       || '&max=' || CAST(max AS VARCHAR) AS url
FROM b, k"""


def view_links_run_sql(selection: str, base_url: str = "/") -> str:
    kinds = " UNION ALL ".join(f"SELECT '{k}' AS link, '{p}' AS path" for k, p in RUN_LINKS.items())
    return f"""WITH b AS (SELECT DISTINCT run_id FROM ({selection}) s), k AS ({kinds})
SELECT run_id, link, '{base_url}' || path || '?rechenlauf=' || CAST(run_id AS VARCHAR) AS url
FROM b, k"""
