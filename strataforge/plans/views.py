"""Derived input views.  The text of each view runs in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "v_feed_all": """
SELECT event_id AS record_id, user_id, event_type,
       date_trunc('hour', ts) AS updated_at, ts AS ingested_at,
       concat('b', CAST(event_id % 4 AS STRING)) AS batch_id,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE md5(props) END AS checksum,
       CAST(round(value * 100) AS BIGINT) AS cents,
       (event_id % 23 = 0) AS is_deleted
FROM events""",
    # current state: one row per (user_id, event_type); some checksums altered
    "v_target": """
SELECT record_id, user_id, event_type, updated_at, ingested_at, batch_id,
       CASE WHEN user_id % 10 = 1 THEN md5(concat(coalesce(checksum, ''), 'x')) ELSE checksum END AS checksum,
       cents, is_deleted
FROM (SELECT f.*, row_number() OVER (PARTITION BY user_id, event_type
        ORDER BY updated_at DESC, ingested_at DESC, record_id ASC) AS rn
      FROM v_feed_all f
      WHERE record_id % 2 = 0 AND ingested_at < TIMESTAMP '2024-01-20 00:00:00'
        AND NOT is_deleted AND user_id % 7 <> 0) t
WHERE rn = 1""",
    # incoming batch: user groups are stale (0), re-sent (1) or newer (2-4)
    "v_feed": """
SELECT * FROM v_feed_all
WHERE (user_id % 5 = 0 AND ingested_at < TIMESTAMP '2024-01-10 00:00:00')
   OR (user_id % 5 = 1 AND record_id % 2 = 0 AND ingested_at < TIMESTAMP '2024-01-20 00:00:00')
   OR (user_id % 5 >= 2 AND record_id % 3 <> 0)""",
    # indicator x quarter
    "v_kpi": """
SELECT indicator, unit, period, CAST(ship_year * 10 + ship_quarter AS INT) AS sort_key,
       CASE WHEN qty % 13 = 0 THEN NULL ELSE qty END AS value_num,
       CASE WHEN qty % 11 = 0 THEN 'NOT_DUE' WHEN qty % 3 = 0 THEN 'FAILED' ELSE 'PASSED' END AS result,
       concat('target for ', indicator) AS description
FROM (SELECT concat('S', CAST(l_suppkey % 6 AS STRING), '-MT', CAST(l_partkey % 40 AS STRING)) AS indicator,
             concat('S', CAST(l_suppkey % 6 AS STRING)) AS unit,
             concat('Q', CAST(quarter(l_shipdate) AS STRING), '/', CAST(year(l_shipdate) AS STRING)) AS period,
             year(l_shipdate) AS ship_year, quarter(l_shipdate) AS ship_quarter,
             CAST(sum(l_quantity) AS BIGINT) AS qty
      FROM lineitem GROUP BY ALL) t""",
    # programme x academic year x semester
    "v_outcomes": """
SELECT concat(program, '|', academic_year, '|S', CAST(semester AS STRING)) AS record_id, t.*,
       (attempted % 29 = 0) AS is_deleted, md5(concat(program, academic_year)) AS checksum
FROM (SELECT concat(c_mktsegment, '-', CAST(c_nationkey % 5 AS STRING)) AS program,
             concat(CAST(year(o_orderdate) AS STRING), '-', CAST(year(o_orderdate) + 1 AS STRING)) AS academic_year,
             CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS semester,
             count(DISTINCT o_custkey) AS students, count(*) AS attempted,
             sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS passed,
             CAST(sum(CAST(round(o_totalprice / 1000) AS BIGINT)) AS DOUBLE) AS gpa_points,
             sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END) AS gpa_students,
             sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS on_track,
             sum(CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END) AS evaluated,
             max(o_orderdate) AS updated_at
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) t""",
    # course sections with a percentage, some out of range or blank
    "v_sections": """
SELECT concat('SEC', CAST(p_partkey AS STRING)) AS section_code,
       CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE p_brand END AS unit_code,
       '2024-2025' AS academic_year, CAST(p_partkey % 3 AS INT) AS semester,
       CASE WHEN p_partkey % 53 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 101.0E0
            ELSE CAST(90 + p_size % 11 AS DOUBLE) END AS progress_pct,
       CAST(p_size AS BIGINT) AS credits
FROM part""",
    "v_section_metrics": """
SELECT concat('SEC', CAST(p_partkey AS STRING)) AS section_code,
       CAST(85 + p_partkey % 15 AS DOUBLE) AS attendance_pct, CAST(90 + p_partkey % 11 AS DOUBLE) AS grading_pct,
       CAST(400 + p_partkey % 100 AS DOUBLE) / 100 AS feedback
FROM part WHERE p_partkey % 19 <> 0""",
    "v_changes": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS request_id,
       concat('SEC', CAST(l_partkey AS STRING)) AS section_code
FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1""",
    # relational context: anchor = orders, fact = lines, dimension = customers
    "v_context_orders": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
       CAST(round(o_totalprice) AS BIGINT) AS total_amount FROM orders""",
    "v_context_lines": """
SELECT l_orderkey AS order_id, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(round(l_extendedprice) AS BIGINT) AS amount, l_returnflag AS return_flag FROM lineitem""",
    "v_context_customers": """
SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM customer""",
    # text cells as they come out of documents
    "v_docs": """
SELECT o_orderkey % 200 AS file_id, o_orderkey AS row_id,
       CASE o_orderkey % 4 WHEN 0 THEN concat('QUÝ ', CAST(quarter(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
            WHEN 1 THEN concat('q', CAST(quarter(o_orderdate) AS STRING), ' - ', CAST(year(o_orderdate) AS STRING))
            WHEN 2 THEN concat('năm ', CAST(year(o_orderdate) AS STRING)) ELSE 'N/A' END AS period_text,
       CASE o_orderkey % 5 WHEN 0 THEN ' đạt ' WHEN 1 THEN 'KHÔNG ĐẠT' WHEN 2 THEN 'not due yet'
            WHEN 3 THEN 'Passed' ELSE 'other' END AS status_text,
       CASE o_orderkey % 3 WHEN 0 THEN concat(CAST(o_custkey % 100 AS STRING), ',5%')
            WHEN 1 THEN 'N/A' ELSE CAST(o_custkey AS STRING) END AS value_text
FROM orders""",
}


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def needed_views(sql: str) -> list[str]:
    """Views a statement uses, each after the views it builds on."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in found and _mentions(text, name):
                visit(body)
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def needed_tables(sql: str) -> list[str]:
    texts = [sql] + [VIEWS[name] for name in needed_views(sql)]
    return [t for t in TABLES if any(_mentions(text, t) for text in texts)]


def with_views(sql: str, leading: str = "") -> str:
    """Put the used views in front of a statement as common table expressions."""
    parts = ([leading] if leading else []) + [
        f"{name} AS ({VIEWS[name]})" for name in needed_views(sql)
    ]
    if not parts:
        return sql.strip()
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body
