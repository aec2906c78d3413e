"""Queries that run whole flows, from source records or documents to published marts."""

from pyspark.sql import DataFrame, functions as F

from strataforge.operators import audit, star
from strataforge.plans import contexts, datasets
from strataforge.plans.catalog.common import AS_OF
from strataforge.plans.catalog.files import order_documents
from strataforge.plans.catalog.mart import FACT, MART, SUMMARY
from strataforge.plans.registry import half_up, query
from strataforge.session import scratch, staged
from strataforge.sources import files
from strataforge.sources.ledger import Ledger

# source records of the outcomes; some break a rule
OUTCOME_RECORDS = """SELECT record_id, program AS program_code, upper(program) AS program_name, academic_year, CAST(semester AS INT) AS semester,
  CASE WHEN attempted % 17 = 0 THEN 0 ELSE attempted END AS student_count, CAST(passed AS BIGINT) AS passed_course_count,
  attempted AS attempted_course_count, gpa_points AS gpa_point_sum, CAST(gpa_students AS BIGINT) AS gpa_student_count,
  CAST(0 AS BIGINT) AS warning_student_count, CAST(0 AS BIGINT) AS dropout_risk_student_count, CAST(on_track AS BIGINT) AS on_track_student_count,
  CASE WHEN attempted % 19 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(attempted AS BIGINT) END AS progress_evaluated_student_count,
  updated_at, is_deleted FROM v_outcomes"""

VALID_OUTCOMES = """valid_outcomes AS (
  SELECT * REPLACE (CASE WHEN attempted % 19 = 0 THEN NULL ELSE attempted END AS evaluated) FROM v_outcomes
  WHERE attempted % 19 <> 0 AND attempted % 17 <> 0)"""


@query(
    "E1_registered_outcomes",
    f"WITH {VALID_OUTCOMES}, {FACT.replace('FROM v_outcomes WHERE', 'FROM valid_outcomes WHERE')}, {MART} SELECT * FROM mart",
)
def e1(t):
    """Two runs land and merge the records; fact and period mart are audited and published together."""
    ledger = Ledger(t.spark, scratch(t.spark, "outcomes"))
    records = t.sql(OUTCOME_RECORDS).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    for end in ("2000-06-01", "2100-01-01"):
        part = records.filter(F.col("updated_at") < F.lit(end).cast("timestamp"))
        datasets.ingest(part, datasets.LEARNING_OUTCOMES, ledger, AS_OF, buckets=8)
    datasets.publish_outcomes(ledger)
    return ledger.live("outcome_periods")


@query(
    "E1_registered_sections",
    """SELECT unit_code, section_code, semester, progress_pct, CAST(1 AS BIGINT) AS monitored FROM v_sections
       WHERE trim(unit_code) <> '' AND semester > 0 AND progress_pct BETWEEN 0 AND 100""",
)
def e1_sections(t):
    ledger = Ledger(t.spark, scratch(t.spark, "sections"))
    records = t.v_sections.select(
        F.col("section_code").alias("record_id"),
        "unit_code",
        F.upper("unit_code").alias("unit_name"),
        F.col("section_code").alias("course_section_code"),
        "academic_year",
        "semester",
        F.col("progress_pct").alias("progress_percent"),
        F.lit("2024-02-01").cast("timestamp").alias("updated_at"),
    )
    datasets.ingest(records, datasets.TEACHING_PROGRESS, ledger, AS_OF, buckets=8)
    datasets.publish_sections(ledger)
    return ledger.live("section_fact").select("unit_code", "section_code", "semester", "progress_pct", "monitored")


DOCUMENT_KPI = """v AS (
  SELECT 'Q-MT' || o_orderkey AS indicator, 'Q' AS unit,
    CASE WHEN (o_orderkey // 20) % 3 = 0 THEN 'NĂM 2023' ELSE 'Q' || ((o_orderkey // 20) % 4 + 1) || '/2024' END AS period,
    CAST(NULL AS DOUBLE) AS value_num, 'PASSED' AS result FROM orders)"""


@query(
    "E4_kpi_documents",
    f"""WITH {DOCUMENT_KPI}, {SUMMARY.replace('FROM v_kpi', 'FROM v')},
      n AS (SELECT 'kpi_detail' AS table_name, count(*) AS rows FROM v UNION ALL SELECT 'kpi_comparison', count(*) FROM v
        UNION ALL SELECT 'kpi_dictionary', count(*) FROM v UNION ALL SELECT 'kpi_forecast', count(*) FROM v
        UNION ALL SELECT 'kpi_summary', count(*) FROM summary)
      SELECT table_name, rows, (SELECT {half_up('sum(completion_pct)', 2)} FROM summary) AS completion FROM n""",
)
def e4(t):
    """Documents are parsed and merged, and all marts go live together."""
    ledger = Ledger(t.spark, scratch(t.spark, "kpi"))
    datasets.ingest_documents(order_documents(t), ledger, buckets=8)
    datasets.publish_kpi(ledger, {"Q": "Unit Q"})
    names = ["kpi_summary", "kpi_detail", "kpi_comparison", "kpi_dictionary", "kpi_forecast"]
    counts: DataFrame = audit.table_counts([(n, ledger.live(n)) for n in names])
    total = ledger.live("kpi_summary").agg(F.round(F.sum("completion_pct"), 2).alias("completion"))
    return counts.withColumn("completion", total.scalar())


CONTEXT_LINES = """context_lines AS (SELECT * FROM (SELECT DISTINCT * FROM v_context_lines)
  QUALIFY row_number() OVER (PARTITION BY order_id, return_flag ORDER BY quantity DESC, amount DESC) = 1)"""


def _land(df: DataFrame, root: str, entity: str, name: str) -> None:
    """Files of one entity below ``staging/sales``, in the format their folder is named after."""
    df.write.option("header", True).format(name.rsplit(".", 1)[1]).save(f"{root}/staging/sales/{entity}/{name}")


def _manifest(t, root: str, name: str) -> DataFrame:
    """The files whose folder begins with ``name``, by paths below the root."""
    listed = files.list_files(t.spark, f"{root}/staging")
    below = F.concat(F.lit("staging/"), F.substring_index("path", "/staging/", -1))
    return files.context_manifest(listed.withColumn("path", below)).filter(F.col("path").contains(f"/{name}."))


def context_lines(t) -> DataFrame:
    """One line per order and flag, written once, as both runs land some of them."""
    one = star.dedup_latest(t.v_context_lines.distinct(), ["order_id", "return_flag"], ["quantity", "amount"])
    return staged(one.withColumn("line_id", F.concat_ws("-", "order_id", "return_flag")), "context-lines")


def sales_context(t) -> contexts.ContextRun:
    """Two runs over three entities in three formats.

    The first brings two thirds of the orders, some with an amount that is corrected later.  The second brings the rest, the
    corrections, orders without key, lines of the new orders and some again, and a new column of every other customer.
    """
    root = scratch(t.spark, "context")
    lines, orders, customers = context_lines(t), t.v_context_orders, t.v_context_customers
    late, wrong = F.col("order_id") % 3 == 0, F.col("order_id") % 5 == 1
    tie_break = {"orders": ["total_amount"], "customers": ["customer_name"], "lines": ["amount"]}

    early = orders.filter(~late).withColumn("total_amount", F.col("total_amount") + F.when(wrong, 1).otherwise(0))
    _land(early, root, "orders", "first.json")
    _land(customers, root, "customers", "first.csv")
    _land(lines.filter(~late), root, "lines", "first.parquet")
    contexts.process_context(t.spark, _manifest(t, root, "first"), "sales", f"{root}/out", "r1", f"{root}/", tie_break)

    keyless = orders.filter("order_id % 7 = 2").withColumn("order_id", F.lit(None).cast("bigint"))
    tier = F.concat(F.lit("T"), (F.col("customer_id") % 3).cast("string"))
    _land(orders.filter(late | wrong).unionByName(keyless), root, "orders", "second.json")
    _land(customers.filter("customer_id % 2 = 0").withColumn("tier", tier), root, "customers", "second.parquet")
    _land(lines.filter(late | wrong), root, "lines", "second.json")
    return contexts.process_context(t.spark, _manifest(t, root, "second"), "sales", f"{root}/out", "r2", f"{root}/", tie_break)


@query(
    "E3_relational_context",
    f"""WITH {CONTEXT_LINES}, f AS (SELECT order_id, count(*) AS lines__record_count, CAST(sum(quantity) AS BIGINT) AS lines__sum__quantity,
        CAST(sum(amount) AS BIGINT) AS lines__sum__amount FROM context_lines GROUP BY order_id)
      SELECT o.order_id, o.customer_id, o.status, o.total_amount, c.customer_name AS customers__customer_name, c.segment AS customers__segment,
        CASE WHEN c.customer_id % 2 = 0 THEN 'T' || CAST(c.customer_id % 3 AS VARCHAR) END AS customers__tier, f.* EXCLUDE (order_id), 'sales' AS _context_id
      FROM v_context_orders o LEFT JOIN f ON o.order_id = f.order_id LEFT JOIN v_context_customers c ON o.customer_id = c.customer_id""",
)
def e3(t):
    return sales_context(t).mart.drop("lines__avg__quantity", "lines__avg__amount")


@query(
    "E3_context_contract",
    f"""WITH {CONTEXT_LINES}
      SELECT 2 AS sequence, 'r2' AS run, 'orders' AS entity, 'anchor' AS role, 'order_id' AS key, 'order_id' AS join_columns,
        (SELECT count(*) FROM v_context_orders) AS rows, (SELECT count(*) FROM v_context_orders WHERE order_id % 7 = 2) AS refused
      UNION ALL SELECT 2, 'r2', 'customers', 'dimension', 'customer_id', 'customer_id', (SELECT count(*) FROM v_context_customers), 0
      UNION ALL SELECT 2, 'r2', 'lines', 'fact', 'line_id', 'order_id', (SELECT count(*) FROM context_lines), 0
      UNION ALL SELECT 2, 'r2', 'mart', 'mart', 'order_id', '', (SELECT count(*) FROM v_context_orders), 0""",
)
def e3_contract(t):
    """The contract of the second run: roles, keys, join columns, and rows kept and refused."""
    rows = t.spark.createDataFrame(list(sales_context(t).contract), contexts.CONTRACT)
    return rows.select("sequence", "run", "entity", "role", F.concat_ws("|", "key").alias("key"), F.concat_ws("|", "join_columns").alias("join_columns"), "rows", "refused")
