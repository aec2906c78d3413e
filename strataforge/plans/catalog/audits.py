"""Queries for payload contracts, audits, gates, reconciliation and expectations."""


from pyspark.sql import DataFrame, functions as F, types as T

from strataforge.operators import audit, cdc, marts, quality
from strataforge.operators.expectations import MODES, Expectation, apply_policies, validate
from strataforge.operators.schema import Contract, stamp, with_extra_fields
from strataforge.plans import flows
from strataforge.plans.catalog.common import AS_OF, FEED_KEY, feed_steps, merged_state
from strataforge.plans.catalog.mart import FACT, MART, SUMMARY, ratio_sql
from strataforge.plans.catalog.state import FEED_RULES
from strataforge.plans.registry import query

EVENT_CONTRACT = Contract(
    dataset="events",
    schema_version="1.0",
    source=T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("updated_at", T.TimestampType()),
        ]
    ),
    canonical={"event_id": "record_id", "event_type": "kind"},
    key=("user_id", "event_type"),
    record_id="event_id",
    updated_at="updated_at",
    system="shop",
)


def event_records(t) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("updated_at"))


VIOLATIONS = """WITH r AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 89 = 0 THEN 'other' ELSE 'events' END AS dataset,
    CASE WHEN event_id % 83 = 0 THEN 'twelve' ELSE CAST(user_id AS VARCHAR) END AS user_id,
    CASE WHEN event_id % 79 = 0 THEN '2024/25' ELSE '2024-2025' END AS academic_year,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 73 = 0 THEN '' ELSE '+00:00' END AS updated_at FROM events),
v AS (
  SELECT event_id, 'event_type' AS location, 'required' AS message FROM r WHERE event_type IS NULL
  UNION ALL SELECT event_id, 'dataset', 'constant' FROM r WHERE dataset <> 'events'
  UNION ALL SELECT event_id, 'user_id', 'type' FROM r WHERE TRY_CAST(user_id AS BIGINT) IS NULL
  UNION ALL SELECT event_id, 'academic_year', 'pattern' FROM r WHERE NOT regexp_matches(academic_year, '^[0-9]{4}-[0-9]{4}$')
  UNION ALL SELECT event_id, 'updated_at', 'timestamp' FROM r WHERE NOT regexp_matches(updated_at, '(Z|[+-][0-9]{2}:[0-9]{2})$'))
"""


@query("Q6_validate_payload_contract", VIOLATIONS + "SELECT * FROM v")
def q6(t):
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    key = F.col("event_id")
    raw = t.events.select(
        "event_id",
        F.when(key % 97 != 0, F.col("event_type")).alias("event_type"),
        F.when(key % 89 == 0, "other").otherwise("events").alias("dataset"),
        F.when(key % 83 == 0, "twelve").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(key % 79 == 0, "2024/25").otherwise("2024-2025").alias("academic_year"),
        F.concat(at, F.when(key % 73 == 0, "").otherwise("+00:00")).alias("updated_at"),
    )
    return quality.contract_violations(
        raw,
        "event_id",
        required=["event_type"],
        constants={"dataset": "events"},
        types={"user_id": "bigint"},
        patterns={"academic_year": "^[0-9]{4}-[0-9]{4}$"},
        offset_timestamps=["updated_at"],
        limit=None,
    )


@query(
    "Q7_audit_bronze",
    """SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS missing_columns, CAST(0 AS BIGINT) AS other_dataset,
         count(*) FILTER (event_id % 50 = 0) AS other_batch, count(*) FILTER (event_id % 41 = 0) AS null_checksums,
         false AS passed FROM events""",
)
def q7(t):
    landed = stamp(event_records(t), EVENT_CONTRACT, "b1", AS_OF)
    damaged = landed.withColumns(
        {
            "_batch_id": F.expr("CASE WHEN event_id % 50 = 0 THEN 'b2' ELSE _batch_id END"),
            "_record_checksum": F.expr("CASE WHEN event_id % 41 = 0 THEN NULL ELSE _record_checksum END"),
        }
    )
    return audit.audit_bronze(damaged, "events", "b1")


@query(
    "Q8_audit_silver",
    f"""WITH {feed_steps('v_feed', 'v_target')}, k AS (SELECT count(*) AS n FROM v_target GROUP BY user_id, event_type)
      SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicate_keys,
        (SELECT count(*) FROM classes WHERE row_class = 'quarantine') AS quarantine_rows, true AS passed FROM k""",
)
def q8(t):
    classes = cdc.classify(cdc.resolve_batch(t.v_feed, FEED_KEY), t.v_target, FEED_KEY)
    return audit.audit_silver(t.v_target, classes.filter("row_class = 'quarantine'"), FEED_KEY)


@query(
    "Q9_gate_silver_kpi",
    """WITH d AS (SELECT CASE WHEN sort_key % 10 = 4 THEN 'UNKNOWN_KY' ELSE period END AS period, indicator,
         CASE WHEN value_num % 17 = 0 THEN NULL ELSE result END AS result FROM v_kpi)
       SELECT 'empty' AS check_name, CAST(0 AS BIGINT) AS failures
       UNION ALL SELECT 'null_required', count(*) FROM d WHERE indicator IS NULL OR result IS NULL
       UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT 1 FROM d GROUP BY indicator, period HAVING count(*) > 1)
       UNION ALL SELECT 'unknown_period', count(*) FROM d WHERE period = 'UNKNOWN_KY'""",
)
def q9(t):
    kpi = t.v_kpi.withColumns(
        {
            "result": F.expr("CASE WHEN value_num % 17 = 0 THEN NULL ELSE result END"),
            "period": F.expr("CASE WHEN sort_key % 10 = 4 THEN 'UNKNOWN_KY' ELSE period END"),
        }
    )
    return audit.gate_silver(kpi, ["indicator", "period"], ["indicator", "result"], "period", "UNKNOWN_KY")


@query(
    "Q10_gate_gold_kpi",
    f"""WITH {SUMMARY}, s AS (SELECT completion_pct + CASE WHEN unit = 'S1' THEN 60 ELSE 0 END AS p FROM summary)
      SELECT 'summary_empty' AS check_name, CAST(0 AS BIGINT) AS failures
      UNION ALL SELECT 'ratio_out_of_range', count(*) FROM s WHERE p < 0 OR p > 100
      UNION ALL SELECT 'detail_empty', CAST(0 AS BIGINT)""",
)
def q10(t):
    summary = marts.kpi_summary(t.v_kpi).withColumn(
        "completion_pct", F.expr("completion_pct + CASE WHEN unit = 'S1' THEN 60 ELSE 0 END")
    )
    return audit.gate_gold(summary, t.v_kpi, "completion_pct")


@query(
    "Q11_gate_branch",
    f"""WITH valid AS (SELECT * FROM v_feed WHERE NOT coalesce(cents < 0 OR cents > 15000 OR user_id IS NULL, false)),
      {feed_steps('valid', 'v_target')}, merged AS ({merged_state('classes', 'v_target')})
      SELECT 'duplicate_keys' AS check_name, count(*) AS failures FROM (SELECT 1 FROM merged GROUP BY user_id, event_type HAVING count(*) > 1)
      UNION ALL SELECT 'invalid_rows', count(*) FROM merged WHERE cents < 0 OR cents > 15000 OR user_id IS NULL
      UNION ALL SELECT 'quarantine_delta', CAST(0 AS BIGINT)""",
)
def q11(t):
    result = flows.silver_batch(t.v_feed, t.v_target, FEED_KEY, FEED_RULES, at=AS_OF)
    written = result.quarantine.select("record_id")
    before = t.v_feed.filter("record_id % 100 = 0").select("record_id")
    return audit.gate_candidate(
        result.candidate, FEED_KEY, FEED_RULES, before, before.unionByName(written), written
    )


LINE_CHECKS = (
    ("quantity_positive", "l_quantity <= 0"),
    ("quantity_at_most_45", "l_quantity > 45"),
    ("tax_present", "l_tax IS NULL"),
    ("flag_known", "l_returnflag NOT IN ('A', 'N')"),
)


@query(
    "Q12_batched_row_checks",
    """SELECT 'quantity_at_most_45' AS check_name, count(*) AS failure_count FROM lineitem WHERE l_quantity > 45
       UNION ALL SELECT 'flag_known', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""",
)
def q12(t):
    return audit.row_checks(t.lineitem, LINE_CHECKS, "lines_nonempty")


PROPS_CONTRACT = Contract(
    dataset="props",
    schema_version="1.0",
    source=T.StructType([T.StructField("k", T.StringType())]),
    canonical={},
    key=("k",),
    record_id="k",
    updated_at="k",
)


def event_payloads(t) -> DataFrame:
    """Events as JSON text with one declared and two undeclared fields."""
    record = F.to_json(
        F.struct(
            F.get_json_object("props", "$.k").try_cast("int").alias("k"),
            F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("z_user"),
            F.col("event_type").alias("a_kind"),
        )
    )
    return t.events.select("event_id", record.alias("payload"))


PAYLOAD_SHAPE = [("event_id", "bigint"), ("k", "int"), ("a_kind", "string"), ("user", "bigint"), ("rows", "bigint")]


@query(
    "Q13_assert_schema",
    """WITH found AS (SELECT 'z_user' AS name FROM events WHERE event_id % 3 = 0 AND user_id IS NOT NULL LIMIT 1)
       SELECT 2 AS ordinal, 'k' AS expected_name, 'int' AS expected_type, 'k' AS actual_name, 'string' AS actual_type FROM found
       UNION ALL SELECT 4, 'user', 'bigint', name, 'bigint' FROM found
       UNION ALL SELECT 5, 'rows', 'bigint', NULL, NULL FROM found""",
)
def q13(t):
    # the actual schema is the one found in the records themselves
    return audit.assert_schema(with_extra_fields(event_payloads(t), "payload", PROPS_CONTRACT), PAYLOAD_SHAPE)


@query(
    "Q14_check_grain",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def q14(t):
    return audit.check_grain(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "Q15_reconcile_counts",
    """SELECT (SELECT count(*) FROM v_outcomes WHERE NOT is_deleted) AS source_rows,
         (SELECT count(*) FROM v_outcomes WHERE NOT is_deleted) AS result_rows, true AS passed""",
)
def q15(t):
    outcomes = t.v_outcomes
    return audit.reconcile_counts(marts.filter_active(outcomes), marts.outcome_fact(outcomes))


@query(
    "Q16_lineage_diff",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN '<missing>' ELSE concat_ws('|',
           CASE WHEN o_orderkey % 37 = 0 THEN 'o_orderstatus' END,
           CASE WHEN o_orderkey % 53 = 0 AND o_orderpriority IS NOT NULL THEN 'o_orderpriority' END) END AS differing
       FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 37 = 0 OR o_orderkey % 53 = 0""",
)
def q16(t):
    silver = t.orders.filter("o_orderkey % 101 <> 0")
    gold = t.orders.withColumns(
        {
            "o_orderstatus": F.expr("CASE WHEN o_orderkey % 37 = 0 THEN 'X' ELSE o_orderstatus END"),
            "o_orderpriority": F.expr("CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderpriority END"),
        }
    )
    return audit.lineage_diff(gold, silver, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])


def _damaged_fact(t):
    return marts.outcome_fact(t.v_outcomes).withColumns(
        {
            "previous_semester": F.expr("CASE WHEN attempted % 5 = 0 THEN 9 ELSE previous_semester END"),
            "change_gpa_mean": F.expr("CASE WHEN passed % 7 = 0 THEN change_gpa_mean + 1 ELSE change_gpa_mean END"),
        }
    )


@query(
    "Q17_recompute_periods",
    f"""WITH {FACT} SELECT record_id FROM fact WHERE attempted % 5 = 0
        OR (passed % 7 = 0 AND change_gpa_mean IS NOT NULL)""",
)
def q17(t):
    names = [r[0] for r in marts.OUTCOME_RATIOS]
    values = {"previous_year": "academic_year", "previous_semester": "semester", **{f"previous_{n}": n for n in names}}
    differences = {f"change_{n}": (n, f"previous_{n}") for n in names}
    found = audit.check_periods(_damaged_fact(t), ["program"], ["start_year", "semester"], values, differences)
    return found.select("record_id")


@query(
    "Q18_reconcile_aggregates",
    f"""WITH {FACT}, {MART} SELECT academic_year, semester, CASE WHEN semester = 2 AND academic_year > '1999' THEN '<missing>'
        ELSE concat_ws('|', CASE WHEN semester = 1 AND academic_year < '1995' THEN 'passed' END,
                            CASE WHEN academic_year BETWEEN '1996' AND '1998' THEN 'gpa_mean' END) END AS differing
      FROM mart WHERE (semester = 2 AND academic_year > '1999') OR (semester = 1 AND academic_year < '1995')
         OR academic_year BETWEEN '1996' AND '1998'""",
)
def q18(t):
    fact = marts.outcome_fact(t.v_outcomes)
    expected = marts.period_mart(fact)
    stored = expected.filter("NOT (semester = 2 AND academic_year > '1999')").withColumns(
        {
            "passed": F.expr("CASE WHEN semester = 1 AND academic_year < '1995' THEN passed + 1 ELSE passed END"),
            "gpa_mean": F.expr(
                "CASE WHEN academic_year BETWEEN '1996' AND '1998' THEN gpa_mean * (1 + 1e-6) ELSE gpa_mean * (1 + 1e-13) END"
            ),
        }
    )
    exact = ["programs", "passed", "attempted", "gpa_students", "on_track", "evaluated"]
    approx = ["gpa_points", "pass_rate", "gpa_mean", "on_track_rate"]
    return audit.reconcile_aggs(stored, expected, ["academic_year", "semester"], exact, approx)


@query(
    "Q19_range_and_formula_checks",
    f"""WITH f AS (SELECT *, CASE WHEN attempted % 11 = 0 THEN 'nan'::DOUBLE WHEN attempted % 13 = 0 THEN 100.5 ELSE
          {ratio_sql('passed', 'attempted')} END AS pass_rate FROM v_outcomes)
      SELECT 'progress_range' AS check_name, count(*) AS failure_count FROM v_sections
        WHERE progress_pct IS NULL OR progress_pct < 0 OR progress_pct > 100
      UNION ALL SELECT 'pass_rate_range', count(*) FROM f WHERE isnan(pass_rate) OR pass_rate > 100 OR pass_rate < 0
      UNION ALL SELECT 'pass_rate_formula', count(*) FROM f WHERE pass_rate IS DISTINCT FROM ({ratio_sql('passed', 'attempted')})""",
)
def q19(t):
    sections = marts.section_fact(t.v_sections, ["section_code", "progress_pct"], {})
    first = audit.row_checks(
        sections,
        [
            ("progress_range", audit.outside("progress_pct", required=True)),
            ("monitor_count", "monitored IS NULL OR monitored <> 1"),
        ],
    )
    rates = marts.with_ratios(t.v_outcomes, marts.OUTCOME_RATIOS[:1]).withColumn(
        "pass_rate",
        F.expr("CASE WHEN attempted % 11 = 0 THEN double('NaN') WHEN attempted % 13 = 0 THEN 100.5D ELSE pass_rate END"),
    )
    second = audit.row_checks(
        rates,
        [
            ("pass_rate_range", audit.outside("pass_rate")),
            ("pass_rate_formula", audit.ratio_differs("pass_rate", "passed", "attempted")),
        ],
    )
    return first.unionByName(second)


@query(
    "Q20_table_parity",
    """SELECT p_partkey, CASE WHEN p_partkey % 90 = 1 THEN '<missing>' WHEN p_partkey % 90 = 2 THEN '<extra>'
         ELSE concat_ws('|', CASE WHEN p_partkey % 60 = 3 THEN 'p_brand' END, CASE WHEN p_partkey % 70 = 4 THEN 'p_retailprice' END) END AS differing
       FROM part WHERE p_partkey % 90 IN (1, 2) OR p_partkey % 60 = 3 OR p_partkey % 70 = 4
       UNION ALL SELECT NULL, '<schema 4>'""",
)
def q20(t):
    a = t.part.filter("p_partkey % 90 <> 1").withColumns(
        {
            "p_brand": F.expr("CASE WHEN p_partkey % 60 = 3 THEN 'other' ELSE p_brand END"),
            "p_retailprice": F.expr("CASE WHEN p_partkey % 70 = 4 THEN p_retailprice + 0.01 ELSE p_retailprice * (1 + 1e-15) END"),
            "p_size": F.col("p_size").cast("bigint"),
            "p_type": F.lit("left out"),
        }
    )
    return audit.parity(a, t.part.filter("p_partkey % 90 <> 2"), ["p_partkey"], exclude=["p_type"])


SUITE = (
    Expectation("not_null", "l_orderkey"),
    Expectation("between", "l_quantity", low=1, high=45),
    Expectation("between", "l_discount", severity="warning", low=0, high=0.05),
    Expectation("in_set", "l_returnflag", severity="warning", values=("A", "N")),
    Expectation("matches", "l_linestatus", pattern="^[OF]$"),
    Expectation("unique", "l_orderkey", severity="warning"),
    Expectation("row_count_between", low=1),
)
SUITE_SQL = """res AS (
  SELECT 1 AS ordinal, 'not_null' AS expectation, 'l_orderkey' AS column_name, 'critical' AS severity, count(*) AS observed FROM lineitem WHERE l_orderkey IS NULL
  UNION ALL SELECT 2, 'between', 'l_quantity', 'critical', count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45
  UNION ALL SELECT 3, 'between', 'l_discount', 'warning', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05::DOUBLE
  UNION ALL SELECT 4, 'in_set', 'l_returnflag', 'warning', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
  UNION ALL SELECT 5, 'matches', 'l_linestatus', 'critical', count(*) FROM lineitem WHERE NOT regexp_matches(l_linestatus, '^[OF]$')
  UNION ALL SELECT 6, 'unique', 'l_orderkey', 'warning', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
  UNION ALL SELECT 7, 'row_count_between', NULL, 'critical', CAST(0 AS BIGINT))"""


@query("Q21_expectations", f"WITH {SUITE_SQL} SELECT *, observed = 0 AS success FROM res")
def q21(t):
    return validate(t.lineitem, SUITE)


@query(
    "Q22_validation_policy",
    f"""WITH {SUITE_SQL}, s AS (SELECT count(*) AS evaluated, count(*) FILTER (observed = 0) AS successful,
        count(*) FILTER (observed > 0 AND severity = 'critical') AS critical_failures,
        count(*) FILTER (observed > 0 AND severity <> 'critical') AS warning_failures FROM res)
      SELECT s.*, mode, CASE WHEN mode = 'off' THEN 'PASSED'
          WHEN mode = 'report' THEN CASE WHEN critical_failures + warning_failures > 0 THEN 'WARNING' ELSE 'PASSED' END
          WHEN critical_failures > 0 THEN 'FAILED' WHEN warning_failures > 0 THEN 'WARNING' ELSE 'PASSED' END AS status,
        NOT (mode = 'enforce' AND critical_failures > 0) AS merge_allowed
      FROM s, (VALUES ('off'), ('report'), ('enforce')) AS m(mode)""",
)
def q22(t):
    return apply_policies(validate(t.lineitem, SUITE), MODES)


COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(
    "S17_load_and_count",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in COUNTED),
)
def s17(t):
    return audit.table_counts([(n, getattr(t, n)) for n in COUNTED])


@query(
    "P20_layer_status",
    """SELECT 'bronze' AS layer, EXISTS (SELECT 1 FROM events) AS has_rows
       UNION ALL SELECT 'silver', EXISTS (SELECT 1 FROM v_target) UNION ALL SELECT 'gold', EXISTS (SELECT 1 FROM orders WHERE o_orderkey < 0)""",
)
def p20(t):
    return audit.layer_status([("bronze", t.events), ("silver", t.v_target), ("gold", t.orders.filter("o_orderkey < 0"))])


