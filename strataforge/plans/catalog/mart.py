"""Queries for marts, periods, forecast, scoring and charts."""

from pyspark.sql import functions as F

from strataforge.functions import text
from strataforge.functions.frames import attach, side_by_side
from strataforge.functions.windows import percent_rank_global
from strataforge.operators import charts, marts
from strataforge.plans.catalog.common import shown
from strataforge.plans.registry import half_up, query

SUMMARY = f"""summary AS (
  SELECT period, unit, count(*) AS total_records, count(*) FILTER (result = 'PASSED') AS passed,
    count(*) FILTER (result = 'FAILED') AS failed,
    {half_up("sum(coalesce(CAST(value_num AS DOUBLE), 0.0))", 2)} AS value_sum,
    {half_up("avg(coalesce(CAST(value_num AS DOUBLE), 0.0))", 2)} AS value_avg,
    {half_up("count(*) FILTER (result = 'PASSED') / count(*) * 100", 2)} AS completion_pct
  FROM v_kpi WHERE result <> 'NOT_DUE' GROUP BY period, unit)"""

COMPARED = f"""compared AS (
  SELECT *, CASE WHEN previous_value <> 0 THEN {half_up("(value_num - previous_value) / previous_value * 100", 2)} END AS growth_pct
  FROM (SELECT *, lag(period) OVER w AS previous_period, lag(value_num) OVER w AS previous_value
        FROM v_kpi WINDOW w AS (PARTITION BY indicator ORDER BY sort_key)))"""


def ratio_sql(part, whole, scale="100.0::DOUBLE"):
    top = f"CAST({part} AS DOUBLE)" + (f" * {scale}" if scale else "")
    return f"CASE WHEN {whole} > 0 THEN {top} / CAST({whole} AS DOUBLE) END"


RATIOS = f"""{ratio_sql('passed', 'attempted')} AS pass_rate, {ratio_sql('gpa_points', 'gpa_students', None)} AS gpa_mean,
  {ratio_sql('on_track', 'evaluated')} AS on_track_rate"""

FACT = f"""fact AS (
  SELECT *, pass_rate - previous_pass_rate AS change_pass_rate, gpa_mean - previous_gpa_mean AS change_gpa_mean,
    on_track_rate - previous_on_track_rate AS change_on_track_rate
  FROM (SELECT *, lag(academic_year) OVER w AS previous_year, lag(semester) OVER w AS previous_semester,
          lag(pass_rate) OVER w AS previous_pass_rate, lag(gpa_mean) OVER w AS previous_gpa_mean,
          lag(on_track_rate) OVER w AS previous_on_track_rate
        FROM (SELECT *, CAST(left(academic_year, 4) AS INTEGER) AS start_year, {RATIOS}
              FROM v_outcomes WHERE NOT is_deleted)
        WINDOW w AS (PARTITION BY program ORDER BY start_year, semester)))"""

MART = f"""mart AS (
  SELECT academic_year, semester, programs, passed, attempted, gpa_points, gpa_students, on_track, evaluated, {RATIOS}
  FROM (SELECT academic_year, semester, count(DISTINCT program) AS programs, CAST(sum(passed) AS BIGINT) AS passed,
          CAST(sum(attempted) AS BIGINT) AS attempted, sum(gpa_points) AS gpa_points,
          CAST(sum(gpa_students) AS BIGINT) AS gpa_students, CAST(sum(on_track) AS BIGINT) AS on_track,
          CAST(sum(evaluated) AS BIGINT) AS evaluated
        FROM fact GROUP BY academic_year, semester))"""

FACT_COLUMNS = """record_id program academic_year start_year semester students pass_rate gpa_mean on_track_rate
previous_year previous_semester previous_pass_rate previous_gpa_mean previous_on_track_rate
change_pass_rate change_gpa_mean change_on_track_rate checksum""".split()


def advice_sql(level, texts):
    return (
        f"CASE {level} WHEN 'CRITICAL' THEN '{texts[2]}' WHEN 'AT_RISK' THEN '{texts[1]}' ELSE '{texts[0]}' END"
    )


def scoring_sql(source, healthy, at_risk, texts):
    """SQL of the shared score columns; ``source`` has p_rank and target_achievement_pct."""
    base = "CASE health_status WHEN 'CRITICAL' THEN 0.70::DOUBLE + 0.30::DOUBLE * p_rank WHEN 'AT_RISK' THEN 0.40::DOUBLE + 0.25::DOUBLE * p_rank ELSE 0.05::DOUBLE + 0.15::DOUBLE * p_rank END"
    return f"""SELECT * EXCLUDE (p_rank),
      CASE health_status WHEN 'CRITICAL' THEN 'HIGH' WHEN 'AT_RISK' THEN 'MEDIUM' ELSE 'LOW' END AS action_priority,
      {half_up(base, 2)} AS risk_score, health_status <> 'HEALTHY' AS alert_flag,
      {advice_sql('health_status', texts)} AS recommended_action
    FROM (SELECT *, CASE WHEN target_achievement_pct >= {healthy} THEN 'HEALTHY'
            WHEN target_achievement_pct >= {at_risk} THEN 'AT_RISK' ELSE 'CRITICAL' END AS health_status FROM {source})"""


@query("A1_kpi_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def a1(t):
    return marts.kpi_summary(t.v_kpi)


@query(
    "D4_kpi_decision_fields",
    f"""WITH {SUMMARY}, ranked AS (
      SELECT *, 100.0::DOUBLE AS target_value, completion_pct AS target_achievement_pct,
        {half_up("completion_pct - 100.0::DOUBLE", 2)} AS target_variance_amount, CAST(0 AS INTEGER) AS aging_days,
        percent_rank() OVER (ORDER BY completion_pct DESC) AS p_rank FROM summary),
    tiered AS (SELECT *, CASE WHEN p_rank <= 0.20 OR completion_pct >= 90 THEN 'TIER_A'
        WHEN p_rank <= 0.50 OR completion_pct >= 75 THEN 'TIER_B' ELSE 'TIER_C' END AS performance_tier FROM ranked)
    {scoring_sql('tiered', 85, 60, marts.KPI_ADVICE)}""",
)
def d4(t):
    return marts.decision_fields_kpi(marts.kpi_summary(t.v_kpi))


UNIT_LABELS = {f"S{i}": f"Unit {i}" for i in range(5)}
UNIT_SQL = "CASE WHEN unit IN ('S0','S1','S2','S3','S4') THEN 'Unit ' || right(unit, 1) END"


@query(
    "D17_kpi_detail",
    f"SELECT indicator, unit, period, value_num, result, description, {UNIT_SQL} AS unit_label FROM v_kpi",
)
def d17(t):
    columns = ["indicator", "unit", "period", "value_num", "result", "description"]
    return marts.kpi_detail(t.v_kpi, columns, "unit", UNIT_LABELS)


@query(
    "W1_compare_periods",
    f"WITH {COMPARED} SELECT indicator, unit, period, value_num, previous_period, previous_value, growth_pct FROM compared",
)
def w1(t):
    compared = marts.compare_periods(t.v_kpi)
    return compared.select("indicator", "unit", "period", "value_num", "previous_period", "previous_value", "growth_pct")


@query(
    "W5_latest_per_group",
    "SELECT indicator, period, value_num FROM v_kpi QUALIFY sort_key = max(sort_key) OVER (PARTITION BY indicator)",
)
def w5(t):
    latest = marts.latest_per_group(t.v_kpi, "indicator", text.period_sort_key(F.col("period")))
    return latest.select("indicator", "period", "value_num")


@query(
    "A7_indicator_dictionary",
    """SELECT indicator, unit, arg_min(description, sort_key) AS description, arg_min(period, sort_key) AS first_period,
         arg_max(period, sort_key) AS latest_period FROM v_kpi GROUP BY indicator, unit""",
)
def a7(t):
    return marts.indicator_dictionary(t.v_kpi)


@query(
    "A8_weighted_growth_forecast",
    f"""WITH {COMPARED}, weighted AS (
      SELECT indicator, CAST(growth_pct AS DECIMAL(24,2)) AS g, row_number() OVER (PARTITION BY indicator ORDER BY sort_key) AS w
      FROM compared WHERE growth_pct IS NOT NULL),
    growth AS (SELECT indicator, CAST(sum(g * w) AS DOUBLE) / sum(w) AS avg_growth_pct FROM weighted GROUP BY indicator),
    latest AS (SELECT * FROM compared QUALIFY sort_key = max(sort_key) OVER (PARTITION BY indicator)),
    joined AS (SELECT l.*, coalesce(g.avg_growth_pct, 0) AS growth FROM latest l LEFT JOIN growth g USING (indicator))
    SELECT indicator, unit, period AS current_period, value_num AS current_value,
      CASE WHEN sort_key % 10 = 4 THEN 'Q1/' || (sort_key // 10 + 1) ELSE 'Q' || (sort_key % 10 + 1) || '/' || (sort_key // 10) END AS next_period,
      {half_up("value_num * (1 + growth / 100)", 2)} AS next_value, growth AS avg_growth_pct FROM joined""",
)
def a8(t):
    return marts.forecast(marts.compare_periods(t.v_kpi))


@query("W2_outcome_fact", f"WITH {FACT} SELECT {', '.join(FACT_COLUMNS)} FROM fact")
def w2(t):
    return marts.outcome_fact(t.v_outcomes).select(*FACT_COLUMNS)


@query(
    "J4_narrow_window_join_back",
    f"WITH {FACT} SELECT {', '.join(FACT_COLUMNS)} FROM fact",
)
def j4(t):
    return marts.outcome_fact(t.v_outcomes, join_back=True).select(*FACT_COLUMNS)


@query("A2_period_mart", f"WITH {FACT}, {MART} SELECT * FROM mart")
def a2(t):
    return marts.period_mart(marts.outcome_fact(t.v_outcomes))


def figures(t):
    """Attendance, grading and survey figures as separate 1:1 tables."""
    return [t.v_section_metrics.select("section_code", c) for c in ("attendance_pct", "grading_pct", "feedback")]


@query(
    "A3_unit_scorecard",
    f"""WITH s AS (
      SELECT unit_code, count(s.section_code) AS sections, {half_up("sum(CAST(progress_pct AS DECIMAL(9,4))) / count(progress_pct)", 1)} AS progress,
        {half_up("sum(CAST(attendance_pct AS DECIMAL(9,4))) / count(attendance_pct)", 1)} AS attendance,
        {half_up("sum(CAST(grading_pct AS DECIMAL(9,4))) / count(grading_pct)", 1)} AS grading,
        {half_up("sum(CAST(feedback AS DECIMAL(9,4))) / count(feedback)", 2)} AS feedback
      FROM v_sections s LEFT JOIN v_section_metrics m ON s.section_code = m.section_code GROUP BY unit_code),
    c AS (SELECT unit_code, count(*) AS changes FROM v_changes JOIN v_sections USING (section_code) GROUP BY unit_code)
    SELECT s.unit_code, sections, printf('%.1f', progress) || '%' AS progress_text, printf('%.1f', attendance) || '%' AS attendance_text,
      printf('%.1f', grading) || '%' AS grading_text, coalesce(changes, 0) AS changes, printf('%.2f', feedback) || '/5' AS feedback_text,
      CASE WHEN progress >= 98.5 AND feedback >= 4.60 THEN 'Xuất sắc' WHEN progress >= 97 THEN 'Tốt' WHEN progress >= 96 THEN 'Đạt'
        WHEN progress >= 93 THEN 'Cần theo dõi' ELSE 'Cần cải thiện' END AS rating
    FROM s LEFT JOIN c ON s.unit_code = c.unit_code""",
)
def a3(t):
    return marts.unit_scorecard(t.v_sections, figures(t), t.v_changes)


@query(
    "J5_multiway_left_join",
    """SELECT s.section_code, unit_code, progress_pct, attendance_pct, grading_pct, feedback, coalesce(n, 0) AS changes
       FROM v_sections s LEFT JOIN v_section_metrics m ON s.section_code = m.section_code
       LEFT JOIN (SELECT section_code, count(*) AS n FROM v_changes GROUP BY section_code) c ON s.section_code = c.section_code""",
)
def j5(t):
    changes = t.v_changes.groupBy("section_code").agg(F.count(F.lit(1)).alias("n"))
    joined = marts.left_join_all(t.v_sections, [*figures(t), changes], "section_code")
    columns = ["section_code", "unit_code", "progress_pct", "attendance_pct", "grading_pct", "feedback"]
    return joined.select(*columns, F.coalesce("n", F.lit(0)).alias("changes"))


@query(
    "D16_section_fact",
    """SELECT section_code, unit_code, academic_year, semester, progress_pct, CAST(1 AS BIGINT) AS monitored,
         section_code AS source_record_id, md5(section_code) AS source_record_checksum FROM v_sections""",
)
def d16(t):
    sections = t.v_sections.withColumn("checksum", F.md5("section_code"))
    passthrough = ["section_code", "unit_code", "academic_year", "semester", "progress_pct"]
    return marts.section_fact(
        sections, passthrough, {"source_record_id": "section_code", "source_record_checksum": "checksum"}
    )


@query("D1_period_sort_key", "SELECT indicator, period, sort_key FROM v_kpi")
def d1(t):
    return t.v_kpi.select("indicator", "period", text.period_sort_key(F.col("period")).alias("sort_key"))


@query(
    "D2_next_period",
    """SELECT indicator, period, CASE WHEN sort_key % 10 = 4 THEN 'Q1/' || (sort_key // 10 + 1)
         ELSE 'Q' || (sort_key % 10 + 1) || '/' || (sort_key // 10) END AS next_period FROM v_kpi""",
)
def d2(t):
    return t.v_kpi.select("indicator", "period", text.next_period(F.col("period")).alias("next_period"))


@query("D3_safe_ratio", f"SELECT record_id, {RATIOS} FROM v_outcomes")
def d3(t):
    names = [r[0] for r in marts.OUTCOME_RATIOS]
    return marts.with_ratios(t.v_outcomes).select("record_id", *names)


EPOCH = "epoch_ms(date_trunc('year', o_orderdate))"
GOLD_ORDERS = f"""gold AS (
  SELECT o_orderpriority, CASE WHEN ms > 100000000000 THEN ms / 1000 ELSE ms END AS seconds, count(*) AS total_records,
    CAST(sum(amount) AS DOUBLE) AS sum_amount, {half_up("avg(amount)", 2)} AS avg_amount
  FROM (SELECT *, {EPOCH} AS ms, CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders) GROUP BY ALL)"""


@query(
    "A4_generic_gold",
    f"""WITH {GOLD_ORDERS} SELECT * EXCLUDE (seconds),
      strftime(make_timestamp(CAST(seconds AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S.%f') AS changed FROM gold""",
)
def a4(t):
    orders = t.orders.withColumns(
        {
            "amount": F.expr("CAST(round(o_totalprice) AS BIGINT)"),
            "changed": F.unix_millis(F.date_trunc("year", F.col("o_orderdate").cast("timestamp"))),
        }
    )
    return shown(marts.generic_gold(orders, ["o_orderpriority"], ["amount"], ["o_orderkey"], "changed"))


BRAND_GOLD = f"""gold AS (
  SELECT p_brand, p_type, count(*) AS total_records, CAST(sum(p_size) AS DOUBLE) AS sum_p_size, {half_up("avg(p_size)", 2)} AS avg_p_size
  FROM part GROUP BY p_brand, p_type),
bench AS (SELECT round_even(avg(sum_p_size) * 1.15::DOUBLE, 2) AS target_value FROM gold),
ranked AS (SELECT gold.*, target_value, percent_rank() OVER (ORDER BY sum_p_size DESC) AS p_rank,
    {half_up("sum_p_size / target_value * 100.0::DOUBLE", 1)} AS target_achievement_pct,
    {half_up("sum_p_size - target_value", 2)} AS target_variance_amount, CAST(0 AS INTEGER) AS aging_days FROM gold, bench),
tiered AS (SELECT *, CASE WHEN p_rank <= 0.20 THEN 'TIER_A' WHEN p_rank <= 0.50 THEN 'TIER_B' ELSE 'TIER_C' END AS performance_tier FROM ranked),
scored AS ({scoring_sql('tiered', 90, 60, marts.GENERAL_ADVICE)})"""


def _brands(t):
    return marts.generic_gold(t.part, ["p_brand", "p_type"], ["p_size"])


def _scored_brands(t):
    return marts.decision_fields(_brands(t), marts.scored_column(["p_size"]), "part_stock")


@query("D5_generic_decision_fields", f"WITH {BRAND_GOLD} SELECT * FROM scored")
def d5(t):
    return _scored_brands(t)


@query(
    "D6_aging_days",
    """SELECT o_orderkey, CAST(greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01')) AS INTEGER) AS from_timestamp,
         CAST(greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01')) AS INTEGER) AS from_millis,
         CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01')) AS INTEGER) END AS from_text
       FROM orders""",
)
def d6(t):
    at = F.col("o_orderdate").cast("timestamp")
    rows = t.orders.select(
        "o_orderkey",
        at.alias("ts"),
        F.unix_millis(at).alias("ms"),
        F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise(F.date_format(at, "yyyy-MM-dd")).alias("txt"),
    )
    return rows.select(
        "o_orderkey",
        text.aging_days(F.col("ts"), "timestamp", "1998-06-01").alias("from_timestamp"),
        text.aging_days(F.col("ms"), "bigint", "1998-06-01").alias("from_millis"),
        text.aging_days(F.col("txt"), "string", "1998-06-01").alias("from_text"),
    )


@query(
    "W3_percent_rank_global",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, percent_rank() OVER (ORDER BY l_extendedprice DESC) AS p_rank FROM lineitem""",
)
def w3(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return percent_rank_global(lines, "l_extendedprice")


@query(
    "A9_chart_big_number",
    """SELECT max(amount) AS max_amount, min(amount) AS min_amount, CAST(sum(amount) AS BIGINT) AS sum_amount,
         avg(amount) AS avg_amount, count(amount) AS count_amount
       FROM (SELECT CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders)""",
)
def a9(t):
    orders = t.orders.select(F.expr("CAST(round(o_totalprice) AS BIGINT)").alias("amount"))
    parts = [
        charts.big_number(orders, "amount", name).withColumnRenamed("value", f"{name.lower()}_amount")
        for name in charts.AGGREGATES
    ]
    return side_by_side(*parts)


@query(
    "A10_chart_share",
    "SELECT c_mktsegment, count(c_custkey) AS value FROM customer GROUP BY ALL ORDER BY value DESC, c_mktsegment LIMIT 10",
)
def a10(t):
    return charts.share(t.customer, "c_mktsegment", "c_custkey")


@query(
    "A11_chart_bar_topn",
    """SELECT n_name, CAST(sum(amount) AS BIGINT) AS value
       FROM (SELECT o_custkey, CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders)
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       GROUP BY n_name ORDER BY value DESC, n_name LIMIT 10""",
)
def a11(t):
    orders = t.orders.select("o_custkey", F.expr("CAST(round(o_totalprice) AS BIGINT)").alias("amount"))
    revenue = orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return charts.top_n(revenue, "n_name", "amount", "SUM", 10)


@query(
    "A12_chart_trend",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS time, o_orderstatus,
         count(o_orderkey) AS value FROM orders GROUP BY ALL ORDER BY time, o_orderstatus LIMIT 1000""",
)
def a12(t):
    month = F.date_format("o_orderdate", "yyyy-MM")
    return charts.trend(t.orders, month, "o_orderkey", "COUNT", ["o_orderstatus"])


@query(
    "A13_chart_table",
    "SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_name, s_suppkey LIMIT 1000",
)
def a13(t):
    return charts.detail(t.supplier, ["s_suppkey", "s_name", "s_nationkey"], ["s_name", "s_suppkey"])


@query(
    "A14_semantic_metrics",
    f"""WITH {BRAND_GOLD} SELECT CAST(sum(total_records) AS BIGINT) AS record_count, sum(sum_p_size) AS total_p_size,
      {half_up("avg(avg_p_size)", 6)} AS avg_p_size, count(*) FILTER (health_status = 'CRITICAL') AS count_critical,
      {half_up("avg(target_achievement_pct)", 6)} AS avg_target_achievement, {half_up("avg(risk_score)", 6)} AS avg_risk_score
    FROM scored""",
)
def a14(t):
    metrics = charts.semantic_metrics(_scored_brands(t), ["p_size"])
    means = ["avg_p_size", "avg_target_achievement", "avg_risk_score"]
    return metrics.withColumns({m: F.round(m, 6) for m in means})


@query(
    "A15_summary_cards",
    f"""WITH {SUMMARY}, cards AS (SELECT count(*) AS units, {half_up("avg(completion_pct)", 1)} AS mean_completion,
        count(*) FILTER (completion_pct >= 90) AS excellent FROM summary)
      SELECT period, unit, completion_pct, units, mean_completion, excellent FROM summary, cards
      ORDER BY completion_pct DESC, period, unit""",
)
def a15(t):
    summary = marts.kpi_summary(t.v_kpi).select("period", "unit", "completion_pct")
    return charts.by_completion(attach(summary, charts.summary_cards(summary)), tie_break=["period", "unit"])


PERIOD_SQL = """CASE WHEN regexp_matches(upper(period_text), '(?:Q|QUÝ|QUY)\\s*([1-4])\\s*(?:/|-|NĂM|NAM)\\s*(\\d{4})')
    THEN 'Q' || regexp_extract(upper(period_text), '(?:Q|QUÝ|QUY)\\s*([1-4])\\s*(?:/|-|NĂM|NAM)\\s*(\\d{4})', 1) || '/'
      || regexp_extract(upper(period_text), '(?:Q|QUÝ|QUY)\\s*([1-4])\\s*(?:/|-|NĂM|NAM)\\s*(\\d{4})', 2)
  WHEN regexp_matches(upper(period_text), '(?:NĂM|NAM)\\s*(\\d{4})')
    THEN 'NĂM ' || regexp_extract(upper(period_text), '(?:NĂM|NAM)\\s*(\\d{4})', 1)
  WHEN upper(period_text) NOT IN ('N/A', '', 'NONE', 'NULL') THEN upper(period_text) END"""


@query(
    "A16_dominant_period",
    f"""WITH c AS (SELECT file_id, {PERIOD_SQL} AS period FROM v_docs),
      n AS (SELECT file_id, period, count(*) AS k FROM c WHERE period IS NOT NULL GROUP BY ALL),
      best AS (SELECT file_id, period, count(*) OVER (PARTITION BY file_id) AS candidates FROM n
               QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY k DESC, period) = 1)
      SELECT f.file_id, coalesce(period, 'UNKNOWN_KY') AS period, coalesce(candidates, 0) AS candidates,
        coalesce(candidates, 0) > 1 AS warning
      FROM (SELECT DISTINCT file_id FROM v_docs) f LEFT JOIN best USING (file_id)""",
)
def a16(t):
    return marts.dominant_period(t.v_docs, "file_id", text.normalize_period(F.col("period_text")))


STATE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'PROCESSING' WHEN o_orderkey % 2 = 0 THEN 'CANCELLED' ELSE 'DUPLICATE' END END"


@query(
    "A17_rollup_status",
    f"""SELECT o_custkey, count(*) AS files, CASE
        WHEN bool_or(s IN ('QUEUED', 'DOWNLOADING', 'PROCESSING')) THEN 'PROCESSING'
        WHEN bool_or(cancel) AND bool_and(s = 'CANCELLED') THEN 'CANCELLED'
        WHEN bool_and(s IN ('COMPLETED', 'DUPLICATE')) THEN 'COMPLETED'
        WHEN bool_or(s IN ('COMPLETED', 'DUPLICATE')) AND bool_or(s = 'FAILED') THEN 'PARTIAL_SUCCESS'
        WHEN bool_or(s = 'FAILED') THEN 'FAILED'
        WHEN bool_and(s = 'CANCELLED') THEN 'CANCELLED' ELSE 'FAILED' END AS status
      FROM (SELECT o_custkey, {STATE_SQL} AS s, o_custkey % 3 = 0 AS cancel FROM orders) GROUP BY o_custkey""",
)
def a17(t):
    files = t.orders.select("o_custkey", F.expr(STATE_SQL).alias("s"), F.expr("o_custkey % 3 = 0").alias("cancel"))
    return marts.rollup_status(files, "o_custkey", "s", "cancel")


@query(
    "D12_normalize_status",
    """SELECT row_id, CASE WHEN regexp_matches(upper(trim(status_text)), 'KHÔNG ĐẠT|FAILED') THEN 'FAILED'
         WHEN regexp_matches(upper(trim(status_text)), 'CHƯA ĐẾN KỲ|NOT DUE') THEN 'NOT_DUE'
         WHEN regexp_matches(upper(trim(status_text)), 'ĐẠT|PASSED|SUCCESS') THEN 'PASSED'
         ELSE upper(trim(status_text)) END AS status FROM v_docs""",
)
def d12(t):
    return t.v_docs.select("row_id", text.normalize_status(F.col("status_text")).alias("status"))


@query(
    "D13_parse_number",
    """SELECT row_id, TRY_CAST(replace(replace(trim(value_text), '%', ''), ',', '.') AS DOUBLE) AS number FROM v_docs""",
)
def d13(t):
    return t.v_docs.select("row_id", text.parse_number(F.col("value_text")).alias("number"))


@query("D14_normalize_period", f"SELECT row_id, {PERIOD_SQL} AS period FROM v_docs")
def d14(t):
    return t.v_docs.select("row_id", text.normalize_period(F.col("period_text")).alias("period"))


@query(
    "D15_unit_from_code",
    """SELECT p_partkey, trim(CASE WHEN contains(code, '-') THEN split_part(upper(code), '-', 1)
         ELSE split_part(upper(code), ' ', 1) END) AS unit
       FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' - MT' || p_size ELSE p_brand || ' MT' || p_size END AS code FROM part)""",
)
def d15(t):
    code = F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' - MT' || p_size ELSE p_brand || ' MT' || p_size END")
    return t.part.select("p_partkey", text.unit_from_code(code).alias("unit"))


@query(
    "P12_dictionary_lookup",
    "SELECT n_nationkey, n_name, r_name AS region_label FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON n_regionkey = r_regionkey",
)
def p12(t):
    labels = t.region.filter("r_regionkey <> 3").select("r_regionkey", "r_name")
    return marts.lookup(t.nation, "n_regionkey", labels, "region_label").select("n_nationkey", "n_name", "region_label")
