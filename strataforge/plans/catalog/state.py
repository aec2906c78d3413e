"""Queries for row rules, checksums, deduplication and merging."""

from pyspark.sql import functions as F

from strataforge.functions import checksum
from strataforge.functions.frames import side_by_side
from strataforge.functions.windows import rank_in_order
from strataforge.operators import cdc, marts, quality
from strataforge.operators.star import Roles
from strataforge.plans import flows
from strataforge.plans.catalog.common import (
    AS_OF,
    FEED_COLUMNS,
    FEED_KEY,
    FEED_ORDER,
    feed_steps,
    merged_state,
    shown,
    sides,
)
from strataforge.plans.registry import query

LINE_RULES = (
    ("QUANTITY_HIGH", "l_quantity > 45"),
    ("FREE_OF_TAX", "l_tax = 0"),
    ("RETURNED_OPEN", "l_returnflag = 'R' AND l_linestatus = 'O'"),
)
LINE_SQL = """WITH marked AS (
  SELECT l_orderkey, l_partkey, l_linenumber, concat_ws('|',
    CASE WHEN l_quantity > 45 THEN 'QUANTITY_HIGH' END,
    CASE WHEN l_tax = 0 THEN 'FREE_OF_TAX' END,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'RETURNED_OPEN' END) AS reasons
  FROM lineitem)
"""
LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_linenumber"]


@query("Q1_add_dq_reasons", LINE_SQL + "SELECT * FROM marked")
def q1(t):
    marked = quality.add_reasons(t.lineitem, LINE_RULES)
    return marked.select(*LINE_COLUMNS, F.concat_ws("|", quality.REASONS).alias("reasons"))


@query(
    "Q2_split_dq",
    LINE_SQL
    + """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN reasons = '' THEN 'valid' ELSE 'rejected' END AS side,
       CASE WHEN reasons = '' THEN NULL ELSE reasons END AS rejection_reason FROM marked""",
)
def q2(t):
    valid, rejected = quality.split_dq(t.lineitem, LINE_RULES)
    return sides(valid.select(*LINE_COLUMNS), rejected.select(*LINE_COLUMNS, "rejection_reason"), ("valid", "rejected"))


@query(
    "Q3_rule_pack_outcomes",
    """SELECT record_id, concat_ws('|',
      CASE WHEN gpa_students > students THEN 'GPA_STUDENT_COUNT_EXCEEDS_STUDENT_COUNT' END,
      CASE WHEN warned IS NULL OR warned < 0 THEN 'WARNING_STUDENT_COUNT_NEGATIVE' END,
      CASE WHEN warned > students THEN 'WARNING_STUDENT_COUNT_EXCEEDS_STUDENT_COUNT' END,
      CASE WHEN left_early > students THEN 'DROPOUT_RISK_EXCEEDS_STUDENT_COUNT' END,
      CASE WHEN on_track > evaluated THEN 'ON_TRACK_EXCEEDS_PROGRESS_EVALUATED' END) AS rejection_reason
    FROM (SELECT *, CASE WHEN attempted % 7 = 0 THEN NULL ELSE attempted - passed - 10 END AS warned,
                 attempted - on_track AS left_early FROM v_outcomes)""",
)
def q3(t):
    rows = t.v_outcomes.withColumns(
        {
            "warning_students": F.expr("CASE WHEN attempted % 7 = 0 THEN NULL ELSE attempted - passed - 10 END"),
            "dropout_students": F.expr("attempted - on_track"),
        }
    )
    marked = quality.add_reasons(rows, quality.OUTCOME_RULES)
    return marked.select("record_id", F.concat_ws("|", quality.REASONS).alias("rejection_reason"))


@query(
    "Q4_rule_pack_sections",
    """SELECT section_code, concat_ws('|',
      CASE WHEN unit_code IS NULL OR trim(unit_code) = '' THEN 'MISSING_UNIT_CODE' END,
      CASE WHEN semester IS NULL OR semester <= 0 THEN 'INVALID_SEMESTER' END,
      CASE WHEN progress_pct IS NULL OR progress_pct < 0 OR progress_pct > 100 THEN 'INVALID_TEACHING_PROGRESS_PERCENT' END,
      CASE WHEN credits % 41 = 0 THEN 'MISSING_SOURCE_UPDATED_AT' END) AS rejection_reason
    FROM v_sections""",
)
def q4(t):
    rows = t.v_sections.withColumns(
        {
            "record_id": F.col("section_code"),
            "updated_at": F.expr("CASE WHEN credits % 41 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END"),
        }
    )
    marked = quality.add_reasons(rows, quality.SECTION_RULES)
    return marked.select("section_code", F.concat_ws("|", quality.REASONS).alias("rejection_reason"))


@query(
    "Q5_quarantine_rows",
    LINE_SQL
    + """SELECT l_orderkey, l_partkey, concat_ws('|', CAST(l_orderkey AS VARCHAR),
         coalesce(CAST(nullif(l_linenumber, 3) AS VARCHAR), '<NULL>')) AS _business_key,
       reasons AS rejection_reason, '2024-03-01 00:00:00.000000' AS rejected_at
     FROM marked WHERE reasons <> ''""",
)
def q5(t):
    _, rejected = quality.split_dq(t.lineitem, LINE_RULES)
    keyed = rejected.withColumn("line", F.expr("nullif(l_linenumber, 3)"))
    return shown(quality.to_quarantine(keyed, ["l_orderkey", "line"], ["l_orderkey", "l_partkey"], AS_OF))


@query(
    "P8_row_checksum",
    """SELECT p_partkey, sha256(concat_ws('||', CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type,
         coalesce(CAST(nullif(p_size, 7) AS VARCHAR), '<NULL>'))) AS _record_checksum FROM part""",
)
def p8(t):
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_type", F.expr("nullif(p_size, 7)").alias("p_size"))
    return checksum.with_row_checksum(part, "updated_at").select("p_partkey", "_record_checksum")


@query(
    "P9_canonical_json_checksum",
    """SELECT n_nationkey, sha256('{"name":"' || n_name || '","nationkey":' || n_nationkey || ',"regionkey":'
         || coalesce(CAST(nullif(n_regionkey, 2) AS VARCHAR), 'null') || '}') AS record_checksum FROM nation""",
)
def p9(t):
    nation = t.nation.withColumn("n_regionkey", F.expr("nullif(n_regionkey, 2)"))
    aliases = {"n_nationkey": "nationkey", "n_name": "name", "n_regionkey": "regionkey"}
    return nation.select("n_nationkey", checksum.json_checksum(nation, aliases).alias("record_checksum"))


@query(
    "P10_surrogate_key",
    """SELECT r_name, sha256(concat_ws('||', coalesce(CAST(nullif(r_regionkey, 1) AS VARCHAR), ''), r_name)) AS _surrogate_row_id,
         sha256(concat_ws('||', coalesce(CAST(nullif(r_regionkey, 1) AS VARCHAR), '<NULL>'), r_name)) AS _context_row_hash
       FROM region""",
)
def p10(t):
    region = t.region.withColumn("r_regionkey", F.expr("nullif(r_regionkey, 1)"))
    plain = checksum.with_surrogate_key(region, "_surrogate_row_id")
    technical = ("_surrogate", "_airbyte_", "_context_")
    return checksum.with_surrogate_key(plain, "_context_row_hash", "<NULL>", technical).drop("r_regionkey")


@query(
    "P11_filter_active",
    "SELECT record_id, cents FROM v_feed WHERE CASE WHEN record_id % 5 = 0 THEN NULL ELSE is_deleted END = false",
)
def p11(t):
    feed = t.v_feed.withColumn("is_deleted", F.expr("CASE WHEN record_id % 5 = 0 THEN NULL ELSE is_deleted END"))
    return marts.filter_active(feed).select("record_id", "cents")


@query(
    "P11_delete_where",
    "SELECT indicator, period, result FROM v_kpi WHERE NOT coalesce(CASE WHEN value_num % 7 = 0 THEN 'UNKNOWN_KY' WHEN value_num IS NULL THEN NULL ELSE period END = 'UNKNOWN_KY', false)",
)
def p11_delete(t):
    found = F.expr("CASE WHEN value_num % 7 = 0 THEN 'UNKNOWN_KY' WHEN value_num IS NULL THEN NULL ELSE period END")
    kpi = t.v_kpi.withColumn("found_period", found)
    return marts.delete_where(kpi, "found_period = 'UNKNOWN_KY'").select("indicator", "period", "result")


@query(
    "L1_order_nulls_last",
    f"""SELECT record_id, row_number() OVER (PARTITION BY event_type ORDER BY {FEED_ORDER}) AS position FROM v_feed""",
)
def l1(t):
    order = cdc.feed_order("updated_at", "ingested_at", "batch_id", "checksum", "record_id")
    return rank_in_order(t.v_feed, ["event_type"], order).select("record_id", "position")


@query(
    "M1_dedup_deterministic",
    f"""SELECT {FEED_COLUMNS} FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {FEED_ORDER}) AS rn FROM v_feed) WHERE rn = 1""",
)
def m1(t):
    return shown(cdc.dedup(t.v_feed, FEED_KEY))


@query(
    "M2_dedup_with_discards",
    """SELECT * EXCLUDE (rn), CASE WHEN rn = 1 THEN 'kept' ELSE 'discarded' END AS side FROM (
      SELECT *, row_number() OVER (PARTITION BY unit, period ORDER BY value_num DESC NULLS LAST, indicator) AS rn FROM v_kpi)""",
)
def m2(t):
    order = [F.col("value_num").desc_nulls_last(), F.col("indicator").asc()]
    kept, discarded = cdc.dedup_split(t.v_kpi, ["unit", "period"], order)
    return sides(kept, discarded, ("kept", "discarded"))


@query(
    "M3_dedup_latest_preferred",
    """SELECT event_id, user_id, event_type, props FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def m3(t):
    changes = t.events.withColumnRenamed("ts", "updated_at")
    return cdc.dedup_latest(changes, ["user_id"], ["event_id"]).select("event_id", "user_id", "event_type", "props")


@query(
    "M4_split_conflicts",
    f"""WITH {feed_steps('v_feed', 'v_target')}
    SELECT f.record_id, CASE WHEN b.user_id IS NULL THEN 'clean' ELSE 'conflict' END AS side,
           CASE WHEN b.user_id IS NULL THEN NULL ELSE 'EQUAL_TIMESTAMP_DIFFERENT_CHECKSUM' END AS rejection_reason
    FROM v_feed f LEFT JOIN bad b ON f.user_id = b.user_id AND f.event_type = b.event_type""",
)
def m4(t):
    flagged = cdc.flag_conflicts(t.v_feed, FEED_KEY)
    side = F.when(F.col("rejection_reason").isNull(), "clean").otherwise("conflict").alias("side")
    return flagged.select("record_id", side, "rejection_reason")


@query(
    "M5_classify_against_target",
    f"""WITH {feed_steps('v_feed', 'v_target')}
    SELECT {FEED_COLUMNS}, row_class, rejection_reason FROM classes""",
)
def m5(t):
    return shown(cdc.classify(cdc.resolve_batch(t.v_feed, FEED_KEY), t.v_target, FEED_KEY))


def _merged(t):
    feed, target = t.v_feed, t.v_target
    classes = cdc.classify(cdc.resolve_batch(feed, FEED_KEY), target, FEED_KEY)
    mergeable = classes.filter("row_class = 'mergeable'").select(*feed.columns)
    return cdc.merge_newer(target, mergeable, FEED_KEY, at=AS_OF)


@query(
    "M6_merge_newer",
    f"""WITH {feed_steps('v_feed', 'v_target')}, merged AS ({merged_state('classes', 'v_target')})
    SELECT {FEED_COLUMNS}, CASE WHEN EXISTS (SELECT 1 FROM classes c WHERE c.row_class = 'mergeable'
        AND c.user_id = m.user_id AND c.event_type = m.event_type) THEN '2024-03-01 00:00:00.000000' END AS _silver_updated_at
    FROM merged m""",
)
def m6(t):
    return shown(_merged(t))


@query(
    "M7_upsert_all",
    """SELECT indicator, period, value_num + 1 AS value_num, result FROM v_kpi WHERE sort_key % 10 >= 2
       UNION ALL SELECT indicator, period, value_num, result FROM v_kpi WHERE sort_key % 10 < 2""",
)
def m7(t):
    columns = ["indicator", "period", "value_num", "result"]
    target = t.v_kpi.filter("sort_key % 10 <= 3").select(*columns)
    source = t.v_kpi.filter("sort_key % 10 >= 2").select(*columns).withColumn("value_num", F.col("value_num") + 1)
    return cdc.upsert(target, source, ["indicator", "period"])


@query(
    "M8_merge_cdc",
    """WITH latest AS (SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY updated_at DESC NULLS LAST, record_id DESC) AS rn
        FROM v_feed WHERE user_id % 31 <> 0) WHERE rn = 1)
      SELECT record_id, user_id, event_type, cents FROM latest WHERE NOT is_deleted
      UNION ALL
      SELECT record_id, user_id, event_type, cents FROM v_target t WHERE NOT EXISTS (
        SELECT 1 FROM latest l WHERE l.user_id = t.user_id AND l.event_type = t.event_type)""",
)
def m8(t):
    changes = t.v_feed.withColumn("_ab_cdc_deleted_at", F.expr("CASE WHEN is_deleted THEN CAST(updated_at AS STRING) END"))
    changes = changes.withColumn("user_id", F.expr("CASE WHEN user_id % 31 = 0 THEN NULL ELSE user_id END"))
    state = cdc.merge_cdc(t.v_target, changes, FEED_KEY, tie_break=["record_id"])
    return state.select("record_id", "user_id", "event_type", "cents")


@query(
    "M9_repair_duplicates",
    "SELECT count(*) AS removed, CAST(0 AS BIGINT) AS duplicates_left FROM v_kpi WHERE sort_key % 10 = 4",
)
def m9(t):
    kpi = t.v_kpi
    again = kpi.filter("sort_key % 10 = 4").withColumn("value_num", F.col("value_num") + 1)
    order = [F.col("value_num").desc_nulls_last(), F.col("result").asc()]
    _, audit = cdc.repair_duplicates(kpi.unionByName(again), ["indicator", "period"], order)
    return audit


FEED_RULES = (("NEGATIVE_AMOUNT", "cents < 0"), ("AMOUNT_TOO_LARGE", "cents > 15000"), ("MISSING_KEY", "user_id IS NULL"))


@query(
    "M10_silver_batch",
    f"""WITH valid AS (SELECT * FROM v_feed WHERE NOT coalesce(cents < 0 OR cents > 15000 OR user_id IS NULL, false)),
    {feed_steps('valid', 'v_target')}, merged AS ({merged_state('classes', 'v_target')}),
    conflicts AS (SELECT count(*) AS n FROM valid v JOIN bad b ON v.user_id = b.user_id AND v.event_type = b.event_type)
    SELECT (SELECT count(*) FROM v_feed) AS source_rows, (SELECT count(*) FROM valid) AS valid_rows,
      (SELECT n FROM conflicts) AS batch_conflicts, count(*) AS deduplicated,
      count(*) FILTER (row_class = 'mergeable') AS mergeable, count(*) FILTER (row_class = 'stale') AS stale,
      count(*) FILTER (row_class = 'duplicate') AS duplicate, count(*) FILTER (row_class = 'quarantine') AS quarantine,
      count(*) FILTER (row_class = 'unclassified') AS unclassified,
      (SELECT count(*) FROM v_feed) - (SELECT count(*) FROM valid) + (SELECT n FROM conflicts)
        + count(*) FILTER (row_class = 'quarantine') AS quarantine_rows,
      (SELECT count(*) FROM merged) AS state_rows, (SELECT CAST(sum(cents) AS BIGINT) FROM merged) AS state_cents
    FROM classes""",
)
def m10(t):
    result = flows.silver_batch(t.v_feed, t.v_target, FEED_KEY, FEED_RULES, at=AS_OF)
    count = F.count(F.lit(1))
    return side_by_side(
        result.metrics,
        result.quarantine.agg(count.alias("quarantine_rows")),
        result.candidate.agg(count.alias("state_rows"), F.sum("cents").alias("state_cents")),
    )


GENERIC_ROLES = Roles(("customer_id",), "o_orderdate", (), ())


@query(
    "M11_generic_batch",
    """WITH src AS (SELECT o_orderkey, o_custkey AS customer_id, o_orderstatus, o_orderdate, o_orderpriority,
        sha256(concat_ws('||', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS cs FROM orders),
      tgt AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY o_orderdate DESC, cs) AS rn
              FROM src WHERE o_orderkey % 3 = 0) WHERE rn = 1),
      bad AS (SELECT DISTINCT customer_id FROM (SELECT customer_id, o_orderdate FROM src GROUP BY ALL HAVING count(DISTINCT cs) > 1)),
      winners AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY o_orderdate DESC, cs) AS rn
              FROM src WHERE customer_id NOT IN (SELECT customer_id FROM bad)) WHERE rn = 1),
      classes AS (SELECT w.*, CASE WHEN t.customer_id IS NULL OR w.o_orderdate > t.o_orderdate THEN 'mergeable'
              WHEN w.o_orderdate < t.o_orderdate THEN 'stale' WHEN w.cs = t.cs THEN 'duplicate' ELSE 'quarantine' END AS k
              FROM winners w LEFT JOIN tgt t ON w.customer_id = t.customer_id)
      SELECT (SELECT count(*) FROM src) AS source_rows,
        (SELECT count(*) FROM src WHERE customer_id IN (SELECT customer_id FROM bad)) AS batch_conflicts,
        count(*) AS deduplicated, count(*) FILTER (k = 'mergeable') AS mergeable, count(*) FILTER (k = 'stale') AS stale,
        count(*) FILTER (k = 'duplicate') AS duplicate, count(*) FILTER (k = 'quarantine') AS quarantine,
        (SELECT count(*) FROM src) - (SELECT count(*) FROM src WHERE customer_id IN (SELECT customer_id FROM bad)) - count(*) AS repeated
      FROM classes""",
)
def m11(t):
    raw = t.orders.drop("o_totalprice")
    mapping = {"o_custkey": "customer_id"}
    third = raw.filter("o_orderkey % 3 = 0")
    first = checksum.with_row_checksum(third.withColumnRenamed("o_custkey", "customer_id"), "o_orderdate")
    target = cdc.first_per_key(first, ["customer_id"], [F.desc("o_orderdate"), F.asc("_record_checksum")])
    result = flows.generic_batch(raw, GENERIC_ROLES, target, AS_OF, mapping)
    return result.metrics.drop("valid_rows", "unclassified")


@query(
    "U1_union_by_name",
    f"""WITH {feed_steps('v_feed', 'v_target')}
    SELECT f.record_id, 'EQUAL_TIMESTAMP_DIFFERENT_CHECKSUM' AS rejection_reason, CAST(NULL AS VARCHAR) AS row_class
    FROM v_feed f JOIN bad b ON f.user_id = b.user_id AND f.event_type = b.event_type
    UNION ALL BY NAME SELECT record_id, rejection_reason, row_class FROM classes WHERE row_class = 'quarantine'""",
)
def u1(t):
    feed = t.v_feed
    _, conflicts = cdc.split_conflicts(feed, FEED_KEY)
    blocked = cdc.classify(cdc.resolve_batch(feed, FEED_KEY), t.v_target, FEED_KEY).filter("row_class = 'quarantine'")
    return conflicts.select("record_id", "rejection_reason").unionByName(
        blocked.select("row_class", "record_id", "rejection_reason"), allowMissingColumns=True
    )
