"""Queries for histories, slices, pages, checkpoints, replays, streams and versions."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from strataforge.functions.checksum import row_checksum
from strataforge.operators import audit, cdc, history, incremental, marts
from strataforge.plans import flows
from strataforge.plans.catalog.audits import EVENT_CONTRACT, event_records
from strataforge.plans.catalog.common import AS_OF, FEED_COLUMNS, FEED_KEY, STAMP, feed_steps, merged_state, shown
from strataforge.plans.catalog.mart import FACT, MART
from strataforge.plans.registry import query
from strataforge.session import scratch
from strataforge.sources import sinks
from strataforge.sources.ledger import GateFailure, Ledger, VersionConflict
from strataforge.operators.schema import stamp
from strataforge.streaming import land

HISTORY_FIELDS = ["event_type", "checksum", "cents"]


def difference_sql(field):
    return (
        f"CASE WHEN n > 1 AND {field} IS DISTINCT FROM p_{field} THEN '{field}:' || "
        f"coalesce(CAST(p_{field} AS VARCHAR), 'NULL') || '>' || coalesce(CAST({field} AS VARCHAR), 'NULL') END"
    )


@query(
    "M12_version_history",
    f"""WITH h AS (SELECT *, row_number() OVER w AS n, lead(ingested_at) OVER w AS valid_to,
        {', '.join(f'lag({f}) OVER w AS p_{f}' for f in HISTORY_FIELDS)}
      FROM v_feed_all WINDOW w AS (PARTITION BY user_id ORDER BY ingested_at, record_id))
    SELECT user_id, n AS version_number, CASE WHEN is_deleted THEN 'DELETE' WHEN n = 1 THEN 'INSERT' ELSE 'UPDATE' END AS operation,
      strftime(ingested_at, '{STAMP}') AS valid_from, strftime(valid_to, '{STAMP}') AS valid_to, valid_to IS NULL AS is_current,
      concat_ws('|', {', '.join(difference_sql(f) for f in HISTORY_FIELDS)}) AS changes, record_id FROM h""",
)
def m12(t):
    versions = history.version_history(t.v_feed_all, "user_id", "ingested_at", "record_id", HISTORY_FIELDS)

    def line(c):
        old, new = F.coalesce(c["old_value"], F.lit("NULL")), F.coalesce(c["new_value"], F.lit("NULL"))
        return F.concat(c["field"], F.lit(":"), old, F.lit(">"), new)

    return shown(versions.withColumn("changes", F.concat_ws("|", F.transform("changes", line))).drop(*HISTORY_FIELDS))


@query(
    "M13_entity_timeline",
    f"""SELECT user_id, count(*) AS total_versions, CASE WHEN arg_max(is_deleted, (ingested_at, record_id)) THEN 'DELETED' ELSE 'ACTIVE' END AS current_status,
        strftime(max(ingested_at), '{STAMP}') AS latest_update_at, arg_min(event_type, (ingested_at, record_id)) AS first_type,
        arg_min(cents, (ingested_at, record_id)) AS first_cents,
        coalesce(arg_max(event_type, (ingested_at, record_id)) FILTER (NOT is_deleted), arg_max(event_type, (ingested_at, record_id))) AS last_type,
        coalesce(arg_max(cents, (ingested_at, record_id)) FILTER (NOT is_deleted), arg_max(cents, (ingested_at, record_id))) AS last_cents
      FROM v_feed_all GROUP BY user_id""",
)
def m13(t):
    timeline = history.entity_timeline(t.v_feed_all, "user_id", "ingested_at", "record_id", ["event_type", "cents"])
    return shown(
        timeline.select(
            "user_id", "total_versions", "current_status", "latest_update_at",
            F.col("initial.event_type").alias("first_type"), F.col("initial.cents").alias("first_cents"),
            F.col("last_known.event_type").alias("last_type"), F.col("last_known.cents").alias("last_cents"),
        )
    )


@query(
    "I1_incremental_slice",
    f"""SELECT event_id, strftime(ts, '{STAMP}') AS ts, (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00') > 300 AS has_more
        FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' ORDER BY events.ts, event_id LIMIT 100 OFFSET 200""",
)
def i1(t):
    rows = t.events.select("event_id", "ts")
    return shown(incremental.incremental_slice(rows, "ts", "event_id", "2024-01-20 00:00:00", offset=200, limit=100))


@query(
    "I2_paginate",
    """SELECT 'page' AS mode, * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 40 OFFSET 80)
       UNION ALL SELECT 'offset', * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 40 OFFSET 95)
       UNION ALL SELECT 'cursor', * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 40 OFFSET 120)
       UNION ALL SELECT 'after', * FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 50 OR (o_custkey = 50 AND o_orderkey > 9000)
         ORDER BY o_custkey, o_orderkey LIMIT 40)""",
)
def i2(t):
    rows, order = t.orders.select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"]
    pages = {
        "page": incremental.paginate(rows, order, "page", 3, 40),
        "offset": incremental.paginate(rows, order, "offset", 95, 40),
        "cursor": incremental.paginate(rows, order, "cursor", "120", 40),
        "after": incremental.page_after(rows, order, [50, 9000], 40),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("mode", F.lit(name)) for name, df in pages.items()])


@query(
    "I3_next_watermark",
    f"""SELECT 'first' AS case_name, count(*) AS rows, CAST(0 AS BIGINT) AS unusable, strftime(max(ts), '{STAMP}') AS watermark, 'ADVANCED' AS state FROM events
       UNION ALL SELECT 'same', count(*), 0, strftime(max(ts), '{STAMP}'), 'REJECTED' FROM events
       UNION ALL SELECT 'naive', count(*), count(*) FILTER (event_id % 10 = 0), strftime(date_trunc('second', max(ts) FILTER (event_id % 10 <> 0)), '{STAMP}'), 'REJECTED' FROM events
       UNION ALL SELECT 'none', 0, 0, NULL, 'NO_CHANGE'""",
)
def i3(t):
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 10 == 0, "").otherwise("+00:00"))
    cases = {
        "first": incremental.next_watermark(events, "ts"),
        "same": incremental.next_watermark(events, "ts", last),
        "naive": incremental.next_watermark(events.withColumn("ts", text), "ts"),
        "none": incremental.next_watermark(events.filter("event_id < 0"), "ts"),
    }
    return shown(reduce(DataFrame.unionByName, [df.withColumn("case_name", F.lit(n)) for n, df in cases.items()]))


def identity_sql(dataset, checkpoint, strategy):
    payload = f"CASE WHEN {checkpoint} IS NULL THEN 'null' ELSE '{{\"value\":\"' || {checkpoint} || '\"}}' END"
    kind = f"CASE WHEN {strategy} IS NULL THEN 'null' ELSE '\"' || {strategy} || '\"' END"
    text = f"'{{\"checkpoint_payload\":' || {payload} || ',\"dataset_id\":\"' || {dataset} || '\",\"strategy_type\":' || {kind} || '}}'"
    return f"'airflow_api_' || left(sha256({text}), 20)"


@query(
    "I4_batch_identity",
    f"""WITH c AS (SELECT event_type, user_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') END AS mark
                   FROM events GROUP BY event_type, user_id)
      SELECT event_type, user_id, {identity_sql('event_type', 'mark', "CASE WHEN mark IS NULL THEN NULL ELSE 'timestamp' END")} AS batch_id,
        sha256(event_type || chr(10) || user_id) AS run_id FROM c""",
)
def i4(t):
    marks = t.events.groupBy("event_type", "user_id").agg(
        F.when(F.col("user_id") % 4 != 0, F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("mark")
    )
    strategy = F.when(F.col("mark").isNotNull(), "timestamp")
    return marks.select(
        "event_type",
        "user_id",
        incremental.batch_identity(F.col("event_type"), strategy, F.col("mark")).alias("batch_id"),
        incremental.run_identity(F.col("event_type"), F.col("user_id").cast("string")).alias("run_id"),
    )


LOAD_ENDS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00", "2025-01-01 00:00:00")


def per_batch(df: DataFrame) -> DataFrame:
    return df.groupBy("_batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "I5_incremental_load",
    f"""WITH s AS (SELECT *, CASE WHEN ts < TIMESTAMP '{LOAD_ENDS[0]}' THEN 0 WHEN ts < TIMESTAMP '{LOAD_ENDS[1]}' THEN 1 ELSE 2 END AS part FROM events),
      m AS (SELECT part, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS mark FROM s GROUP BY part),
      b AS (SELECT m.*, p.mark AS before FROM m LEFT JOIN m p ON p.part = m.part - 1)
      SELECT {identity_sql("'events'", 'before', "CASE WHEN before IS NULL THEN NULL ELSE 'timestamp' END")} AS _batch_id, rows, first_id, last_id FROM b""",
)
def i5(t):
    """Three runs while the source grows; a fourth finds nothing and a repeat of a run changes nothing."""
    root = scratch(t.spark, "incremental")
    ledger, path = Ledger(t.spark, root), f"{root}/bronze"
    events = event_records(t).withColumn("_record_checksum", row_checksum(["event_id", "user_id", "event_type"]))
    for end in (*LOAD_ENDS, LOAD_ENDS[-1]):
        flows.incremental_load(events.filter(F.col("updated_at") < F.lit(end).cast("timestamp")), "events", "updated_at", ledger, path)
    return per_batch(t.spark.read.parquet(path))


@query(
    "I6_replay_batch",
    """SELECT 'b' || (event_id % 2) AS _batch_id, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL""",
)
def i6(t):
    """The first batch lands twice, the second once; the replay replaces its own partition."""
    path = scratch(t.spark, "replay")
    for n in (0, 0, 1):
        part = event_records(t).filter(F.col("event_id") % 2 == n)
        sinks.land_bronze(stamp(part, EVENT_CONTRACT, f"b{n}", AS_OF), path, f"b{n}")
    return per_batch(t.spark.read.parquet(path))


@query(
    "I7_stream_land",
    f"SELECT event_id, user_id, event_type, strftime(ts, '{STAMP}') AS updated_at FROM events",
)
def i7(t):
    """Two deliveries, two runs of the stream; the second run takes only the new files."""
    root = scratch(t.spark, "stream")
    records = event_records(t)
    for n in (0, 1):
        records.filter(F.col("event_id") % 2 == n).write.mode("append").parquet(f"{root}/in")
        land.stream_land(t.spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", records.schema)
    return shown(t.spark.read.parquet(f"{root}/out"))


def replayed_sql(count):
    """SQL of merging the feed batch by batch into an empty state."""
    steps = ["state0 AS (SELECT * FROM v_feed WHERE false)"]
    for n in range(count):
        steps.append(f"src{n} AS (SELECT * FROM v_feed WHERE batch_id = 'b{n}')")
        steps.append(feed_steps(f"src{n}", f"state{n}", str(n)))
        steps.append(f"state{n + 1} AS ({merged_state(f'classes{n}', f'state{n}')})")
    return "WITH " + ",\n".join(steps)


@query("I8_stream_upsert", replayed_sql(4) + f" SELECT {FEED_COLUMNS} FROM state4")
def i8(t):
    """Four deliveries merged by the stream; the state equals merging the batches one by one."""
    root = scratch(t.spark, "upsert")
    ledger, feed = Ledger(t.spark, root), t.v_feed

    def step(batch, state):
        return flows.silver_batch(batch, state, FEED_KEY, at=AS_OF).candidate

    for n in range(4):
        feed.filter(F.col("batch_id") == f"b{n}").write.mode("append").parquet(f"{root}/in")
        land.stream_upsert(t.spark, f"{root}/in", f"{root}/checkpoint", feed.schema, ledger, "feed", FEED_KEY, step, buckets=16)
    return shown(ledger.live("feed").drop("_silver_updated_at"))


STREAM_DELAY = "5 days"


def stream_state_sql(deliveries):
    """SQL of the latest row per key of what is not later than the watermark when it is delivered."""
    rows = " UNION ALL ".join(f"SELECT {n} AS delivery, * FROM v_feed_all WHERE {rule}" for n, rule in enumerate(deliveries))
    return f"""WITH d AS ({rows}), seen AS (
        SELECT n.delivery, max(d.ingested_at) - INTERVAL {STREAM_DELAY} AS mark FROM (SELECT DISTINCT delivery FROM d) n
        JOIN d ON d.delivery < n.delivery GROUP BY n.delivery),
      kept AS (SELECT d.* FROM d LEFT JOIN seen USING (delivery) WHERE mark IS NULL OR ingested_at > mark)
      SELECT user_id, event_type, arg_max(record_id, (ingested_at, record_id)) AS record_id, arg_max(cents, (ingested_at, record_id)) AS cents,
        (SELECT count(*) FROM d) - (SELECT count(*) FROM kept) AS late
      FROM kept GROUP BY user_id, event_type"""


# the first days, then later ones with stragglers and rows sent again
DELIVERIES = [
    "ingested_at < TIMESTAMP '2024-01-10 00:00:00' AND record_id % 10 <> 0",
    "ingested_at < TIMESTAMP '2024-01-20 00:00:00' AND (record_id % 10 = 0 OR ingested_at >= TIMESTAMP '2024-01-08 00:00:00') AND record_id % 10 <> 1",
    "record_id % 10 = 1 OR ingested_at >= TIMESTAMP '2024-01-20 00:00:00'",
]


@query("I8_stream_state", stream_state_sql(DELIVERIES))
def i8_state(t):
    """Three deliveries; ids, latest rows and the watermark live in the state store, a last run finds nothing new."""
    root = scratch(t.spark, "stream-state")
    feed = t.v_feed_all.drop("checksum", "batch_id").withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    late = 0
    for rule in [*DELIVERIES, None]:
        if rule:
            feed.filter(rule).write.mode("append").parquet(f"{root}/in")
        late += land.stream_changes(
            t.spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", feed.schema, FEED_KEY, "record_id", "ingested_at", STREAM_DELAY
        )["late"]
    state = land.current(t.spark, f"{root}/out", feed.schema, FEED_KEY, "record_id", "ingested_at")
    return state.select("user_id", "event_type", "record_id", "cents", F.lit(late).cast("bigint").alias("late"))


def _gate(df):
    return audit.gate_silver(df, ["indicator", "period"], ["indicator", "result"], "period", "UNKNOWN_KY")


@query(
    "V1_write_audit_publish",
    "SELECT indicator, period, value_num, result FROM v_kpi",
)
def v1(t):
    """A good candidate goes live; a later one with repeated keys is refused and changes nothing."""
    ledger = Ledger(t.spark, scratch(t.spark, "wap"))
    good = t.v_kpi.select("indicator", "period", "value_num", "result")
    ledger.write_audit_publish("kpi", good, _gate)
    try:
        ledger.write_audit_publish("kpi", good.unionByName(good.filter("result = 'FAILED'")), _gate)
    except GateFailure as refused:
        assert set(refused.failures) == {"duplicate_keys"}
    return ledger.live("kpi")


@query(
    "V2_publish_bundle",
    f"""WITH {FACT}, {MART} SELECT 'fact' AS table_name, count(*) AS rows FROM fact UNION ALL SELECT 'mart', count(*) FROM mart""",
)
def v2(t):
    """Both marts go live together; the repeat is a no-op and a stale bundle is refused."""
    ledger = Ledger(t.spark, scratch(t.spark, "bundle"))
    fact = marts.outcome_fact(t.v_outcomes)
    frames = {"fact": fact, "mart": marts.period_mart(fact)}
    stale = ledger.prepare_bundle({"mart": frames["mart"].filter("semester = 1")})
    bundle = ledger.prepare_bundle(frames)
    published = ledger.publish_bundle(bundle)
    assert ledger.publish_bundle(bundle) == published
    try:
        ledger.publish_bundle(stale)
        raise AssertionError("a stale bundle was published")
    except VersionConflict:
        pass
    return audit.table_counts([(name, ledger.live(name)) for name in frames])


@query(
    "V3_tag_read_as_of",
    """SELECT 'tagged' AS version, period, CAST(sum(value_num) AS BIGINT) AS total FROM v_kpi WHERE sort_key % 10 <= 2 GROUP BY period
       UNION ALL SELECT 'live', period, CAST(sum(value_num) AS BIGINT) FROM v_kpi GROUP BY period""",
)
def v3(t):
    ledger = Ledger(t.spark, scratch(t.spark, "tag"))
    kpi = t.v_kpi.select("indicator", "period", "value_num", "sort_key")
    ledger.replace("kpi", kpi.filter("sort_key % 10 <= 2"))
    ledger.tag("half")
    ledger.replace("kpi", kpi)
    versions = {"tagged": ledger.read_at("kpi", "half"), "live": ledger.live("kpi")}
    sums = [
        df.groupBy("period").agg(F.sum("value_num").alias("total")).withColumn("version", F.lit(n)) for n, df in versions.items()
    ]
    return reduce(DataFrame.unionByName, sums)


@query(
    "V4_row_lineage",
    f"""WITH {FACT} SELECT record_id AS source_record_id, strftime(updated_at, '{STAMP}') AS source_updated_at,
        checksum AS source_record_checksum, pass_rate FROM fact""",
)
def v4(t):
    fact = marts.outcome_fact(t.v_outcomes)
    return shown(
        fact.select(
            F.col("record_id").alias("source_record_id"),
            F.col("updated_at").alias("source_updated_at"),
            F.col("checksum").alias("source_record_checksum"),
            "pass_rate",
        )
    )


@query(
    "V5_post_load_counts",
    f"""WITH {feed_steps('v_feed', 'v_target')}, merged AS ({merged_state('classes', 'v_target')})
      SELECT 'silver' AS table_name, count(*) AS rows FROM merged
      UNION ALL SELECT 'gold', count(*) FROM (SELECT 1 FROM merged WHERE NOT is_deleted GROUP BY event_type)""",
)
def v5(t):
    ledger = Ledger(t.spark, scratch(t.spark, "counts"))
    classes = cdc.classify(cdc.resolve_batch(t.v_feed, FEED_KEY), t.v_target, FEED_KEY)
    mergeable = classes.filter("row_class = 'mergeable'").drop("row_class", "rejection_reason")
    ledger.replace("silver", cdc.merge_newer(t.v_target, mergeable, FEED_KEY, at=AS_OF))
    active = marts.filter_active(ledger.live("silver"))
    ledger.replace("gold", marts.generic_gold(active, ["event_type"], ["cents"]))
    return audit.table_counts([(name, ledger.live(name)) for name in ("silver", "gold")])
