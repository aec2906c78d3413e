from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataforge.operators import cdc
from strataforge.operators.quality import OUTCOME_RULES, SECTION_RULES
from strataforge.plans import flows
from strataforge.plans.registry import Inputs

FEED = "record_id string, k string, updated_at timestamp, ingested_at timestamp, batch_id string, checksum string, is_deleted boolean"
T1, T2, T3 = dt(2024, 1, 1), dt(2024, 1, 2), dt(2024, 1, 3)


def feed(spark, *rows):
    """Rows as (id, key, time, checksum[, deleted[, ingested[, batch]]])."""
    full = [(r[0], r[1], r[2], r[5] if len(r) > 5 else T1, r[6] if len(r) > 6 else "b", r[3], r[4] if len(r) > 4 else False) for r in rows]
    return spark.createDataFrame(full, FEED)


def ids(df):
    return sorted(r.record_id for r in df.select("record_id").collect())


@pytest.mark.parametrize(
    "first, second, winner",
    [
        (("a", "k", T1, "x"), ("b", "k", T2, "x"), "b"),
        (("a", "k", T2, "x", False, T2), ("b", "k", T2, "x", False, T1), "a"),
        (("a", "k", T2, "x", False, T1, "b1"), ("b", "k", T2, "x", False, T1, "b2"), "b"),
        (("a", "k", T2, "y"), ("b", "k", T2, "x"), "b"),
        (("a", "k", T2, None), ("b", "k", T2, "x"), "b"),
        (("a", "k", T2, "x"), ("b", "k", T2, "x"), "a"),
        (("a", "k", None, "x"), ("b", "k", T1, "x"), "b"),
    ],
)
def test_dedup_priority(spark, first, second, winner):
    for order in ((first, second), (second, first)):
        assert ids(cdc.dedup(feed(spark, *order), ["k"])) == [winner]


def test_conflict_blocks_the_whole_key(spark):
    df = feed(spark, ("a", "k", T1, "x"), ("b", "k", T1, "y"), ("c", "k", T2, "z"), ("d", "m", T1, "x"), ("e", "m", T1, "x"))
    clean, bad = cdc.split_conflicts(df, ["k"])
    assert (ids(clean), ids(bad)) == (["d", "e"], ["a", "b", "c"])
    assert {r[0] for r in bad.select("rejection_reason").collect()} == {cdc.EQUAL_TIME_CONFLICT}


def test_missing_checksum_is_a_value(spark):
    df = feed(spark, ("a", "k", T1, None), ("b", "k", T1, "y"), ("c", "m", T1, None), ("d", "m", T1, None))
    clean, bad = cdc.split_conflicts(df, ["k"])
    assert (ids(clean), ids(bad)) == (["c", "d"], ["a", "b"])


def test_null_keys_stay_clean(spark):
    df = feed(spark, ("a", None, T1, "x"), ("b", None, T1, "y"))
    clean, bad = cdc.split_conflicts(df, ["k"])
    assert (ids(clean), ids(bad)) == (["a", "b"], [])


def test_resolve_batch_is_split_then_dedup(spark):
    df = feed(spark, ("a", "k", T1, "x"), ("b", "k", T1, "y"), ("c", "m", T1, "x"), ("d", "m", T2, "y"), ("e", None, T1, "x"))
    clean, _ = cdc.split_conflicts(df, ["k"])
    assert ids(cdc.resolve_batch(df, ["k"])) == ids(cdc.dedup(clean, ["k"])) == ["d", "e"]


CASES = [
    (("s", "new", T1, "x"), "mergeable", None),
    (("s", "new", T1, "x", True), "quarantine", cdc.DELETE_WITHOUT_TARGET),
    (("s", "new", T1, "x", None), "mergeable", None),
    (("s", "old", T3, "x"), "mergeable", None),
    (("s", "old", T3, "x", True), "mergeable", None),
    (("s", "old", T1, "x"), "stale", None),
    (("s", "old", T2, "x"), "duplicate", None),
    (("s", "old", T2, "y"), "quarantine", cdc.EQUAL_TIME_CONFLICT),
    (("s", "old", T2, None), "quarantine", cdc.EQUAL_TIME_CONFLICT),
    (("s", "bare", T2, None), "duplicate", None),
    (("s", "old", None, "x"), "unclassified", None),
]


@pytest.mark.parametrize("row, expected, reason", CASES)
def test_classes(spark, row, expected, reason):
    target = feed(spark, ("t", "old", T2, "x"), ("u", "bare", T2, None))
    found = cdc.classify(feed(spark, row), target, ["k"]).first()
    assert (found.row_class, found.rejection_reason) == (expected, reason)


def test_classify_without_delete_flag(spark):
    found = cdc.classify(feed(spark, ("s", "new", T1, "x", True)), feed(spark), ["k"], deleted=None).first()
    assert found.row_class == "mergeable"


def test_merge_newer(spark, rows):
    target = feed(spark, ("t1", "a", T2, "x"), ("t2", "b", T2, "x"), ("t3", "c", T2, "x"), ("t4", "d", T2, "x"))
    source = feed(spark, ("s1", "a", T3, "y"), ("s2", "b", T1, "y"), ("s3", "c", T2, "y"), ("s4", "new", T1, "y"), ("s5", "gone", T1, "y", True), ("s6", "d", T3, "y", True))
    merged = cdc.merge_newer(target, source, ["k"], at="2024-05-01")
    assert ids(merged) == ["s1", "s4", "s6", "t2", "t3"]
    assert merged.filter("_silver_updated_at IS NOT NULL").count() == 3
    again = cdc.merge_newer(merged, source, ["k"], at="2024-06-01")
    assert rows(again) == rows(merged)


def test_merge_cdc(spark):
    changes = feed(spark, ("c1", "a", T3, "x"), ("c2", "b", T3, "x"), ("c3", "n", T3, "x"), ("c4", None, T3, "x"), ("c5", "z", T3, "x"))
    changes = changes.withColumn("_ab_cdc_deleted_at", F.when(F.col("k").isin("b", "z"), "2024-01-03"))
    target = feed(spark, ("t1", "a", T1, "x"), ("t2", "b", T1, "x"), ("t3", "q", T1, "x"))
    assert ids(cdc.merge_cdc(target, changes, ["k"])) == ["c1", "c3", "t3"]
    assert ids(cdc.merge_cdc(None, changes, ["k"])) == ["c1", "c3"]


def test_dedup_split_keeps_all_copies(spark, rows):
    df = spark.createDataFrame([("k", 1)] * 5 + [("k", 2)] * 3 + [("m", 7)], "k string, v int")
    kept, discarded = cdc.dedup_split(df, ["k"], [F.desc("v")])
    assert rows(kept) == [("k", 2), ("m", 7)]
    assert rows(kept.unionAll(discarded)) == rows(df)


def test_dedup_latest_without_change_columns(spark, rows):
    df = spark.createDataFrame([("k", 1), ("k", 2), ("k", None)], "k string, v int")
    first = rows(cdc.dedup_latest(df, ["k"]))
    assert len(first) == 1 and first == rows(cdc.dedup_latest(df.orderBy(F.desc("v")), ["k"]))


def test_first_per_key_limits_before_the_exchange(spark):
    df = feed(spark, ("a", "k", T1, "x"))
    plan = cdc.dedup(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_no_join_of_the_whole_batch_in_resolve(spark):
    df = feed(spark, ("a", "k", T1, "x"))
    plan = cdc.resolve_batch(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("WindowGroupLimit")


@pytest.mark.parametrize("partitions", ["1", "4", "32"])
def test_flow_does_not_depend_on_partitions(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    t = Inputs(spark, "/root/testdata/sf0.001")
    key = ["user_id", "event_type"]
    expected = flows.silver_batch(t.v_feed, t.v_target, key, at="2024-05-01")
    wanted = rows(expected.candidate, "record_id", "checksum"), rows(expected.quarantine, "record_id"), rows(expected.metrics)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        mixed = t.v_feed.orderBy(F.xxhash64("record_id", F.lit(partitions)))
        found = flows.silver_batch(mixed, t.v_target, key, at="2024-05-01", stage=partitions != "4")
        assert (rows(found.candidate, "record_id", "checksum"), rows(found.quarantine, "record_id"), rows(found.metrics)) == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_flow_accounts_for_every_row(spark):
    t = Inputs(spark, "/root/testdata/sf0.01")
    key = ["user_id", "event_type"]
    rules = [("LOW", "cents < 100")]
    result = flows.silver_batch(t.v_feed, t.v_target, key, rules, at="2024-05-01")
    m = result.metrics.first()
    assert m.mergeable + m.stale + m.duplicate + m.quarantine + m.unclassified == m.deduplicated
    rejected = m.source_rows - m.valid_rows
    assert result.quarantine.count() == rejected + m.batch_conflicts + m.quarantine
    assert m.mergeable > 0 and m.stale > 0 and m.duplicate > 0 and m.quarantine > 0
    assert result.candidate.groupBy(*key).count().filter("count > 1").count() == 0
    # the same batch again finds nothing newer
    again = flows.silver_batch(t.v_feed, result.candidate, key, rules, at="2024-06-01")
    assert again.metrics.first().mergeable == 0
    assert again.candidate.exceptAll(result.candidate).count() == 0


def test_one_key_with_a_third_of_the_rows(spark):
    n = 60_000
    hot = spark.range(n).select(
        F.col("id").cast("string").alias("record_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("updated_at"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("ingested_at"),
        F.lit("b").alias("batch_id"),
        F.md5(F.col("id").cast("string")).alias("checksum"),
        F.lit(False).alias("is_deleted"),
    )
    winners = cdc.resolve_batch(hot, ["k"])
    assert winners.filter("k = 'hot'").first().record_id == str(n - 3)
    assert winners.count() == hot.select("k").distinct().count()


def test_rule_packs_have_their_size():
    assert (len(OUTCOME_RULES), len(SECTION_RULES)) == (17, 7)


def test_conflict_counter_leaves_out_null_keys(spark):
    df = feed(spark, ("a", None, T1, "x"), ("b", None, T1, "y"), ("c", "k", T1, "x"), ("d", "k", T1, "y"))
    result = flows.silver_batch(df, feed(spark), ["k"], at="2024-05-01")
    m = result.metrics.first()
    assert (m.batch_conflicts, m.deduplicated, result.quarantine.count()) == (2, 1, 2)


def test_columns_on_one_side_only(spark, rows):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, old string, v int")
    source = spark.createDataFrame([(2, 21, "n2"), (3, 31, "n3")], "k int, v int, new string")
    wanted = [(1, "a", 10, None), (2, "b", 21, "n2"), (3, None, 31, "n3")]
    assert rows(cdc.upsert(target, source, ["k"]), "k", "old", "v", "new") == wanted
    assert rows(cdc.merge_cdc(target, source, ["k"]), "k", "old", "v", "new") == wanted


def test_merge_newer_with_a_column_the_source_lacks(spark):
    target = feed(spark, ("t", "a", T1, "x")).withColumn("note", F.lit("kept"))
    merged = cdc.merge_newer(target, feed(spark, ("s", "a", T2, "y"), ("n", "b", T2, "y")), ["k"], at="2024-05-01")
    assert {r.record_id: r.note for r in merged.collect()} == {"s": "kept", "n": None}


def test_dedup_split_by_row_id(spark, rows):
    df = spark.createDataFrame([(1, "k", 5), (2, "k", 5), (3, "m", 1)], "id int, k string, v int")
    kept, discarded = cdc.dedup_split(df, ["k"], [F.desc("v")], row_id="id")
    assert (rows(kept, "id"), rows(discarded, "id")) == ([(1,), (3,)], [(2,)])


def test_both_sides_of_a_split_come_from_one_join(spark):
    df = feed(spark, ("a", "k", T1, "x"), ("b", "k", T1, "y"), ("c", "m", T1, "x"), ("d", None, T1, "x"), ("e", None, T1, "y"))
    flagged = cdc.flag_conflicts(df, ["k"])
    assert {r.id: r.rejection_reason for r in flagged.withColumnRenamed("record_id", "id").collect()} == {
        "a": cdc.EQUAL_TIME_CONFLICT, "b": cdc.EQUAL_TIME_CONFLICT, "c": None, "d": None, "e": None,
    }
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_counters_of_a_batch_are_observed_while_it_is_written(spark, monkeypatch):
    from strataforge.plans import flows

    df = feed(spark, ("a", "k", T1, "x"), ("b", "k", T1, "y"), ("c", "m", T1, "x"), ("d", "n", T2, "z"))
    result = flows.silver_batch(df, df.limit(0), ["k"], [("BAD", "k = 'n'")], at="2024-03-01")
    m = result.metrics.first().asDict()
    assert m == {"source_rows": 4, "valid_rows": 3, "batch_conflicts": 2, "deduplicated": 1, "mergeable": 1, "stale": 0, "duplicate": 0, "quarantine": 0, "unclassified": 0}
    assert "Scan" not in result.metrics._jdf.queryExecution().optimizedPlan().toString()  # figures, no further pass
    assert {(r.record_id, r.rejection_reason) for r in result.quarantine.collect()} == {("a", cdc.EQUAL_TIME_CONFLICT), ("b", cdc.EQUAL_TIME_CONFLICT), ("d", "BAD")}
    empty = flows.silver_batch(df.limit(0), df.limit(0), ["k"], at="2024-03-01")
    assert set(empty.metrics.first().asDict().values()) == {0} and empty.candidate.count() == 0
