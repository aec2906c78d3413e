import os

import pytest
from pyspark.sql import functions as F

from strataforge.functions.checksum import row_checksum
from strataforge.operators import audit, incremental
from strataforge.operators.cdc import upsert
from strataforge.plans import flows
from strataforge.session import release_staged, scratch, staged
from strataforge.sources import sinks
from strataforge.sources.ledger import GateFailure, Ledger, VersionConflict
from strataforge.streaming import land


@pytest.fixture()
def ledger(spark):
    return Ledger(spark, scratch(spark, "test-ledger"))


def table(spark, n, start=0):
    return spark.range(start, start + n).withColumn("v", F.col("id") * 2)


def nonempty(df):
    return audit.row_checks(df, [], "rows", only_failing=False).withColumnRenamed("failure_count", "failures")


def test_empty_ledger(ledger):
    assert ledger.head()["version"] == 0 and ledger.live("t") is None


def test_replace_keeps_other_tables(spark, ledger):
    ledger.replace("a", table(spark, 3))
    ledger.replace("b", table(spark, 5))
    ledger.replace("a", table(spark, 4))
    assert (ledger.live("a").count(), ledger.live("b").count(), ledger.head()["version"]) == (4, 5, 3)


def test_a_second_writer_is_refused(ledger):
    ledger.commit(0, {"t": "x"})
    with pytest.raises(VersionConflict):
        ledger.commit(0, {"t": "y"})
    assert ledger.head()["tables"] == {"t": "x"}


def test_a_writer_that_read_too_early_is_refused(ledger, monkeypatch):
    early = ledger.head()
    ledger.commit(0, {"t": "x"})
    monkeypatch.setattr(ledger, "head", lambda: early)
    with pytest.raises(VersionConflict):
        ledger.commit(0, {"t": "y"})
    monkeypatch.undo()
    assert ledger.head()["version"] == 1 and ledger.head()["tables"] == {"t": "x"}


def test_a_writer_that_dies_blocks_nobody(ledger, monkeypatch):
    def dies(*_):
        raise RuntimeError("lost before the rename")

    monkeypatch.setattr("strataforge.sources.ledger.rename_new", dies)
    with pytest.raises(RuntimeError):
        ledger.commit(0, {"t": "x"})
    monkeypatch.undo()
    assert ledger.head()["version"] == 0 and ledger.commit(0, {"t": "y"}) == 1


def test_failed_gate_keeps_the_live_version_and_the_candidate(spark, ledger):
    ledger.write_audit_publish("t", table(spark, 3), nonempty)
    with pytest.raises(GateFailure) as refused:
        ledger.write_audit_publish("t", table(spark, 0), nonempty)
    assert refused.value.failures == {"rows": 1}
    assert spark.read.parquet(refused.value.path).count() == 0
    assert ledger.live("t").count() == 3


def test_bundle_with_changed_source_is_refused(spark, ledger):
    ledger.replace("source", table(spark, 3))
    seen = {"source": ledger.head()["tables"]["source"]}
    bundle = ledger.prepare_bundle({"a": table(spark, 1), "b": table(spark, 2)})
    ledger.replace("source", table(spark, 4))
    with pytest.raises(VersionConflict):
        ledger.publish_bundle(bundle, seen)
    assert ledger.live("a") is None and ledger.live("b") is None


def test_tag_is_fixed(spark, ledger):
    ledger.replace("a", table(spark, 3))
    ledger.tag("first")
    ledger.replace("a", table(spark, 9))
    ledger.tag("first")
    assert ledger.read_at("a", "first").count() == 3


def events(spark, start, n):
    rows = spark.range(start, start + n).withColumn("ts", F.timestamp_seconds(F.col("id") + 1_700_000_000))
    return rows.withColumn("_record_checksum", row_checksum(["id"]))


def test_incremental_runs(spark, ledger):
    path = f"{ledger.root}/bronze"
    run = lambda df: flows.incremental_load(df, "d", "ts", ledger, path)
    assert run(events(spark, 0, 100))[0] == "COMMITTED"
    assert run(events(spark, 0, 100)) == ("NO_CHANGE", None)
    status, landed = run(events(spark, 0, 120))
    assert (status, landed.rows) == ("COMMITTED", 20)
    back = spark.read.parquet(path)
    assert back.count() == 120 and back.select("_batch_id").distinct().count() == 2


def test_failed_landing_does_not_move_the_watermark(spark, ledger, monkeypatch):
    path = f"{ledger.root}/bronze"
    flows.incremental_load(events(spark, 0, 100), "d", "ts", ledger, path)
    before = ledger.head()
    land_bronze = flows.land_bronze

    def broken(*args, **kwargs):
        land_bronze(*args, **kwargs)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(flows, "land_bronze", broken)
    with pytest.raises(RuntimeError):
        flows.incremental_load(events(spark, 0, 130), "d", "ts", ledger, path)
    assert ledger.head() == before
    monkeypatch.setattr(flows, "land_bronze", land_bronze)
    _, landed = flows.incremental_load(events(spark, 0, 130), "d", "ts", ledger, path)
    assert landed.rows == 30 and spark.read.parquet(path).count() == 130


def test_other_strategy_is_refused(spark, ledger):
    ledger.commit(0, state={"checkpoint:d": {"strategy": "sequence", "payload": {"value": "1"}}})
    with pytest.raises(flows.StrategyMismatch):
        flows.incremental_load(events(spark, 0, 10), "d", "ts", ledger, f"{ledger.root}/bronze")


def test_missing_times_are_refused(spark, ledger):
    df = events(spark, 0, 10).withColumn("ts", F.when(F.col("id") != 4, F.col("ts")))
    with pytest.raises(ValueError):
        flows.incremental_load(df, "d", "ts", ledger, f"{ledger.root}/bronze")


def test_empty_batch_is_refused(spark, ledger):
    with pytest.raises(ValueError):
        sinks.land_bronze(events(spark, 0, 0).withColumn("_batch_id", F.lit("b")), f"{ledger.root}/b", "b")


def test_batch_names(spark):
    df = spark.createDataFrame([("d", None), ("d", "2024-01-01T00:00:00Z")], "dataset string, mark string")
    strategy = F.when(F.col("mark").isNotNull(), "timestamp")
    found = [r[0] for r in df.select(incremental.batch_identity(F.col("dataset"), strategy, F.col("mark"))).collect()]
    assert found == [incremental.batch_id("d", None, None), incremental.batch_id("d", "timestamp", {"value": "2024-01-01T00:00:00Z"})]


def test_pages_cover_all_rows_once(spark):
    df = spark.range(95).select("id")
    paged = [r.id for p in range(1, 11) for r in incremental.paginate(df, ["id"], "page", p, 10).collect()]
    last, walked = [-1], []
    while page := [r.id for r in incremental.page_after(df, ["id"], last, 10).collect()]:
        walked += page
        last = [page[-1]]
    assert paged == walked == list(range(95))
    with pytest.raises(ValueError):
        incremental.paginate(df, ["id"], "page", 2, 10, seen=[1, 2])


def test_repeated_micro_batch_is_skipped(spark, ledger):
    source, checkpoint = f"{ledger.root}/in", f"{ledger.root}/c1"
    events(spark, 0, 10).write.parquet(source)
    step = lambda batch, state: state.unionByName(batch)
    schema = events(spark, 0, 1).schema
    land.stream_upsert(spark, source, checkpoint, schema, ledger, "t", ["id"], step, buckets=4)
    version = ledger.head()["version"]
    # the stream stopped after the publication, before it noted the end of the micro-batch
    commits = checkpoint.removeprefix("file:") + "/commits"
    for name in os.listdir(commits):
        os.remove(f"{commits}/{name}")
    land.stream_upsert(spark, source, checkpoint, schema, ledger, "t", ["id"], step, buckets=4)
    assert ledger.head()["version"] == version and ledger.live("t").count() == 10
    # a new checkpoint folder reads everything again
    merge = lambda batch, state: upsert(state, batch, ["id"])
    land.stream_upsert(spark, source, f"{ledger.root}/c2", schema, ledger, "t", ["id"], merge, buckets=4)
    assert ledger.head()["version"] == version + 1 and ledger.live("t").count() == 10


def test_release_removes_only_staged_tables(spark, ledger):
    ledger.replace("a", table(spark, 3))
    release_staged(spark)
    first = staged(table(spark, 3), "test")
    assert first.count() == 3 and release_staged(spark) == 1
    assert not sinks.exists(spark, first.inputFiles()[0]) and ledger.live("a").count() == 3


def test_merge_rewrites_only_touched_buckets(spark, ledger, rows):
    def step(changes, state):
        return upsert(state, changes, ["id"])

    ledger.merge_buckets("t", ["id"], table(spark, 1000), step, buckets=32)
    before = ledger.head()["tables"]["t"]
    assert len(before) == 32
    changes = spark.createDataFrame([(5, -1), (2000, -2)], "id long, v long")
    ledger.merge_buckets("t", ["id"], changes, step, buckets=7)
    after = ledger.head()["tables"]["t"]
    moved = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(moved) <= 2 and set(after) == set(before)
    wanted = upsert(table(spark, 1000), changes, ["id"])
    assert rows(ledger.live("t"), "id", "v") == rows(wanted, "id", "v")


def test_bucket_that_loses_its_rows(spark, ledger):
    ledger.merge_buckets("t", ["id"], table(spark, 1), lambda c, s: s.unionByName(c), buckets=4)
    ledger.merge_buckets("t", ["id"], table(spark, 1), lambda c, s: s.limit(0), buckets=4)
    assert ledger.live("t") is None


def test_added_columns_are_read_from_all_buckets(spark):
    ledger = Ledger(spark, scratch(spark, "test-columns"))
    keep = lambda changes, live: changes.unionByName(live.join(changes.select("k"), "k", "left_anti"), allowMissingColumns=True)
    ledger.merge_buckets("t", ["k"], spark.createDataFrame([(i, i) for i in range(40)], "k int, v int"), keep, 16)
    ledger.merge_buckets("t", ["k"], spark.createDataFrame([(1, 1, "new")], "k int, v int, w string"), keep, 16)
    live = ledger.live("t")
    assert "w" in live.columns and live.where("w IS NOT NULL").count() == 1 and live.count() == 40
