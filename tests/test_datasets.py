import pytest
from pyspark.sql import functions as F

from strataforge.plans import datasets, flows
from strataforge.plans.catalog.files import document_bytes
from strataforge.session import scratch
from strataforge.sources.ledger import Ledger
from strataforge.sources.pages import unwrap
from strataforge.functions.checksum import row_checksum


@pytest.fixture()
def ledger(spark):
    return Ledger(spark, scratch(spark, "test-datasets"))


def documents(spark, *files):
    rows = [(name, bytearray(document_bytes(period, [("1", code, "x", "10", value, state)]))) for name, period, code, value, state in files]
    return spark.createDataFrame(rows, "path string, content binary")


def test_later_document_replaces_the_indicator(spark, ledger, rows):
    datasets.ingest_documents(documents(spark, ("a", "quý 1/2024", "ĐT-MT01", "5,5%", "đạt")), ledger, 4)
    datasets.ingest_documents(documents(spark, ("b", "quý 1/2024", "đt-mt01", "6%", "không đạt"), ("c", "quý 2/2024", "ĐT-MT01", "9%", "đạt")), ledger, 4)
    assert rows(ledger.live("kpi"), "indicator", "unit", "period", "value_num", "result") == [
        ("ĐT-MT01", "ĐT", "Q1/2024", 6.0, "FAILED"),
        ("ĐT-MT01", "ĐT", "Q2/2024", 9.0, "PASSED"),
    ]
    datasets.publish_kpi(ledger, {"ĐT": "Training"})
    forecast = ledger.live("kpi_forecast").first()
    assert (forecast.current_period, forecast.next_period, forecast.next_value) == ("Q2/2024", "Q3/2024", 13.5)
    assert ledger.live("kpi_detail").select("unit_label").distinct().first()[0] == "Training"


def test_documents_without_period_are_not_merged(spark, ledger):
    datasets.ingest_documents(documents(spark, ("a", "quý 1/2024", "ĐT-MT01", "5", "đạt")), ledger, 4)
    with pytest.raises(datasets.AuditFailure):
        datasets.ingest_documents(documents(spark, ("b", "no period", "ĐT-MT02", "5", "đạt")), ledger, 4)
    assert ledger.live("kpi").count() == 1


def outcome(spark, *rows):
    """(id, program, students, passed, attempted, day, deleted)"""
    full = [
        (i, p, p.upper(), "2024-2025", 1, s, passed, attempted, 30.0, 10, 0, 0, 5, 10, f"2024-01-{day:02d}", gone)
        for i, p, s, passed, attempted, day, gone in rows
    ]
    names = datasets.LEARNING_OUTCOMES.source_fields
    df = spark.createDataFrame(full, ", ".join(f"{n} {t}" for n, t in zip(names, "string string string string int bigint bigint bigint double bigint bigint bigint bigint bigint string boolean".split())))
    return df.withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def test_registered_outcomes(spark, ledger):
    first = outcome(spark, ("r1", "a", 20, 5, 10, 1, False), ("r2", "b", 20, 11, 10, 2, False), ("r3", "c", 20, 5, 10, 3, True))
    result = datasets.ingest(first, datasets.LEARNING_OUTCOMES, ledger, "2024-03-01", 4)
    m = result.metrics.first()
    assert (m.source_rows, m.valid_rows, m.mergeable, m.quarantine) == (3, 2, 1, 1)
    quarantine = datasets.quarantined(ledger, datasets.LEARNING_OUTCOMES)
    assert {(r._business_key, r.rejection_reason) for r in quarantine.collect()} == {
        ("b|2024-2025|1", "PASSED_EXCEEDS_ATTEMPTED"),
        ("c|2024-2025|1", "DELETE_WITHOUT_EXISTING_TARGET"),
    }
    assert datasets.ingest(first, datasets.LEARNING_OUTCOMES, ledger, "2024-03-01", 4) is None
    second = first.unionByName(outcome(spark, ("r4", "a", 20, 8, 10, 9, False)))
    datasets.ingest(second, datasets.LEARNING_OUTCOMES, ledger, "2024-03-02", 4)
    datasets.publish_outcomes(ledger)
    assert [(r.record_id, r.pass_rate) for r in ledger.live("outcome_fact").collect()] == [("r4", 80.0)]
    assert ledger.live("outcome_periods").first().programs == 1


def test_a_landed_batch_is_merged_after_a_failure(spark, ledger, monkeypatch):
    rows = outcome(spark, ("r1", "a", 20, 5, 10, 1, False), ("r2", "b", 20, 6, 10, 2, False))
    good = Ledger.merge_buckets

    def fail(*_args, **_more):
        raise RuntimeError("lost")

    monkeypatch.setattr(Ledger, "merge_buckets", fail)
    with pytest.raises(RuntimeError):
        datasets.ingest(rows, datasets.LEARNING_OUTCOMES, ledger, "2024-03-01", 4)
    monkeypatch.setattr(Ledger, "merge_buckets", good)
    more = rows.unionByName(outcome(spark, ("r3", "c", 20, 7, 10, 5, False)))
    datasets.ingest(more, datasets.LEARNING_OUTCOMES, ledger, "2024-03-02", 4)
    state = ledger.live("silver:education.learning_outcomes")
    assert {r.record_id for r in state.collect()} == {"r1", "r2", "r3"}
    assert datasets.ingest(more, datasets.LEARNING_OUTCOMES, ledger, "2024-03-02", 4) is None


def test_rows_without_time_are_refused_after_the_first_run(spark, ledger):
    df = spark.range(4).withColumn("ts", F.timestamp_seconds(F.col("id"))).withColumn("_record_checksum", row_checksum(["id"]))
    flows.incremental_load(df, "d", "ts", ledger, f"{ledger.root}/b")
    with pytest.raises(ValueError):
        flows.incremental_load(df.withColumn("ts", F.when(F.col("id") > 0, F.col("ts"))), "d", "ts", ledger, f"{ledger.root}/b")


def test_envelopes(spark, rows):
    bodies = ['{"data": {"x": 1}, "x": 7}', '{"data": [], "items": [{"x": 2}]}', '[{"x": 3}, {"x": 4}]', '{"x": 5}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert rows(unwrap(df, "body", "struct<x: int>")) == [(2,), (3,), (4,), (5,), (7,)]


def failing(times):
    """A gate that reports a failure so many times, then checks."""
    real, left = datasets.audit.check_grain, [times]

    def gate(df, key):
        left[0] -= 1
        return df.limit(1).select(F.lit("refused").alias("x")) if left[0] >= 0 else real(df, key)

    return gate


def test_a_retry_leaves_quarantine_and_state_as_an_undisturbed_run(spark, monkeypatch, rows):
    records = outcome(spark, ("r1", "a", 20, 5, 10, 1, False), ("r2", "b", 20, 11, 10, 2, False))
    seen, contract = [], datasets.LEARNING_OUTCOMES
    for failures in (0, 2):
        ledger = Ledger(spark, scratch(spark, "retry"))
        with monkeypatch.context() as patch:
            patch.setattr(datasets.audit, "check_grain", failing(failures))
            for _ in range(failures):
                with pytest.raises(datasets.AuditFailure):
                    datasets.ingest(records, contract, ledger, "2024-03-01", 4)
                assert datasets.quarantined(ledger, contract) is None and ledger.live(f"silver:{contract.dataset}") is None
            datasets.ingest(records, contract, ledger, "2024-03-01", 4)
        seen.append((rows(datasets.quarantined(ledger, contract), "_business_key", "rejection_reason"), rows(ledger.live(f"silver:{contract.dataset}"), "record_id")))
    assert seen[0] == seen[1] and len(seen[0][0]) == 1


def test_a_failure_between_gate_and_commit_does_not_double_the_quarantine(spark, ledger, monkeypatch):
    records = outcome(spark, ("r1", "a", 20, 5, 10, 1, False), ("r2", "b", 20, 11, 10, 2, False))
    contract, commit = datasets.LEARNING_OUTCOMES, Ledger.commit

    def lost(self, expected, tables=None, tags=None, state=None):
        if tables:
            raise RuntimeError("lost")
        return commit(self, expected, tables, tags, state)

    monkeypatch.setattr(Ledger, "commit", lost)
    with pytest.raises(RuntimeError):
        datasets.ingest(records, contract, ledger, "2024-03-01", 4)
    assert datasets.quarantined(ledger, contract) is None  # written, but not of a published batch
    monkeypatch.setattr(Ledger, "commit", commit)
    datasets.ingest(records, contract, ledger, "2024-03-01", 4)
    assert datasets.quarantined(ledger, contract).count() == 1


def test_a_batch_that_never_passes_can_be_set_aside(spark, ledger, monkeypatch, rows):
    contract = datasets.LEARNING_OUTCOMES
    first = outcome(spark, ("r1", "a", 20, 5, 10, 1, False))
    with monkeypatch.context() as patch:
        patch.setattr(datasets.audit, "check_grain", failing(1))
        with pytest.raises(datasets.AuditFailure):
            datasets.ingest(first, contract, ledger, "2024-03-01", 4)
    batch = datasets.set_aside(contract, ledger, "GATE_FAILED", "2024-03-02")
    assert batch and datasets.set_aside(contract, ledger, "GATE_FAILED", "2024-03-02") is None
    assert rows(datasets.quarantined(ledger, contract), "rejection_reason", "_batch") == [("GATE_FAILED", batch)]
    datasets.ingest(first.unionByName(outcome(spark, ("r2", "b", 20, 6, 10, 3, False))), contract, ledger, "2024-03-03", 4)
    assert rows(ledger.live(f"silver:{contract.dataset}"), "record_id") == [("r2",)]


def test_a_damaged_value_beside_an_intact_checksum_is_refused(spark, tmp_path):
    from strataforge.sources import sinks

    rows = spark.range(100).select("id", F.concat(F.lit("v"), "id").alias("v"), F.create_map(F.lit("k"), "id").alias("m"))
    stamped = rows.withColumn("_record_checksum", row_checksum(["id", "v"])).withColumn("_batch_id", F.lit("b1"))
    landed = sinks.land_bronze(stamped, str(tmp_path / "good"), "b1")
    assert landed.rows == 100
    for change in (F.when(F.col("id") == 7, "other").otherwise(F.col("v")), F.when(F.col("id") != 7, F.col("v"))):
        folder = str(tmp_path / f"bad{abs(hash(str(change)))}")
        stamped.withColumn("v", change).write.partitionBy("_batch_id").parquet(folder)
        with pytest.raises(sinks.LandingMismatch):
            sinks.verify_landed(spark, folder, "b1", stamped.schema, landed.rows, landed.fingerprint)
