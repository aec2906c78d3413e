"""Contracts of the registered datasets, and their flows from records to published marts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from strataforge.functions import text
from strataforge.operators import audit, cdc, marts
from strataforge.operators.quality import OUTCOME_RULES, SECTION_RULES, to_quarantine
from strataforge.operators.schema import Contract, stamp, to_canonical
from strataforge.plans.flows import BatchResult, incremental_load, silver_batch
from strataforge.session import staged
from strataforge.sources.documents import failed_documents, read_documents, table_rows
from strataforge.sources.files import read_batch
from strataforge.sources.ledger import Ledger
from strataforge.sources.sinks import append_quarantine, replace_quarantine

_TYPES = {"text": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "time": T.TimestampType(), "flag": T.BooleanType()}


def _fields(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in kinds.items()])


LEARNING_OUTCOMES = Contract(
    dataset="education.learning_outcomes",
    schema_version="2.0",
    source=_fields(
        record_id="text", program_code="text", program_name="text", academic_year="text", semester="int",
        student_count="long", passed_course_count="long", attempted_course_count="long", gpa_point_sum="double",
        gpa_student_count="long", warning_student_count="long", dropout_risk_student_count="long",
        on_track_student_count="long", progress_evaluated_student_count="long", updated_at="time", is_deleted="flag",
    ),
    canonical={
        "program_code": "program", "student_count": "students", "passed_course_count": "passed",
        "attempted_course_count": "attempted", "gpa_point_sum": "gpa_points", "gpa_student_count": "gpa_students",
        "warning_student_count": "warning_students", "dropout_risk_student_count": "dropout_students",
        "on_track_student_count": "on_track", "progress_evaluated_student_count": "evaluated",
    },
    key=("program", "academic_year", "semester"),
    record_id="record_id",
    updated_at="updated_at",
    deleted="is_deleted",
    rules=OUTCOME_RULES,
)

TEACHING_PROGRESS = Contract(
    dataset="education.teaching_progress",
    schema_version="1.0-demo",
    source=_fields(
        record_id="text", unit_code="text", unit_name="text", course_section_code="text", academic_year="text",
        semester="int", progress_percent="double", updated_at="time",
    ),
    canonical={"course_section_code": "section_code", "progress_percent": "progress_pct"},
    key=("section_code", "academic_year", "semester"),
    record_id="record_id",
    updated_at="updated_at",
    rules=SECTION_RULES,
)


class AuditFailure(RuntimeError):
    """Marts that do not agree with their source; nothing was published."""


def _refuse(name: str, findings: DataFrame) -> None:
    found = findings.limit(5).collect()
    if found:
        raise AuditFailure(f"{name}: {found}")


def ingest(records: DataFrame, contract: Contract, ledger: Ledger, at, buckets: int = 256) -> BatchResult | None:
    """Land the new records of a source and merge them into the current state; None when there are none.

    The commit that publishes the state also names the batch merged.  A batch that
    was landed but not merged, as its merge failed, is merged first on the next run;
    ``set_aside`` gives up a batch whose gate can never pass.  The state is published
    only when its gate passes.  Rejected rows are written under the batch's name after
    the gate, and ``quarantined`` shows those of published batches only, so however
    often a batch is tried, its rows are there once.
    """
    pending = _pending(ledger, contract.dataset)
    resumed = _merge(pending, contract, ledger, at, buckets) if pending else None
    bronze = f"{ledger.root}/bronze/{contract.dataset}"
    stamped = stamp(records, contract, "", at, mode="INCREMENTAL").drop("_batch_id")
    status, landed = incremental_load(stamped, contract.dataset, contract.updated_at, ledger, bronze)
    if status == "NO_CHANGE":
        return resumed
    return _merge(landed.batch_id, contract, ledger, at, buckets)


def _pending(ledger: Ledger, dataset: str) -> str | None:
    """The batch that was landed last, unless it has been merged."""
    state = ledger.head()["state"]
    landed = (state.get(f"checkpoint:{dataset}") or {}).get("last_batch")
    return landed if landed != state.get(f"merged:{dataset}") else None


def _merge(batch_id: str, contract: Contract, ledger: Ledger, at, buckets: int) -> BatchResult:
    """Merge one landed batch; state and name of the batch are published in one commit."""
    bronze, silver = f"{ledger.root}/bronze/{contract.dataset}", f"silver:{contract.dataset}"
    key = list(contract.key)
    batch = to_canonical(read_batch(ledger.spark, bronze, batch_id, contract), contract)
    results: list[BatchResult] = []

    def step(feed: DataFrame, state: DataFrame) -> DataFrame:
        result = silver_batch(
            feed, state, key, contract.rules, contract.updated_at, "_record_checksum", contract.deleted, at,
            ingested="_ingested_at", batch="_batch_id", record=contract.record_id,
        )
        _refuse("state", audit.check_grain(result.candidate, key))
        columns = [c for c in feed.columns if c != "rejection_reason"]
        replace_quarantine(to_quarantine(result.quarantine, key, columns, at), _quarantine(ledger, contract), batch_id)
        results.append(result)
        return result.candidate

    ledger.merge_buckets(silver, key, batch, step, buckets, state=_merged(ledger, contract, batch_id))
    return results[0]


def _quarantine(ledger: Ledger, contract: Contract) -> str:
    return f"{ledger.root}/quarantine/{contract.dataset}"


def _merged(ledger: Ledger, contract: Contract, batch_id: str) -> dict:
    """What the commit of a batch says: the batch merged last, and all whose quarantine counts."""
    published = f"quarantine:{contract.dataset}"
    earlier = ledger.head()["state"].get(published) or []
    return {f"merged:{contract.dataset}": batch_id, published: [*earlier, batch_id]}


def quarantined(ledger: Ledger, contract: Contract) -> DataFrame | None:
    """Rejected rows of the published batches, with their ``_batch``; None before the first."""
    batches = ledger.head()["state"].get(f"quarantine:{contract.dataset}")
    if not batches:
        return None
    path = _quarantine(ledger, contract)
    return ledger.spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*[f"{path}/_batch={b}" for b in batches])


def set_aside(contract: Contract, ledger: Ledger, reason: str, at) -> str | None:
    """Give up the landed batch that has not been merged: all its rows go to the quarantine, later batches go on.

    Returns the batch, or None when none waits.
    """
    batch_id = _pending(ledger, contract.dataset)
    if batch_id is None:
        return None
    version = ledger.head()["version"]
    rows = to_canonical(read_batch(ledger.spark, f"{ledger.root}/bronze/{contract.dataset}", batch_id, contract), contract)
    rejected = to_quarantine(rows.withColumn("rejection_reason", F.lit(reason)), list(contract.key), rows.columns, at)
    replace_quarantine(rejected, _quarantine(ledger, contract), batch_id)
    ledger.commit(version, state=_merged(ledger, contract, batch_id))
    return batch_id


def publish_outcomes(ledger: Ledger) -> int:
    """Build fact and period mart of the learning outcomes, audit both, and publish them together."""
    state = ledger.live(f"silver:{LEARNING_OUTCOMES.dataset}")
    fact = marts.outcome_fact(state)
    mart = marts.period_mart(fact)
    names = [r[0] for r in marts.OUTCOME_RATIOS]
    bundle = ledger.prepare_bundle({"outcome_fact": fact, "outcome_periods": mart})
    built = {name: ledger.spark.read.parquet(path) for name, path in bundle["paths"].items()}
    active = marts.filter_active(state)
    ratios = [
        (f"{n}_formula", audit.ratio_differs(n, part, whole, scale if scale is not None else 1.0))
        for n, part, whole, scale in marts.OUTCOME_RATIOS
    ]
    ranges = [(f"{n}_range", audit.outside(n, 0, None if n == "gpa_mean" else 100)) for n in names]
    _refuse("grain", audit.check_grain(built["outcome_fact"], LEARNING_OUTCOMES.key))
    _refuse("rows", audit.row_checks(built["outcome_fact"], [*ranges, *ratios], "nonempty"))
    _refuse("counts", audit.reconcile_counts(active, built["outcome_fact"]).filter("NOT passed"))
    _refuse("lineage", audit.lineage_diff(built["outcome_fact"], active, "record_id", ["updated_at", "_batch_id", "_record_checksum"]))
    stored = {f"previous_{n}": n for n in names}
    _refuse("periods", audit.check_periods(built["outcome_fact"], ["program"], ["start_year", "semester"], stored, {}))
    expected = marts.period_mart(marts.with_ratios(active))
    _refuse(
        "periods mart",
        audit.reconcile_aggs(
            built["outcome_periods"], expected, ["academic_year", "semester"],
            ["programs", "passed", "attempted", "gpa_students", "on_track", "evaluated"], ["gpa_points", *names],
        ),
    )
    return ledger.publish_bundle(bundle)


def publish_sections(ledger: Ledger) -> int:
    """Build, audit and publish the section fact of the teaching progress."""
    state = ledger.live(f"silver:{TEACHING_PROGRESS.dataset}")
    lineage = {"source_record_id": "record_id", "source_updated_at": "updated_at", "source_batch_id": "_batch_id", "source_record_checksum": "_record_checksum"}
    passthrough = ["unit_code", "unit_name", "section_code", "academic_year", "semester", "progress_pct"]
    bundle = ledger.prepare_bundle({"section_fact": marts.section_fact(state, passthrough, lineage)})
    built = ledger.spark.read.parquet(bundle["paths"]["section_fact"])
    _refuse("grain", audit.check_grain(built, TEACHING_PROGRESS.key))
    checks = [("range", audit.outside("progress_pct", required=True)), ("monitored", "monitored IS NULL OR monitored <> 1")]
    _refuse("rows", audit.row_checks(built, checks))
    _refuse("counts", audit.reconcile_counts(state, built).filter("NOT passed"))
    return ledger.publish_bundle(bundle)


def kpi_rows(read: DataFrame) -> DataFrame:
    """Indicator rows of opened documents with normalised unit, period, state and numbers.

    The period of a document is the most frequent one of its rows.
    """
    rows = staged(table_rows(read), "document-rows")  # used twice
    periods = marts.dominant_period(rows, "path", text.normalize_period(F.col("period")))
    return rows.drop("period").join(periods.select("path", "period"), "path").select(
        F.upper("code").alias("indicator"),
        text.unit_from_code(F.col("code")).alias("unit"),
        "period",
        "description",
        "frequency",
        "planned",
        "achieved",
        text.parse_number(F.col("planned")).alias("planned_num"),
        text.parse_number(F.col("achieved")).alias("value_num"),
        text.normalize_status(F.col("result")).alias("result"),
        "cause",
        "action",
        F.col("path").alias("source_file"),
        "row_no",
    )


KPI_KEY = ["indicator", "period"]


def ingest_documents(documents: DataFrame, ledger: Ledger, buckets: int = 256) -> None:
    """Merge the indicator rows of documents into the KPI state; the last row of the latest file wins.

    Documents that cannot be read are listed in ``quarantine/documents`` with the reason.
    """
    latest = [F.desc("source_file"), F.desc("row_no")]
    read = staged(read_documents(documents), "documents")
    append_quarantine(failed_documents(read), f"{ledger.root}/quarantine/documents")
    fresh = cdc.first_per_key(kpi_rows(read), KPI_KEY, latest)

    def step(rows: DataFrame, state: DataFrame) -> DataFrame:
        candidate = cdc.upsert(state, rows, KPI_KEY)
        gate = audit.gate_silver(candidate, KPI_KEY, ["indicator", "result"], "period", text.UNKNOWN_PERIOD)
        _refuse("kpi", gate.filter("failures > 0"))
        return candidate

    ledger.merge_buckets("kpi", KPI_KEY, fresh, step, buckets)


def publish_kpi(ledger: Ledger, labels: Mapping[str, str] | DataFrame) -> int:
    """Summary with scores, detail, comparison, dictionary and forecast, published together."""
    state = ledger.live("kpi")
    compared = staged(marts.compare_periods(state), "compared")
    detail = marts.kpi_detail(state, state.columns, "unit", labels)
    frames = {
        "kpi_summary": marts.decision_fields_kpi(marts.kpi_summary(state)),
        "kpi_detail": detail,
        "kpi_comparison": marts.lookup(compared, "unit", labels, "unit_label"),
        "kpi_dictionary": marts.lookup(marts.indicator_dictionary(state), "unit", labels, "unit_label"),
        "kpi_forecast": marts.forecast(compared),
    }
    bundle = ledger.prepare_bundle(frames)
    summary, built = (ledger.spark.read.parquet(bundle["paths"][n]) for n in ("kpi_summary", "kpi_detail"))
    _refuse("kpi marts", audit.gate_gold(summary, built, "completion_pct").filter("failures > 0"))
    return ledger.publish_bundle(bundle)
