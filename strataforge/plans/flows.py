"""Compositions of operators: registered and generic batches, incremental loads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, functions as F

from strataforge.functions.checksum import with_row_checksum, with_surrogate_key
from strataforge.functions.frames import side_by_side
from strataforge.operators import cdc
from strataforge.operators.incremental import batch_id as name_batch, next_watermark
from strataforge.operators.quality import REASONS, add_reasons
from strataforge.operators.schema import apply_mapping, evolve, standardize_columns
from strataforge.operators.star import Roles
from strataforge.session import staged
from strataforge.sources.ledger import Ledger
from strataforge.sources.sinks import LandResult, land_bronze, observed


@dataclass(frozen=True)
class BatchResult:
    candidate: DataFrame  # new state of the table
    quarantine: DataFrame  # all rejected rows with their reason
    metrics: DataFrame  # one row of counters
    classes: DataFrame  # deduplicated rows with their class


def silver_batch(
    feed: DataFrame,
    target: DataFrame,
    key: Sequence[str],
    rules: Sequence[tuple[str, str]] = (),
    updated: str = "updated_at",
    checksum: str = "checksum",
    deleted: str | None = "is_deleted",
    at=None,
    stage: bool = True,
    **order: str,
) -> BatchResult:
    """Quality split, conflict split, dedup, comparison with the state, merge and counters.

    With ``stage`` the conflicting keys and the classified rows, one per key, are
    written to the shared folder once; quarantine and merge read them from there, and
    all counters are observed while those two are written.  The rejected rows of both
    splits come from one more scan of the feed.
    """
    columns = list(feed.columns)
    count = F.count(F.lit(1))
    marked = add_reasons(feed, rules)
    valid = marked.filter(F.size(REASONS) == 0).select(*columns)
    known_key = reduce(and_, [F.col(k).isNotNull() for k in key])  # rows without key are never in conflict

    def of(name: str):
        return F.count(F.when(F.col("row_class") == name, 1)).alias(name)

    feed_figures = [count.alias("source_rows"), F.count(F.when(F.size(REASONS) == 0, 1)).alias("valid_rows")]
    bad_figures = [F.coalesce(F.sum(F.when(known_key, F.col("_rows"))), F.lit(0)).alias("batch_conflicts")]
    class_figures = [count.alias("deduplicated"), *[of(c) for c in ("mergeable", "stale", "duplicate", "quarantine", "unclassified")]]

    def classified(bad: DataFrame) -> DataFrame:
        return cdc.classify(cdc.resolve_batch(valid, key, updated, checksum=checksum, conflicts=bad, **order), target, key, updated, checksum, deleted)

    if stage:
        seen = [Observation(), Observation(), Observation()]
        counted = marked.observe(seen[0], *feed_figures).filter(F.size(REASONS) == 0).select(*columns)
        bad = staged(cdc.key_conflicts(counted, key, updated, checksum).observe(seen[1], *bad_figures), "conflicts")
        classes = staged(classified(bad).observe(seen[2], *class_figures), "classes")
        names = ["source_rows", "valid_rows", "batch_conflicts", "deduplicated", "mergeable", "stale", "duplicate", "quarantine", "unclassified"]
        figures = dict.fromkeys(names, 0)  # a plan known to be empty observes nothing
        for part in seen:
            figures |= observed(part)
        metrics = feed.sparkSession.range(1).select(*[F.lit(v).cast("bigint").alias(n) for n, v in figures.items()])
    else:
        bad = cdc.key_conflicts(valid, key, updated, checksum)
        classes = classified(bad)
        metrics = side_by_side(marked.agg(*feed_figures), bad.agg(*bad_figures), classes.agg(*class_figures))
    # rows that fail a rule may share a key with a conflict: the rule comes first
    flagged = cdc.flag_conflicts(marked, key, conflicts=bad)
    reason = F.when(F.size(REASONS) > 0, F.concat_ws("|", REASONS)).otherwise(F.col("rejection_reason"))
    refused = flagged.withColumn("rejection_reason", reason).filter("rejection_reason IS NOT NULL").select(*columns, "rejection_reason")
    blocked = classes.filter("row_class = 'quarantine'").select(*columns, "rejection_reason")
    quarantine = refused.unionByName(blocked)
    # classification has compared these rows with the state, so they replace or enter
    mergeable = classes.filter("row_class = 'mergeable'").select(*columns)
    state = target if "_silver_updated_at" in target.columns else cdc.written_at(target, None)
    candidate = cdc.upsert(state, cdc.written_at(mergeable, at), key)
    return BatchResult(candidate, quarantine, metrics, classes)


def generic_batch(
    raw: DataFrame, roles: Roles, target: DataFrame | None, ingested_at, mapping: dict | None = None
) -> BatchResult:
    """A file without contract: names, keys or row hash, change time, checksum, then as for any batch.

    Rows with a NULL in their key go to quarantine: they could never be found again.
    """
    df = apply_mapping(standardize_columns(raw), mapping or {})
    key = [k for k in roles.keys if k in df.columns]
    if not key:
        df, key = with_surrogate_key(df, "_surrogate_row_id"), ["_surrogate_row_id"]
    updated = roles.updated_at
    if not updated or updated not in df.columns:
        updated = "_source_updated_at"
        df = df.withColumn(updated, F.lit(ingested_at).cast("timestamp"))
    df = with_row_checksum(df, updated)
    order = dict(ingested=updated, batch=updated, record="_record_checksum")
    state = target if target is not None else df.limit(0)
    rules = [("MISSING_KEY", " OR ".join(f"`{k}` IS NULL" for k in key))]
    result = silver_batch(
        df, evolve(state, df), key, rules, updated, "_record_checksum", None, ingested_at, **order
    )
    repeats = result.metrics.withColumn(
        "repeated", F.col("valid_rows") - F.col("batch_conflicts") - F.col("deduplicated")
    )
    return BatchResult(result.candidate, result.quarantine, repeats, result.classes)


class StrategyMismatch(RuntimeError):
    """The stored checkpoint was written under another strategy."""


STRATEGY = "timestamp"


def incremental_load(
    source: DataFrame, dataset: str, ts: str, ledger: Ledger, path: str
) -> tuple[str, LandResult | None]:
    """Land the rows after the stored watermark; move the watermark only after the landing was verified.

    The batch is named after the checkpoint it starts from, so a repeat after a
    failure replaces the same partition.
    """
    head = ledger.head()
    stored = head["state"].get(f"checkpoint:{dataset}")
    if stored and stored["strategy"] != STRATEGY:
        raise StrategyMismatch(f"{dataset}: {stored['strategy']}")
    after = stored["payload"]["value"] if stored else None
    at = F.col(ts)
    rows = source if after is None else source.filter(at.isNull() | (at > F.lit(after).cast("timestamp")))
    text = F.date_format("watermark", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    found = next_watermark(rows, ts, after).withColumn("watermark", text).first()
    if found["state"] == "NO_CHANGE":
        return "NO_CHANGE", None
    if found["state"] == "REJECTED":
        raise ValueError(f"{dataset}: no safe watermark in {found.asDict()}")
    batch = name_batch(dataset, stored["strategy"] if stored else None, stored["payload"] if stored else None)
    # rows later than the watermark just read wait for the next run
    fixed = rows.filter(at <= F.lit(found["watermark"]).cast("timestamp")).withColumn("_batch_id", F.lit(batch))
    landed = land_bronze(fixed, path, batch)
    payload = {"value": found["watermark"]}
    ledger.commit(
        head["version"],
        state={f"checkpoint:{dataset}": {"strategy": STRATEGY, "payload": payload, "last_batch": batch}},
    )
    return "COMMITTED", landed
