"""Duplicates, conflicts, comparison with the current state, and merging.

All per-key choices reduce rows before they are shuffled: first-row choices use
a ranked filter that Spark applies on both sides of the exchange, and the other
steps use aggregates with partial combination.  A key that holds a large share
of the rows therefore does not end up whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataforge.functions.checksum import row_checksum
from strataforge.functions.frames import side_by_side
from strataforge.functions.windows import join_nullsafe
from strataforge.session import staged

# Reasons, and the mark for a missing checksum.
EQUAL_TIME_CONFLICT = "EQUAL_TIMESTAMP_DIFFERENT_CHECKSUM"
DELETE_WITHOUT_TARGET = "DELETE_WITHOUT_EXISTING_TARGET"
NULL_CHECKSUM = "__NULL_CHECKSUM__"

# Change columns, the strongest first.
CHANGE_COLUMNS = (
    "_airbyte_extracted_at",
    "airbyte_extracted_at",
    "_ab_cdc_updated_at",
    "ab_cdc_updated_at",
    "updated_at",
    "modified_at",
    "_ab_cdc_lsn",
    "ab_cdc_lsn",
)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key.  Spark keeps at most one row per key and task before the exchange."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def feed_order(updated: str, ingested: str, batch: str, checksum: str, record: str) -> list[Column]:
    return [
        F.col(updated).desc_nulls_last(),
        F.col(ingested).desc_nulls_last(),
        F.col(batch).desc_nulls_last(),
        F.col(checksum).asc_nulls_last(),
        F.col(record).asc_nulls_last(),
    ]


def dedup(
    df: DataFrame,
    key: Sequence[str],
    updated: str = "updated_at",
    ingested: str = "ingested_at",
    batch: str = "batch_id",
    checksum: str = "checksum",
    record: str = "record_id",
) -> DataFrame:
    """Newest row per key: change time, ingest time and batch descending, checksum and id ascending."""
    return first_per_key(df, key, feed_order(updated, ingested, batch, checksum, record))


def dedup_split(
    df: DataFrame, key: Sequence[str], order: Sequence[Column], row_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded); the two together are the input, copies included.

    Rows are told apart by ``row_id``.  Without one they are written once with a
    number each, so that even a large group of equal rows stays spread over tasks.
    """
    if row_id is None:
        tagged, uid = staged(df.withColumn("_uid", F.monotonically_increasing_id()), "numbered"), "_uid"
    else:
        tagged, uid = df, row_id
    kept = first_per_key(tagged, key, [*order, F.col(uid)])
    discarded = tagged.join(kept.select(uid), uid, "left_anti").select(*df.columns)
    return kept.select(*df.columns), discarded


def dedup_latest(df: DataFrame, keys: Sequence[str], tie_break: Sequence[str] = ()) -> DataFrame:
    """Newest row by whichever change columns exist; ties go to ``tie_break`` or the largest row hash."""
    if not keys:
        return df
    order = [F.col(c).desc_nulls_last() for c in CHANGE_COLUMNS if c in df.columns]
    order += [F.col(c).desc_nulls_last() for c in tie_break] or [row_checksum(sorted(df.columns)).desc()]
    return first_per_key(df, keys, order)


def key_conflicts(
    df: DataFrame, key: Sequence[str], updated: str = "updated_at", checksum: str = "checksum"
) -> DataFrame:
    """Keys with two different checksums at one change time, and the number of their rows.

    A missing checksum counts as a value.  Both steps combine partially.
    """
    value = F.coalesce(F.col(checksum), F.lit(NULL_CHECKSUM))
    return (
        df.groupBy(*key, updated)
        .agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("_n"))
        .groupBy(*key)
        .agg(F.bool_or(F.col("_low") != F.col("_high")).alias("_conflict"), F.sum("_n").alias("_rows"))
        .filter("_conflict")
        .drop("_conflict")
    )


def conflict_keys(
    df: DataFrame, key: Sequence[str], updated: str = "updated_at", checksum: str = "checksum"
) -> DataFrame:
    return key_conflicts(df, key, updated, checksum).select(*key)


def flag_conflicts(
    df: DataFrame,
    key: Sequence[str],
    updated: str = "updated_at",
    checksum: str = "checksum",
    conflicts: DataFrame | None = None,
) -> DataFrame:
    """All rows, those of conflicting keys with a ``rejection_reason``: both sides of the split from one join.

    Rows with a NULL key stay clean.  ``conflicts`` gives the conflicting keys when they are known already.
    """
    bad = conflict_keys(df, key, updated, checksum) if conflicts is None else conflicts.select(*key)
    flagged = df.join(bad.withColumn("_conflict", F.lit(True)), list(key), "left")
    reason = F.when(F.col("_conflict"), EQUAL_TIME_CONFLICT).alias("rejection_reason")
    return flagged.select(*df.columns, reason)


def split_conflicts(
    df: DataFrame,
    key: Sequence[str],
    updated: str = "updated_at",
    checksum: str = "checksum",
    conflicts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows of clean keys, all rows of conflicting keys with a reason), see ``flag_conflicts``."""
    flagged = flag_conflicts(df, key, updated, checksum, conflicts)
    clean = flagged.filter("rejection_reason IS NULL").drop("rejection_reason")
    return clean, flagged.filter("rejection_reason IS NOT NULL")


def resolve_batch(
    df: DataFrame,
    key: Sequence[str],
    updated: str = "updated_at",
    ingested: str = "ingested_at",
    batch: str = "batch_id",
    checksum: str = "checksum",
    record: str = "record_id",
    conflicts: DataFrame | None = None,
) -> DataFrame:
    """The newest row of every key without conflicts: conflict split and dedup in one chain.

    Conflict keys are a small aggregate; only the rows that survive the partial
    ranking (one per key) are joined with them, never the whole batch.
    """
    winners = dedup(df, key, updated, ingested, batch, checksum, record)
    bad = conflict_keys(df, key, updated, checksum) if conflicts is None else conflicts.select(*key)
    return winners.join(bad, list(key), "left_anti")


def classify(
    source: DataFrame,
    target: DataFrame,
    key: Sequence[str],
    updated: str = "updated_at",
    checksum: str = "checksum",
    deleted: str | None = "is_deleted",
) -> DataFrame:
    """Add ``row_class`` and ``rejection_reason`` to deduplicated rows.

    Classes: mergeable, stale, duplicate, quarantine, and unclassified when a
    missing change time prevents the comparison.
    """
    present = target.select(
        *key,
        F.col(updated).alias("_t_updated"),
        F.coalesce(F.col(checksum), F.lit(NULL_CHECKSUM)).alias("_t_checksum"),
        F.lit(True).alias("_t_here"),
    )
    here = F.coalesce(F.col("_t_here"), F.lit(False))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    same = F.coalesce(F.col(checksum), F.lit(NULL_CHECKSUM)) == F.col("_t_checksum")
    at, known = F.col(updated), F.col("_t_updated")
    row_class = (
        F.when(~here, F.when(gone, "quarantine").otherwise("mergeable"))
        .when(at > known, "mergeable")
        .when(at < known, "stale")
        .when((at == known) & same, "duplicate")
        .when(at == known, "quarantine")
        .otherwise("unclassified")
    )
    reason = F.when(F.col("row_class") == "quarantine", F.when(here, EQUAL_TIME_CONFLICT).otherwise(DELETE_WITHOUT_TARGET))
    return (
        source.join(present, list(key), "left")
        .withColumn("row_class", row_class)
        .withColumn("rejection_reason", reason)
        .select(*source.columns, "row_class", "rejection_reason")
    )


def written_at(df: DataFrame, at) -> DataFrame:
    return df.withColumn("_silver_updated_at", F.lit(at).cast("timestamp"))


def merge_newer(
    target: DataFrame,
    source: DataFrame,
    key: Sequence[str],
    updated: str = "updated_at",
    deleted: str | None = "is_deleted",
    at=None,
    stage: bool = True,
) -> DataFrame:
    """New state: a row is replaced only by a strictly newer one; new keys enter unless deleted.

    ``source`` holds at most one row per key.  ``_silver_updated_at`` becomes
    ``at`` for rows written by this merge.  Only key and change time of the
    target are compared; its full rows pass an anti join.  With ``stage`` the
    rows taken are written once to the shared folder: the source is not computed
    twice, and Spark knows their size, so that a small change set is broadcast
    and no target row is shuffled.
    """
    if "_silver_updated_at" not in target.columns:
        target = written_at(target, None)
    known = target.select(*key, F.col(updated).alias("_t_updated"), F.lit(True).alias("_t_here"))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    newer = F.when(F.col("_t_here"), F.col(updated) > F.col("_t_updated")).otherwise(~gone)
    taken = written_at(source.join(known, list(key), "left").filter(newer).select(*source.columns), at)
    return upsert(target, staged(taken, "taken") if stage else taken, key)


def _completed(source: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Source rows with the target columns they lack; an updated row keeps its old values there."""
    lacking = [c for c in target.columns if c not in source.columns]
    if not lacking:
        return source
    return join_nullsafe(source, target.select(*key, *lacking), key, "left")


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every source row replaces the row of its key or is added.

    Columns only the target has keep their values; columns only the source has
    are NULL in the other rows.
    """
    rest = target.join(source.select(*key), list(key), "left_anti")
    return rest.unionByName(_completed(source, target, key), allowMissingColumns=True)


def merge_cdc(
    target: DataFrame | None,
    changes: DataFrame,
    key: Sequence[str],
    deleted_at: str | None = "_ab_cdc_deleted_at",
    tie_break: Sequence[str] = (),
    stage: bool = True,
) -> DataFrame:
    """State after a set of change rows: newest change per key; a deletion removes the key.

    With ``stage`` the newest changes are written once, as in ``merge_newer``.
    """
    latest = dedup_latest(changes, key, tie_break).dropna(subset=list(key))
    if stage and target is not None:
        latest = staged(latest, "changes")
    has_delete = deleted_at is not None and deleted_at in changes.columns
    alive = latest.filter(F.col(deleted_at).isNull()) if has_delete else latest
    if target is None:
        return alive
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key])
    untouched = target.alias("t").join(latest.select(*key).alias("s"), on, "left_anti")
    return untouched.unionByName(_completed(alive, target, key), allowMissingColumns=True)


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of more than one row, with their number of rows as ``_n``; NULL is a key like any other."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")


def repair_duplicates(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(repaired table, one row with rows removed and duplicate keys left).

    Keys are counted first, with partial counts and without other columns.  Only rows
    of repeated keys are ranked.  The repeated keys are written once, so Spark knows their size: few of
    them are broadcast, and all other rows then pass without a shuffle.  Rows equal in
    ``order`` are told apart by the hash of all columns.
    """
    repeated = staged(repeated_keys(df, key), "repeated")
    keys = repeated.select(*key)
    chosen = first_per_key(join_nullsafe(df, keys, key, "left_semi"), key, [*order, row_checksum(sorted(df.columns))])
    repaired = join_nullsafe(df, keys, key, "left_anti").unionByName(chosen)
    count = F.count(F.lit(1))
    removed = repeated.agg((F.coalesce(F.sum("_n"), F.lit(0)) - count).alias("removed"))
    return repaired, side_by_side(removed, repeated_keys(chosen, key).agg(count.alias("duplicates_left")))
