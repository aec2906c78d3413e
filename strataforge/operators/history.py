"""Version histories and timelines per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strataforge.functions.windows import ordered_neighbours


def deletion_mark(df: DataFrame) -> Column:
    """True when any of the known deletion columns marks the row."""
    marks = []
    kinds = dict(df.dtypes)
    if "_ab_cdc_deleted_at" in kinds:
        text = F.trim(F.col("_ab_cdc_deleted_at").cast("string"))
        marks.append(F.coalesce(~text.isin("", "null", "<nil>"), F.lit(False)))
    if "is_deleted" in kinds:
        text = F.lower(F.col("is_deleted").cast("string"))
        marks.append(F.coalesce(text.isin("true", "1", "t"), F.lit(False)))
    if "_op" in kinds:
        marks.append(F.coalesce(F.upper(F.col("_op").cast("string")) == "DELETE", F.lit(False)))
    return F.greatest(*marks, F.lit(False)) if len(marks) > 1 else (marks[0] if marks else F.lit(False))


def version_history(
    df: DataFrame,
    record: str,
    ts: str,
    tie_break: str,
    fields: Sequence[str],
) -> DataFrame:
    """Numbered versions with validity interval, operation and changed fields.

    A record of any length, or with any number of changes at one time, spreads over
    range partitions, see ``ordered_neighbours``.
    ``changes`` holds the fields that differ from the previous version, compared
    by type and null-safe.
    """
    marked = df.withColumn("_gone", deletion_mark(df))
    versions = ordered_neighbours(
        marked,
        [record],
        [ts, tie_break],
        number="version_number",
        previous={"_old": F.struct(*[F.col(f) for f in fields])},
        following={"valid_to": F.col(ts)},
    )
    first = F.col("version_number") == 1
    diffs = F.array(
        *[
            F.when(
                ~first & ~F.col(f).eqNullSafe(F.col(f"_old.{f}")),
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"_old.{f}").cast("string").alias("old_value"),
                    F.col(f).cast("string").alias("new_value"),
                ),
            )
            for f in fields
        ]
    )
    return versions.select(
        record,
        "version_number",
        F.when(F.col("_gone"), "DELETE").when(first, "INSERT").otherwise("UPDATE").alias("operation"),
        F.col(ts).alias("valid_from"),
        "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
        F.array_compact(diffs).alias("changes"),
        tie_break,
        *fields,
    )


def entity_timeline(df: DataFrame, record: str, ts: str, tie_break: str, fields: Sequence[str]) -> DataFrame:
    """One row per record: versions, status, latest time, first and last known data.

    Works on the change rows directly; every aggregate combines partially, so a
    long record is never gathered.
    """
    at = F.struct(F.col(ts), F.col(tie_break))
    data = F.struct(*[F.col(f) for f in fields])
    gone = deletion_mark(df)
    summary = df.withColumn("_gone", gone).groupBy(record).agg(
        F.count(F.lit(1)).alias("total_versions"),
        F.max_by(F.col("_gone"), at).alias("_last_gone"),
        F.max(ts).alias("latest_update_at"),
        F.min_by(data, at).alias("initial"),
        F.max_by(data, F.when(~F.col("_gone"), at)).alias("_alive"),
        F.max_by(data, at).alias("_latest"),
    )
    return summary.select(
        record,
        "total_versions",
        F.when(F.col("_last_gone"), "DELETED").otherwise("ACTIVE").alias("current_status"),
        "latest_update_at",
        "initial",
        F.coalesce("_alive", "_latest").alias("last_known"),
    )
