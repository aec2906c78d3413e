"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FEED_KEY = ["user_id", "event_type"]
AS_OF = "2024-03-01 00:00:00"
STAMP = "%Y-%m-%d %H:%M:%S.%f"

FEED_ORDER = (
    "updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, batch_id DESC NULLS LAST, "
    "checksum ASC NULLS LAST, record_id ASC NULLS LAST"
)
FEED_COLUMNS = (
    f"record_id, user_id, event_type, strftime(updated_at, '{STAMP}') AS updated_at, "
    f"strftime(ingested_at, '{STAMP}') AS ingested_at, batch_id, checksum, cents, is_deleted"
)


def shown(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that both engines print the same."""
    return df.select(
        *[
            F.date_format(F.col(n).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(n)
            if t.startswith("timestamp")
            else F.col(n)
            for n, t in df.dtypes
        ]
    )


def sides(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two outputs of one operator as one frame."""
    a = first.withColumn("side", F.lit(names[0]))
    return a.unionByName(second.withColumn("side", F.lit(names[1])), allowMissingColumns=True)


def feed_steps(source: str, target: str, tag: str = "") -> str:
    """SQL of conflict split, dedup and classification as common table expressions."""
    return f"""bad{tag} AS (
  SELECT DISTINCT user_id, event_type FROM (
    SELECT user_id, event_type, updated_at FROM {source} GROUP BY ALL
    HAVING count(DISTINCT coalesce(checksum, '__NULL_CHECKSUM__')) > 1)),
winners{tag} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT s.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {FEED_ORDER}) AS rn
    FROM {source} s WHERE NOT EXISTS (
      SELECT 1 FROM bad{tag} b WHERE b.user_id = s.user_id AND b.event_type = s.event_type))
  WHERE rn = 1),
classes{tag} AS (
  SELECT w.*, CASE
      WHEN t.user_id IS NULL AND coalesce(w.is_deleted, false) THEN 'quarantine'
      WHEN t.user_id IS NULL THEN 'mergeable'
      WHEN w.updated_at > t.updated_at THEN 'mergeable'
      WHEN w.updated_at < t.updated_at THEN 'stale'
      WHEN coalesce(w.checksum, '__NULL_CHECKSUM__') = coalesce(t.checksum, '__NULL_CHECKSUM__') THEN 'duplicate'
      ELSE 'quarantine' END AS row_class,
    CASE WHEN t.user_id IS NULL AND coalesce(w.is_deleted, false) THEN 'DELETE_WITHOUT_EXISTING_TARGET'
      WHEN w.updated_at = t.updated_at
       AND coalesce(w.checksum, '__NULL_CHECKSUM__') <> coalesce(t.checksum, '__NULL_CHECKSUM__')
      THEN 'EQUAL_TIMESTAMP_DIFFERENT_CHECKSUM' END AS rejection_reason
  FROM winners{tag} w LEFT JOIN {target} t ON w.user_id = t.user_id AND w.event_type = t.event_type)"""


def merged_state(classes: str, target: str) -> str:
    """SQL of the state after merging the mergeable rows."""
    return f"""SELECT * EXCLUDE (row_class, rejection_reason) FROM {classes} WHERE row_class = 'mergeable'
UNION ALL BY NAME
SELECT t.* FROM {target} t WHERE NOT EXISTS (
  SELECT 1 FROM {classes} c WHERE c.row_class = 'mergeable' AND c.user_id = t.user_id AND c.event_type = t.event_type)"""
