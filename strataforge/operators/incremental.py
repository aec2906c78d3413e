"""Incremental reading: slices after a watermark, pages, checkpoints and stable batch names."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strataforge.functions.frames import attach
from strataforge.functions.windows import rank_in_order, rows_between


def incremental_slice(
    df: DataFrame, updated: str, record: str, after=None, offset: int = 0, limit: int | None = None, overlap: str | None = None
) -> DataFrame:
    """Rows changed strictly after the watermark, ordered by (change time, id), one page of them.

    ``overlap`` (an interval text) re-reads a stretch before the watermark, for
    sources that add rows late; the repeats are duplicates to the merge.
    ``has_more`` tells whether rows follow the page.
    """
    rows = df
    if after is not None:
        start = F.lit(after).cast("timestamp")
        rows = rows.filter(F.col(updated).cast("timestamp") > (start - F.expr(f"INTERVAL {overlap}") if overlap else start))
    if limit is None:
        if not offset:
            return rows.orderBy(updated, record)
        # skipped by number, found through range partitions; an offset over the whole order would end in one task
        place = "_position"
        numbered = rank_in_order(rows, [], [F.col(updated).asc_nulls_first(), F.col(record).asc_nulls_first()], place)
        return numbered.filter(F.col(place) > offset).orderBy(place).drop(place)
    total = rows.agg((F.count(F.lit(1)) > offset + limit).alias("has_more"))
    return attach(rows_between(rows, [updated, record], offset, limit), total)


def row_range(mode: str, state, limit: int) -> tuple[int, int]:
    """First row (zero-based) and length of a page in any of the three notations."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if mode == "page":
        if state < 1:
            raise ValueError("pages start at 1")
        return (state - 1) * limit, limit
    if mode == "offset":
        if state < 0:
            raise ValueError("offsets start at 0")
        return state, limit
    if mode == "cursor":
        return int(state or 0), limit
    raise ValueError(f"unknown page mode {mode}")


def paginate(df: DataFrame, order: Sequence[str], mode: str, state, limit: int, seen: Sequence = ()) -> DataFrame:
    """One page; a state that was already visited is an error.

    For walks through large tables use ``page_after``, whose cost does not grow
    with the position.
    """
    if state in seen:
        raise ValueError(f"page state {state!r} was already visited")
    start, length = row_range(mode, state, limit)
    return rows_between(df, order, start, length)


def page_after(df: DataFrame, order: Sequence[str], last: Sequence, limit: int) -> DataFrame:
    """The page behind the last row seen, found by a filter on the order columns."""
    behind: Column = F.lit(False)
    equal: Column = F.lit(True)
    for name, value in zip(order, last):
        behind = behind | (equal & (F.col(name) > F.lit(value)))
        equal = equal & (F.col(name) == F.lit(value))
    return df.filter(behind).orderBy(*order).limit(limit)


def next_watermark(df: DataFrame, ts: str, stored=None) -> DataFrame:
    """One row: rows, rows without a usable time, the candidate watermark, and its state.

    Text times need an offset; they are read in UTC.  ``state`` is NO_CHANGE for
    no rows, REJECTED for missing or naive times or a watermark that does not
    advance, ADVANCED otherwise.
    """
    at = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        at = F.when(at.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(at))
    at = at.cast("timestamp")
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(at.isNull(), 1)).alias("unusable"), F.max(at).alias("watermark")
    )
    ahead = F.lit(True) if stored is None else F.col("watermark") > F.lit(stored).cast("timestamp")
    return facts.withColumn(
        "state",
        F.when(F.col("rows") == 0, "NO_CHANGE")
        .when((F.col("unusable") > 0) | ~ahead, "REJECTED")
        .otherwise("ADVANCED"),
    )


BATCH_PREFIX = "airflow_api_"  # fixed value


def batch_identity(dataset: Column, strategy: Column, checkpoint: Column) -> Column:
    """Stable batch name of a checkpoint: hash of compact JSON with sorted keys.

    ``checkpoint`` is the watermark text, or NULL before the first batch.
    """
    payload = F.when(checkpoint.isNotNull(), F.struct(checkpoint.alias("value")))
    identity = F.to_json(
        F.struct(payload.alias("checkpoint_payload"), dataset.alias("dataset_id"), strategy.alias("strategy_type")),
        {"ignoreNullFields": "false"},
    )
    return F.concat(F.lit(BATCH_PREFIX), F.substring(F.sha2(identity, 256), 1, 20))


def batch_id(dataset: str, strategy: str | None, checkpoint: Mapping | None) -> str:
    """The same name for one checkpoint, computed on the driver."""
    identity = {"checkpoint_payload": checkpoint, "dataset_id": dataset, "strategy_type": strategy}
    text = json.dumps(identity, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return BATCH_PREFIX + hashlib.sha256(text.encode()).hexdigest()[:20]


def run_identity(dataset: Column, run: Column) -> Column:
    return F.sha2(F.concat(dataset, F.lit("\n"), run), 256)
