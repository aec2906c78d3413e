"""Queries behind dashboard tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MAX": F.max, "MIN": F.min}

# Parts of names whose metric is averaged.
AVERAGE_WORDS = (
    "diem", "gpa", "ty_le", "ti_le", "rate", "percent",
    "score", "avg_", "atk", "hp", "def", "copies",
    "stat", "temp", "nhiet_do", "humidity", "do_am", "lpg",
    "smoke", "ppm", "celsius", "__avg__",
)


def _measure(column: str, aggregate: str) -> Column:
    return AGGREGATES[aggregate](F.col(column))


def big_number(df: DataFrame, column: str, aggregate: str = "SUM") -> DataFrame:
    return df.agg(_measure(column, aggregate).alias("value"))


def top_n(df: DataFrame, dimension: str, metric: str, aggregate: str = "SUM", n: int = 10) -> DataFrame:
    """Largest groups; equal values are ordered by the dimension."""
    grouped = df.groupBy(dimension).agg(_measure(metric, aggregate).alias("value"))
    return grouped.orderBy(F.desc("value"), F.asc(dimension)).limit(n)


def share(df: DataFrame, dimension: str, metric: str, aggregate: str = "COUNT") -> DataFrame:
    return top_n(df, dimension, metric, aggregate, 10)


def trend(
    df: DataFrame, time: Column, metric: str, aggregate: str = "SUM", series: Sequence[str] = (), limit: int = 1000
) -> DataFrame:
    grouped = df.groupBy(time.alias("time"), *series).agg(_measure(metric, aggregate).alias("value"))
    return grouped.orderBy("time", *series).limit(limit)


def detail(df: DataFrame, columns: Sequence[str], order: Sequence[str], limit: int = 1000) -> DataFrame:
    return df.select(*columns).orderBy(*order).limit(limit)


def is_average_metric(name: str) -> bool:
    return any(word in name.lower() for word in AVERAGE_WORDS)


def semantic_metrics(gold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """All dashboard metrics of a mart in one row.

    A metric that is a column itself is summed, or averaged when its name is
    rate-like; otherwise its ``sum_`` column is summed and its ``avg_`` column averaged.
    """
    have = set(gold.columns)
    figures = [F.sum("total_records").alias("record_count")] if "total_records" in have else [
        F.count(F.lit(1)).alias("record_count")
    ]
    for m in metrics:
        if m in have:
            figures.append((F.avg if is_average_metric(m) else F.sum)(m).alias(f"metric_{m}"))
            continue
        if f"sum_{m}" in have:
            figures.append(F.sum(f"sum_{m}").alias(f"total_{m}"))
        if f"avg_{m}" in have:
            figures.append(F.avg(f"avg_{m}").alias(f"avg_{m}"))
    if "health_status" in have:
        figures.append(F.count(F.when(F.col("health_status") == "CRITICAL", 1)).alias("count_critical"))
    if "target_achievement_pct" in have:
        figures.append(F.avg("target_achievement_pct").alias("avg_target_achievement"))
    if "risk_score" in have:
        figures.append(F.avg("risk_score").alias("avg_risk_score"))
    return gold.agg(*figures)


EXCELLENT = 90  # fixed value: completion percent of an excellent unit


def summary_cards(summary: DataFrame, ratio: str = "completion_pct") -> DataFrame:
    """Rows, mean completion to one decimal, and rows at or above the excellent limit."""
    value = F.coalesce(F.col(ratio), F.lit(0.0))
    return summary.agg(
        F.count(F.lit(1)).alias("units"),
        F.round(F.avg(value), 1).alias("mean_completion"),
        F.count(F.when(value >= EXCELLENT, 1)).alias("excellent"),
    )


def by_completion(summary: DataFrame, ratio: str = "completion_pct", tie_break: Sequence[str] = ()) -> DataFrame:
    """Units sorted by completion, best first."""
    return summary.orderBy(F.desc(ratio), *tie_break)
