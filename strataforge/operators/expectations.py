"""Declarative column expectations and the policy that turns failures into a decision."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from strataforge.functions.frames import side_by_side


@dataclass(frozen=True)
class Expectation:
    """``kind``: not_null, between, in_set, matches, unique or row_count_between."""

    kind: str
    column: str | None = None
    severity: str = "critical"
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    pattern: str | None = None
    params: dict = field(default_factory=dict)

    def unexpected(self) -> Column:
        """Condition of a row that breaks the expectation; NULL values pass all but not_null."""
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "between":
            bad = F.lit(False)
            if self.low is not None:
                bad = bad | (c < self.low)
            if self.high is not None:
                bad = bad | (c > self.high)
            return bad
        if self.kind == "in_set":
            return ~c.isin(*self.values)
        if self.kind == "matches":
            return ~c.rlike(self.pattern)
        raise ValueError(f"unknown expectation {self.kind}")


def validate(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """One row per expectation: kind, column, severity, observed bad rows, success.

    All row conditions share one scan.  A uniqueness check groups its column
    with partial counts and counts rows of repeated values.
    """
    rowwise = [(i, e) for i, e in enumerate(suite) if e.kind not in ("unique", "row_count_between")]
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(e.unexpected(), 1)).alias(f"_{i}") for i, e in rowwise]
    )
    for i, e in enumerate(suite):
        if e.kind == "unique":
            repeated = (
                df.filter(F.col(e.column).isNotNull())
                .groupBy(e.column)
                .agg(F.count(F.lit(1)).alias("_n"))
                .agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(f"_{i}"))
            )
            totals = side_by_side(totals, repeated)
        elif e.kind == "row_count_between":
            low = F.lit(e.low if e.low is not None else 0)
            high = F.lit(e.high) if e.high is not None else F.col("_rows")
            totals = totals.withColumn(f"_{i}", F.when(F.col("_rows").between(low, high), 0).otherwise(1))
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("ordinal"),
                F.lit(e.kind).alias("expectation"),
                F.lit(e.column).cast("string").alias("column_name"),
                F.lit(e.severity).alias("severity"),
                F.col(f"_{i}").cast("bigint").alias("observed"),
                (F.col(f"_{i}") == 0).alias("success"),
            )
            for i, e in enumerate(suite)
        ]
    )
    return totals.select(F.inline(rows))


MODES = ("off", "report", "enforce")


def apply_policies(results: DataFrame, modes: Sequence[str], blocking: Sequence[str] = ("critical",)) -> DataFrame:
    """One row per mode: evaluated, successful, critical and warning failures, status, merge_allowed.

    The results are evaluated once, however many modes there are.
    """
    unknown = sorted(set(modes) - set(MODES))
    if unknown:
        raise ValueError(f"unknown mode {unknown}")
    failed = ~F.col("success")
    severe = F.lower(F.trim(F.coalesce(F.col("severity"), F.lit("critical")))).isin(*blocking)
    summary = results.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count(F.when(F.col("success"), 1)).alias("successful"),
        F.count(F.when(failed & severe, 1)).alias("critical_failures"),
        F.count(F.when(failed & ~severe, 1)).alias("warning_failures"),
    )
    critical, warnings = F.col("critical_failures") > 0, F.col("warning_failures") > 0
    status = (
        F.when(F.col("mode") == "off", "PASSED")
        .when((F.col("mode") == "enforce") & critical, "FAILED")
        .when(critical | warnings, "WARNING")
        .otherwise("PASSED")
    )
    return (
        summary.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
        .withColumn("status", status)
        .withColumn("merge_allowed", F.col("status") != "FAILED")
    )


def apply_policy(results: DataFrame, mode: str, blocking: Sequence[str] = ("critical",)) -> DataFrame:
    """One row: what the failures mean under one mode."""
    return apply_policies(results, [mode], blocking)
