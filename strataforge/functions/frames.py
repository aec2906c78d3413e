"""Joining one-row results to other rows without joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def side_by_side(*single: DataFrame) -> DataFrame:
    """The columns of several one-row frames as one row."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), single)
    return together.agg(*[F.max(c).alias(c) for c in together.columns])


def attach(df: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery."""
    row = single.select(F.struct("*")).scalar()
    return df.select("*", row.alias("_single")).select(*df.columns, "_single.*")
