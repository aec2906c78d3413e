"""Ordered computations that stay balanced when one key, or no key, divides the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataforge.session import staged


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the right key columns are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = term if on is None else on & term
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def percent_rank_global(df: DataFrame, column: str, name: str = "p_rank", descending: bool = True) -> DataFrame:
    """``percent_rank`` over the whole frame without one task seeing every row.

    Equal values are first counted together.  The distinct values are sorted by
    range over the cluster and written with their partition number, which fixes it.
    One row per partition (a few thousand at most, however large the data)
    carries the running start of each partition.
    """
    order = F.col("_v").desc_nulls_last() if descending else F.col("_v").asc_nulls_first()
    values = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = staged(values.orderBy(order).withColumn("_part", F.spark_partition_id()), "ranks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.sum("_n").alias("_size"))
        .select(
            "_part",
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
            F.sum("_size").over(Window.partitionBy()).alias("_total"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        placed.withColumn("_ahead", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "_part")
        .select(
            F.col("_v").alias(column),
            F.when(F.col("_total") > 1, (F.col("_start") + F.col("_ahead")).cast("double") / (F.col("_total") - 1))
            .otherwise(F.lit(0.0))
            .alias(name),
        )
    )
    return join_nullsafe(df, ranks, [column])


def rank_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """``row_number`` per key in any order, balanced for keys of any size.

    Rows are sorted by (key, order) over the cluster and written with their
    partition number, so a large key spreads over several range partitions; each
    partition numbers its part, and the part sizes, one row per key and
    partition, give the offsets.  ``order`` should be unique per key: rows that
    are equal in all of it stay in one partition.
    """
    ordered = df.orderBy(*[F.col(k) for k in keys], *order)
    placed = staged(ordered.withColumn("_part", F.spark_partition_id()), "positions")
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = join_nullsafe(placed.withColumn("_at", F.row_number().over(local)), starts, [*keys, "_part"])
    return numbered.select(*df.columns, (F.col("_start") + F.col("_at")).cast("bigint").alias(name))


def rows_between(df: DataFrame, order: Sequence[Column | str], start: int, length: int) -> DataFrame:
    """``length`` rows from position ``start`` (zero-based), found by range partitions at every position.

    ``order`` must be unique per row, or pages may overlap.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    numbered = rank_in_order(df, [], columns, "_position")
    page = F.col("_position").between(start + 1, start + length)
    return numbered.filter(page).orderBy("_position").drop("_position")


def ordered_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Row number, previous and next values per key, for keys of any size, whatever their order columns hold.

    Rows are sorted by (key, order) over the cluster and written with their
    partition number.  Windows run within a partition.  Only the first and the last
    key of a partition can go on in another one; one row for each, with its size and its
    outer values, makes an edge table of two rows a partition at most, from
    which rows at the edges take what lies beyond.  ``order`` must be ascending
    columns that together are unique per key.
    """
    previous, following = dict(previous or {}), dict(following or {})
    key, rank = F.struct(*keys), F.struct(*order)
    placed = staged(df.orderBy(*keys, *order).withColumn("_part", F.spark_partition_id()), "neighbours")
    bounds = placed.groupBy("_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))  # one row a partition
    open_ = placed.join(F.broadcast(bounds), "_part").where(key.eqNullSafe(F.col("_low")) | key.eqNullSafe(F.col("_high")))
    edges = open_.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max_by(F.struct(F.lit(0).alias("_"), *[v.alias(k) for k, v in previous.items()]), rank).alias("_last"),
        F.min_by(F.struct(F.lit(0).alias("_"), *[v.alias(k) for k, v in following.items()]), rank).alias("_first"),
    )
    along = Window.partitionBy(*keys).orderBy("_part")
    beyond = edges.select(
        *keys, "_part",
        F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"),
    )
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    marked = placed.withColumn("_at", F.row_number().over(local)).withColumn("_end", F.lead(F.lit(False), 1, True).over(local))
    for name, value in previous.items():
        marked = marked.withColumn(f"_p_{name}", F.lag(value).over(local))
    for name, value in following.items():
        marked = marked.withColumn(f"_f_{name}", F.lead(value).over(local))
    joined = join_nullsafe(marked, F.broadcast(beyond), [*keys, "_part"], "left")
    result = [F.col(c) for c in df.columns]
    if number:
        result.append((F.coalesce("_offset", F.lit(0)) + F.col("_at")).cast("bigint").alias(number))
    result += [F.when(F.col("_at") == 1, F.col(f"_before.{n}")).otherwise(F.col(f"_p_{n}")).alias(n) for n in previous]
    result += [F.when(F.col("_end"), F.col(f"_after.{n}")).otherwise(F.col(f"_f_{n}")).alias(n) for n in following]
    return joined.select(*result)
