"""Table audits and gates.  Each reads its table once and returns rows, not exceptions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataforge.functions.frames import side_by_side


METADATA_COLUMNS = (
    "_source_system",
    "_source_type",
    "_dataset",
    "_schema_version",
    "_ingestion_mode",
    "_batch_id",
    "_source_updated_at",
    "_ingested_at",
    "_record_checksum",
)


def _total(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def as_rows(one_row: DataFrame, names: Sequence[str], key: str = "check_name", value: str = "failures") -> DataFrame:
    """Turn one row of numbers into (name, number) rows."""
    pairs = [F.struct(F.lit(n).alias(key), F.col(n).cast("bigint").alias(value)) for n in names]
    return one_row.select(F.inline(F.array(*pairs)))


def duplicate_groups(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


check_grain = duplicate_groups


def audit_bronze(df: DataFrame, dataset: str, batch: str) -> DataFrame:
    """Rows, missing metadata columns, rows of another dataset or batch, missing checksums."""
    missing = [c for c in METADATA_COLUMNS if c not in df.columns]

    def other(column: str, value: str) -> Column:
        return _total(~F.col(column).eqNullSafe(F.lit(value))) if column not in missing else F.lit(None).cast("bigint")

    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(missing)).cast("bigint").alias("missing_columns"),
        other("_dataset", dataset).alias("other_dataset"),
        other("_batch_id", batch).alias("other_batch"),
        (
            _total(F.col("_record_checksum").isNull()) if "_record_checksum" not in missing else F.lit(None).cast("bigint")
        ).alias("null_checksums"),
    ).withColumn(
        "passed",
        F.expr("row_count > 0 AND missing_columns = 0 AND other_dataset = 0 AND other_batch = 0 AND null_checksums = 0"),
    )


def audit_silver(df: DataFrame, quarantine: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, duplicate key groups and quarantine rows; the key is grouped once."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    state = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        _total(F.col("_n") > 1).alias("duplicate_keys"),
    )
    return side_by_side(state, quarantine.agg(F.count(F.lit(1)).alias("quarantine_rows"))).withColumn(
        "passed", F.expr("row_count > 0 AND duplicate_keys = 0")
    )


def gate_silver(
    df: DataFrame, key: Sequence[str], required: Sequence[str], period: str, unknown: str
) -> DataFrame:
    """Failures per check: empty, null_required, duplicate_keys, unknown_period."""
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    groups = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        _total(absent).alias("_absent"),
        _total(F.col(period) == unknown).alias("_unknown"),
    )
    totals = groups.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("empty"),
        F.coalesce(F.sum("_absent"), F.lit(0)).alias("null_required"),
        _total(F.col("_n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum("_unknown"), F.lit(0)).alias("unknown_period"),
    )
    return as_rows(totals, ["empty", "null_required", "duplicate_keys", "unknown_period"])


def gate_gold(summary: DataFrame, detail: DataFrame, ratio: str) -> DataFrame:
    """Failures per check: summary_empty, ratio_out_of_range, detail_empty."""
    left = summary.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("summary_empty"),
        _total((F.col(ratio) < 0) | (F.col(ratio) > 100)).alias("ratio_out_of_range"),
    )
    right = detail.limit(1).agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("detail_empty"))
    return as_rows(side_by_side(left, right), ["summary_empty", "ratio_out_of_range", "detail_empty"])


def gate_candidate(
    candidate: DataFrame,
    key: Sequence[str],
    rules: Iterable[tuple[str, str]],
    quarantine_before: DataFrame,
    quarantine_after: DataFrame,
    written: DataFrame,
) -> DataFrame:
    """Failures per check: duplicate_keys, invalid_rows, quarantine_delta (difference to rows written)."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.expr(p), F.lit(False)) for _, p in rules])
    groups = candidate.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), _total(bad).alias("_bad"))
    state = groups.agg(
        _total(F.col("_n") > 1).alias("duplicate_keys"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("invalid_rows")
    )
    count = F.count(F.lit(1))
    delta = side_by_side(
        quarantine_after.agg(count.alias("_after")),
        quarantine_before.agg(count.alias("_before")),
        written.agg(count.alias("_written")),
    ).select(F.abs(F.col("_after") - F.col("_before") - F.col("_written")).alias("quarantine_delta"))
    return as_rows(side_by_side(state, delta), ["duplicate_keys", "invalid_rows", "quarantine_delta"])


def row_checks(
    df: DataFrame, checks: Sequence[tuple[str, str]], require_rows: str | None = None, only_failing: bool = True
) -> DataFrame:
    """Many predicates in one scan; one row per failing check."""
    sums = [_total(F.expr(predicate)).alias(f"_c{i}") for i, (_, predicate) in enumerate(checks)]
    totals = df.agg(F.count(F.lit(1)).alias("_rows"), *sums)
    pairs = [(name, F.col(f"_c{i}")) for i, (name, _) in enumerate(checks)]
    if require_rows:
        pairs.append((require_rows, F.when(F.col("_rows") == 0, 1).otherwise(0)))
    rows = totals.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("check_name"), c.cast("bigint").alias("failure_count")) for n, c in pairs]
            )
        )
    )
    return rows.filter("failure_count > 0") if only_failing else rows


def outside(column: str, low: float | None = 0, high: float | None = 100, required: bool = False) -> str:
    """Predicate for a NULL (if required), NaN, infinite or out-of-range number."""
    parts = [f"isnan({column})", f"abs({column}) = double('infinity')"]
    if low is not None:
        parts.append(f"{column} < {low}")
    if high is not None:
        parts.append(f"{column} > {high}")
    found = f"({column} IS NOT NULL AND ({' OR '.join(parts)}))"
    return f"({column} IS NULL OR {found})" if required else found


def ratio_differs(stored: str, part: str, whole: str, scale: float = 100.0) -> str:
    """Predicate for a stored ratio that is not part * scale / whole (NULL when whole is not positive)."""
    formula = f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) * {scale}D / CAST({whole} AS DOUBLE) END"
    return f"NOT ({stored} <=> ({formula}))"


def assert_schema(df: DataFrame, expected: Sequence[tuple[str, str]]) -> DataFrame:
    """Positions at which the column name or type is not the expected one."""
    spark = df.sparkSession
    shape = "ordinal int, name string, kind string"
    want = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(expected, 1)], shape)
    have = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes, 1)], shape)
    e, a = want.alias("e"), have.alias("a")
    return (
        e.join(a, F.col("e.ordinal") == F.col("a.ordinal"), "full_outer")
        .filter(~(F.col("e.name").eqNullSafe(F.col("a.name")) & F.col("e.kind").eqNullSafe(F.col("a.kind"))))
        .select(
            F.coalesce("e.ordinal", "a.ordinal").alias("ordinal"),
            F.col("e.name").alias("expected_name"),
            F.col("e.kind").alias("expected_type"),
            F.col("a.name").alias("actual_name"),
            F.col("a.kind").alias("actual_type"),
        )
    )


def reconcile_counts(source: DataFrame, result: DataFrame) -> DataFrame:
    """One row of counts and whether both are equal and not zero."""
    count = F.count(F.lit(1))
    counts = side_by_side(source.agg(count.alias("source_rows")), result.agg(count.alias("result_rows")))
    return counts.withColumn("passed", F.expr("source_rows > 0 AND source_rows = result_rows"))


def lineage_diff(
    gold: DataFrame,
    silver: DataFrame,
    record_id: str,
    columns: Sequence[str],
    slices: int = 1,
    slice_no: int = 0,
) -> DataFrame:
    """Gold rows without an equal Silver row, with the columns that differ.

    ``slices`` restricts one run to a share of the ids; the shuffle join itself
    needs no such split.
    """
    if slices > 1:
        part = F.crc32(F.coalesce(F.col(record_id), F.lit("")).cast("binary")) % slices == slice_no
        gold, silver = gold.filter(part), silver.filter(part)
    g = gold.select(record_id, *columns).alias("g")
    s = silver.select(F.col(record_id).alias("_sid"), *columns).alias("s")
    differs = [
        F.when(~F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")), F.lit(c)) for c in columns
    ]
    return (
        g.join(s, F.col(f"g.{record_id}") == F.col("s._sid"), "left")
        .select(
            F.col(f"g.{record_id}").alias(record_id),
            F.when(F.col("s._sid").isNull(), F.lit("<missing>"))
            .otherwise(F.concat_ws("|", F.array_compact(F.array(*differs))))
            .alias("differing"),
        )
        .filter("differing <> ''")
    )


def check_periods(
    df: DataFrame, entity: Sequence[str], order: Sequence[str], values: dict[str, str], differences: dict[str, tuple[str, str]]
) -> DataFrame:
    """Rows whose stored previous values or differences are not the recomputed ones.

    ``values`` maps a stored previous column to its source column, ``differences``
    a stored difference to (current, previous).  The grain (entity, order) is
    unique, so a partition holds one row per period.
    """
    w = Window.partitionBy(*entity).orderBy(*order)
    wrong = [~F.col(stored).eqNullSafe(F.lag(source).over(w)) for stored, source in values.items()]
    wrong += [~F.col(d).eqNullSafe(F.col(a) - F.col(b)) for d, (a, b) in differences.items()]
    marked = df.withColumn("_wrong", reduce(lambda a, b: a | b, wrong))
    return marked.filter("_wrong").drop("_wrong")


TOLERANCE = 1e-10  # fixed value: relative to the expected number, at least absolute


def far_apart(found: Column, expected: Column, relative: float = TOLERANCE, absolute: float = TOLERANCE) -> Column:
    """True when two numbers differ in NULL-ness, are NaN, or lie too far apart."""
    limit = F.greatest(F.lit(absolute), F.lit(relative) * F.abs(expected))
    return (
        (found.isNull() != expected.isNull())
        | F.coalesce(F.isnan(found), F.lit(False))
        | F.coalesce(F.abs(found - expected) > limit, F.lit(False))
    )


def reconcile_aggs(
    stored: DataFrame, expected: DataFrame, keys: Sequence[str], exact: Sequence[str], approx: Sequence[str]
) -> DataFrame:
    """Keys whose stored aggregates are missing, extra or different from the recomputed ones."""
    return _compare(stored, expected, keys, exact, approx, TOLERANCE, TOLERANCE)


def _compare(a: DataFrame, b: DataFrame, keys, exact, approx, relative: float, absolute: float) -> DataFrame:
    left = a.withColumn("_a", F.lit(True)).alias("a")
    right = b.withColumn("_b", F.lit(True)).alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    marks = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in exact]
    marks += [
        F.when(far_apart(F.col(f"a.{c}").cast("double"), F.col(f"b.{c}").cast("double"), relative, absolute), F.lit(c))
        for c in approx
    ]
    problem = (
        F.when(F.col("a._a").isNull(), "<missing>")
        .when(F.col("b._b").isNull(), "<extra>")
        .otherwise(F.concat_ws("|", F.array_compact(F.array(*marks))))
    )
    return (
        left.join(right, on, "full_outer")
        .select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], problem.alias("differing"))
        .filter("differing <> ''")
    )


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Differences of two tables by key: schema order and types, key sets, values.

    Doubles may differ by 1e-9, or 1e-12 of their size.  Schema differences come
    as rows with NULL keys.
    """
    fields = [(n, t) for n, t in a.dtypes if n not in exclude]
    other = [(n, t) for n, t in b.dtypes if n not in exclude]
    values = [n for n, t in fields if n not in keys and (n, t) in other]
    kinds = dict(fields)
    approx = [n for n in values if kinds[n] in ("double", "float")]
    rows = _compare(a, b, keys, [n for n in values if n not in approx], approx, 1e-12, 1e-9)
    if fields == other:
        return rows
    shape = assert_schema(b.select(*[n for n, _ in other]), fields)
    return rows.unionByName(
        shape.select(
            *[F.lit(None).cast(kinds[k]).alias(k) for k in keys],
            F.concat(F.lit("<schema "), F.col("ordinal").cast("string"), F.lit(">")).alias("differing"),
        )
    )


def layer_status(tables: Sequence[tuple[str, DataFrame | None]]) -> DataFrame:
    """Per layer whether it has rows; at most one row of each table is read."""
    frames = [
        df.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows")).select(F.lit(name).alias("layer"), "has_rows")
        for name, df in tables
        if df is not None
    ]
    return reduce(DataFrame.unionByName, frames)


def table_counts(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(table, rows) of several tables."""
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables]
    return reduce(DataFrame.unionAll, frames)


