"""Aggregate marts, period comparison, forecast and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataforge.functions import text
from strataforge.functions.frames import attach
from strataforge.functions.windows import percent_rank_global
from strataforge.operators.cdc import first_per_key

# Tiers, states and advice written into the marts.
KPI_TARGET = 100.0
TIERS = ("TIER_A", "TIER_B", "TIER_C")
HEALTH = ("HEALTHY", "AT_RISK", "CRITICAL")
PRIORITY = ("LOW", "MEDIUM", "HIGH")
RISK = ((0.05, 0.15), (0.40, 0.25), (0.70, 0.30))  # base and share of the rank, per state
KPI_ADVICE = (
    "Duy trì hiệu suất / Đề xuất vinh danh khen thưởng",
    "Đôn đốc tiến độ / Cảnh báo nguy cơ chậm trễ",
    "Cần can thiệp khẩn / Rà soát nguyên nhân không đạt chỉ tiêu",
)
ADVICE_BY_FAMILY = (
    (
        ("student", "award", "tuition", "hoc_tap", "diem"),
        (
            "Đạt chuẩn xuất sắc / Đề xuất vinh danh khen thưởng",
            "Cần bổ trợ kiến thức / Theo dõi sát sao",
            "Cố vấn học vụ can thiệp / Cảnh báo học tập",
        ),
    ),
    (
        ("genshin", "game", "character"),
        (
            "Top Meta / Nhân vật chủ lực - duy trì ưu tiên tài nguyên",
            "Chỉ số trung bình / Cần tối ưu build vũ khí & di vật",
            "Hiệu suất thấp / Cần buff chỉ số hoặc rerun banner",
        ),
    ),
    (
        ("iot", "telemetry", "sensor", "device", "cam_bien"),
        (
            "Chỉ số an toàn chuẩn / Thiết bị hoạt động ổn định",
            "Thông số tiệm cận ngưỡng rủi ro / Kiểm tra định kỳ thiết bị",
            "Cảnh báo vượt ngưỡng cảm biến / Cần bảo trì thiết bị khẩn",
        ),
    ),
)
GENERAL_ADVICE = (
    "Đạt chuẩn SLA / Duy trì và nhân rộng mô hình",
    "Theo dõi sát / Cần kế hoạch nâng cao hiệu suất",
    "Ưu tiên can thiệp khẩn / Kiểm toán rủi ro hoạt động",
)
AVERAGED_NAMES = ("diem", "gpa", "tbrl", "atk", "hp", "def", "rate", "score")
SCORED_NAMES = (
    "pulled_count", "amount_paid", "tuition_amount", "amount", "revenue", "sales",
    "diem_tb", "gpa", "lvl_90_atk", "score", "so_tcdk", "diem_tbrl",
)


def lookup(df: DataFrame, column: str, mapping: Mapping[str, str] | DataFrame, name: str) -> DataFrame:
    """Add the label of a code; unknown codes get NULL.

    A dictionary becomes a literal map.  A DataFrame (code, label) is joined;
    Spark broadcasts it when its measured size allows.
    """
    if isinstance(mapping, DataFrame):
        code, label = mapping.columns[:2]
        labels = mapping.select(F.col(code).alias("_code"), F.col(label).alias(name))
        return df.join(labels, F.col(column) == F.col("_code"), "left").drop("_code")
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(name, F.try_element_at(pairs, F.col(column)))


def by_level(level: Column, choices: Sequence) -> Column:
    """Value of the state in ``level`` (good, at risk, critical)."""
    values = [c if isinstance(c, Column) else F.lit(c) for c in choices]
    return F.when(level == HEALTH[2], values[2]).when(level == HEALTH[1], values[1]).otherwise(values[0])


def _score(df: DataFrame, achieved: str, healthy: float, at_risk: float, tier: Column, advice: Sequence[str]) -> DataFrame:
    """Columns that both scorings share, from the rank ``p_rank`` and an achievement column."""
    rank, level = F.col("p_rank"), F.col("health_status")
    risk = [F.lit(base) + F.lit(share) * rank for base, share in RISK]
    return (
        df.withColumn("performance_tier", tier)
        .withColumn(
            "health_status",
            F.when(F.col(achieved) >= healthy, HEALTH[0]).when(F.col(achieved) >= at_risk, HEALTH[1]).otherwise(HEALTH[2]),
        )
        .withColumn("action_priority", by_level(level, PRIORITY))
        .withColumn("risk_score", F.round(by_level(level, risk), 2))
        .withColumn("alert_flag", level != HEALTH[0])
        .withColumn("recommended_action", by_level(level, advice))
    )


def kpi_summary(
    df: DataFrame, period: str = "period", unit: str = "unit", result: str = "result", value: str = "value_num"
) -> DataFrame:
    """Per period and unit: totals, passed, failed, value sum and average, completion percent.

    Rows not yet due are left out.  A missing value counts as 0 in sum and average.
    """
    number = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    return (
        df.filter(F.col(result) != "NOT_DUE")
        .groupBy(period, unit)
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            F.count(F.when(F.col(result) == "PASSED", 1)).alias("passed"),
            F.count(F.when(F.col(result) == "FAILED", 1)).alias("failed"),
            F.round(F.sum(number), 2).alias("value_sum"),
            F.round(F.avg(number), 2).alias("value_avg"),
        )
        .withColumn("completion_pct", F.round(F.col("passed") / F.col("total_records") * 100, 2))
    )


def decision_fields_kpi(summary: DataFrame, ratio: str = "completion_pct") -> DataFrame:
    """Target, variance, tier (rank or achievement), state, priority, risk, alert, advice."""
    ranked = percent_rank_global(summary, ratio)
    rank, achieved = F.col("p_rank"), F.col("target_achievement_pct")
    tier = (
        F.when((rank <= 0.20) | (achieved >= 90.0), TIERS[0])
        .when((rank <= 0.50) | (achieved >= 75.0), TIERS[1])
        .otherwise(TIERS[2])
    )
    fields = (
        ranked.withColumn("target_value", F.lit(KPI_TARGET))
        .withColumn("target_achievement_pct", F.col(ratio))
        .withColumn("target_variance_amount", F.round(F.col(ratio) - KPI_TARGET, 2))
    )
    return (
        _score(fields, "target_achievement_pct", 85.0, 60.0, tier, KPI_ADVICE)
        .withColumn("aging_days", F.lit(0))
        .drop("p_rank")
    )


def kpi_detail(df: DataFrame, columns: Sequence[str], unit: str, labels) -> DataFrame:
    return lookup(df.select(*columns), unit, labels, "unit_label")


def compare_periods(
    df: DataFrame,
    entity: str = "indicator",
    period: str = "period",
    value: str = "value_num",
    sort_key: str | None = None,
) -> DataFrame:
    """Previous available period and value per entity, and growth percent.

    Input holds one row per entity and period (the gate ``duplicate_keys``), so
    an entity has as many rows as there are periods.  Quarters, months and years have
    one total order, so the result does not depend on the order of the rows.
    """
    key = F.struct(sort_key, period) if sort_key else text.period_order(F.col(period))
    w = Window.partitionBy(entity).orderBy(key)
    before = F.col("previous_value")
    growth = F.round((F.col(value) - before) / F.when(before != 0, before) * 100, 2)
    return (
        df.withColumn("previous_period", F.lag(period).over(w))
        .withColumn("previous_value", F.lag(value).over(w))
        .withColumn("growth_pct", growth)
    )


def indicator_dictionary(
    df: DataFrame, entity: str = "indicator", unit: str = "unit", period: str = "period", note: str = "description"
) -> DataFrame:
    """Per indicator and unit: description of the earliest row that has one, first and latest period."""
    key = text.period_order(F.col(period))
    return df.groupBy(entity, unit).agg(
        F.min_by(F.col(note), F.when(F.col(note).isNotNull(), F.struct(key, F.col(note)))).alias(note),
        F.min_by(F.col(period), key).alias("first_period"),
        F.max_by(F.col(period), key).alias("latest_period"),
    )


def latest_per_group(df: DataFrame, group: str, sort_key: Column) -> DataFrame:
    """Rows of the latest period of each group; ties of the period are kept.

    Spark limits the ranks before the exchange, so earlier rows are not shuffled.
    """
    w = Window.partitionBy(group).orderBy(sort_key.desc_nulls_last())
    return df.withColumn("_rank", F.rank().over(w)).filter("_rank = 1").drop("_rank")


def forecast(comparison: DataFrame, entity: str = "indicator", period: str = "period", value: str = "value_num") -> DataFrame:
    """Next-period value from growth weighted 1..n in period order; no growth known means 0."""
    key = text.period_order(F.col(period))
    known = comparison.filter(F.col("growth_pct").isNotNull()).withColumn(
        "_weight", F.row_number().over(Window.partitionBy(entity).orderBy(key))
    )
    # growth has two decimals, so exact decimals make the sum independent of row order
    weighted = F.sum(F.col("growth_pct").cast("decimal(24,2)") * F.col("_weight")).cast("double")
    growth = known.groupBy(entity).agg((weighted / F.sum("_weight")).alias("avg_growth_pct"))
    latest = latest_per_group(comparison, entity, key)
    return (
        latest.join(growth, entity, "left")
        .withColumn("avg_growth_pct", F.coalesce("avg_growth_pct", F.lit(0.0)))
        .select(
            *[c for c in (entity, "unit") if c in comparison.columns],
            F.col(period).alias("current_period"),
            F.col(value).alias("current_value"),
            text.next_period(F.col(period)).alias("next_period"),
            F.round(F.col(value) * (1 + F.col("avg_growth_pct") / 100), 2).alias("next_value"),
            "avg_growth_pct",
        )
    )


# name, numerator, denominator, scale
OUTCOME_RATIOS = (
    ("pass_rate", "passed", "attempted", 100.0),
    ("gpa_mean", "gpa_points", "gpa_students", None),
    ("on_track_rate", "on_track", "evaluated", 100.0),
)


def with_ratios(df: DataFrame, ratios=OUTCOME_RATIOS) -> DataFrame:
    return df.withColumns(
        {name: text.safe_ratio(F.col(part), F.col(whole), scale) for name, part, whole, scale in ratios}
    )


def filter_active(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Rows not deleted; an unknown flag leaves the row out."""
    return df.filter(F.col(flag) == F.lit(False))


def delete_where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which the predicate is not true; an unknown result keeps the row."""
    return df.filter(~F.coalesce(F.expr(predicate), F.lit(False)))


def left_join_all(base: DataFrame, sides: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join of several tables that hold at most one row per key.

    The key stays the partitioning of every join, so the base is shuffled once.
    """
    for side in sides:
        base = base.join(side, key, "left")
    return base


def outcome_fact(df: DataFrame, ratios=OUTCOME_RATIOS, join_back: bool = False) -> DataFrame:
    """Ratios, the previous available period per programme, and differences.

    (program, academic_year, semester) is the grain, so a programme has one row
    per period.  ``join_back`` keeps wide rows out of the window sort: the window
    runs on the keys and ratios only and is joined back on the grain.
    """
    names = [r[0] for r in ratios]
    metrics = with_ratios(filter_active(df), ratios).withColumn(
        "start_year", text.academic_start_year(F.col("academic_year"))
    )
    w = Window.partitionBy("program").orderBy("start_year", "semester")
    previous = {
        "previous_year": F.lag("academic_year").over(w),
        "previous_semester": F.lag("semester").over(w),
        **{f"previous_{n}": F.lag(n).over(w) for n in names},
    }
    grain = ["program", "start_year", "semester"]
    if join_back:
        narrow = metrics.select(*grain, "academic_year", *names).select(
            *grain, *[c.alias(n) for n, c in previous.items()]
        )
        full = metrics.join(narrow, grain)
    else:
        full = metrics.withColumns(previous)
    return full.withColumns({f"change_{n}": F.col(n) - F.col(f"previous_{n}") for n in names})


def period_mart(fact: DataFrame, ratios=OUTCOME_RATIOS) -> DataFrame:
    """Per year and semester: programmes, summed parts and wholes, ratios of the sums."""
    parts = list(dict.fromkeys(c for _, part, whole, _ in ratios for c in (part, whole)))
    totals = fact.groupBy("academic_year", "semester").agg(
        F.countDistinct("program").alias("programs"), *[F.sum(c).alias(c) for c in parts]
    )
    return with_ratios(totals, ratios)


# Ratings of a unit, best first; progress limit and feedback limit.
RATINGS = (("Xuất sắc", 98.5, 4.60), ("Tốt", 97.0, None), ("Đạt", 96.0, None), ("Cần theo dõi", 93.0, None))
LOWEST_RATING = "Cần cải thiện"


def unit_scorecard(sections: DataFrame, metrics: Sequence[DataFrame], changes: DataFrame) -> DataFrame:
    """Per unit: sections, mean figures, change requests, formatted texts and a rating.

    Sections and their figures are 1:1; change requests are 1:N and are counted
    apart, so they cannot multiply the averages.
    """

    def mean(column: str, digits: int) -> Column:
        return F.round(F.avg(F.col(column).cast("decimal(9,4)")), digits)

    base = left_join_all(sections, metrics, "section_code")
    scores = base.groupBy("unit_code").agg(
        F.count("section_code").alias("sections"),
        mean("progress_pct", 1).alias("progress"),
        mean("attendance_pct", 1).alias("attendance"),
        mean("grading_pct", 1).alias("grading"),
        mean("feedback", 2).alias("feedback"),
    )
    per_section = changes.groupBy("section_code").agg(F.count(F.lit(1)).alias("_n"))
    moved = (
        per_section.join(sections.select("section_code", "unit_code"), "section_code")
        .groupBy("unit_code")
        .agg(F.sum("_n").alias("changes"))
    )
    rating = F.lit(LOWEST_RATING)
    for label, progress, feedback in reversed(RATINGS):
        reached = F.col("progress") >= progress
        if feedback is not None:
            reached = reached & (F.col("feedback") >= feedback)
        rating = F.when(reached, label).otherwise(rating)

    def shown(column: str, form: str, suffix: str) -> Column:
        return F.concat(F.format_string(form, F.col(column).cast("double")), F.lit(suffix))

    return scores.join(moved, "unit_code", "left").select(
        "unit_code",
        "sections",
        F.when(F.col("progress").isNotNull(), shown("progress", "%.1f", "%")).alias("progress_text"),
        F.when(F.col("attendance").isNotNull(), shown("attendance", "%.1f", "%")).alias("attendance_text"),
        F.when(F.col("grading").isNotNull(), shown("grading", "%.1f", "%")).alias("grading_text"),
        F.coalesce("changes", F.lit(0)).cast("bigint").alias("changes"),
        F.when(F.col("feedback").isNotNull(), shown("feedback", "%.2f", "/5")).alias("feedback_text"),
        rating.alias("rating"),
    )


def section_fact(df: DataFrame, passthrough: Sequence[str], lineage: Mapping[str, str]) -> DataFrame:
    """Pass-through columns, a constant monitor count and row lineage columns."""
    return df.select(
        *passthrough,
        F.lit(1).cast("bigint").alias("monitored"),
        *[F.col(source).alias(name) for name, source in lineage.items()],
    )


def generic_gold(
    df: DataFrame, dimensions: Sequence[str], metrics: Sequence[str], keys: Sequence[str] = (), time: str | None = None
) -> DataFrame:
    """Per dimensions: rows, and rounded sum and mean of each metric.

    An epoch time column becomes a timestamp and joins the dimensions.  Without
    dimensions the business keys are used.
    """
    kinds = dict(df.dtypes)
    by = [c for c in dimensions if c in kinds]
    if time and time in kinds:
        if text.is_numeric_type(kinds[time]):
            df = df.withColumn(time, text.epoch_to_timestamp(F.col(time)))
        if time not in by:
            by.append(time)
    by = by or list(keys)
    figures = [F.count(F.lit(1)).alias("total_records")]
    for m in [m for m in metrics if m in kinds]:
        number = F.col(m).cast("double")
        figures += [F.round(F.sum(number), 2).alias(f"sum_{m}"), F.round(F.avg(number), 2).alias(f"avg_{m}")]
    return df.groupBy(*by).agg(*figures)


def scored_column(metrics: Sequence[str]) -> str:
    """Column of a generic mart that is scored: average of rate-like names, else the sum, else the count."""
    if not metrics:
        return "total_records"
    metric = next((m for word in SCORED_NAMES for m in metrics if word in m), metrics[0])
    return ("avg_" if any(word in metric for word in AVERAGED_NAMES) else "sum_") + metric


def advice_for(entity: str) -> Sequence[str]:
    low = entity.lower()
    return next((texts for words, texts in ADVICE_BY_FAMILY if any(w in low for w in words)), GENERAL_ADVICE)


def decision_fields(
    gold: DataFrame, scored: str, entity: str = "", time: str | None = None, as_of=None
) -> DataFrame:
    """Scores against 115 % of the mean of the mart.

    The target is a scalar subquery of the same query.  A missing or zero mean
    counts as 100; the target is rounded half to even and is at least 1.
    """
    mean = F.avg(F.col(scored).cast("double"))
    bench = gold.agg(F.coalesce(F.when(mean != 0, mean), F.lit(100.0)).alias("_mean")).select(
        F.bround(F.col("_mean") * 1.15, 2).alias("_target")
    )
    target = bench.select(F.when(F.col("_target") > 0, F.col("_target")).otherwise(1.0).alias("target_value"))
    ranked = percent_rank_global(attach(gold, target), scored)
    rank = F.col("p_rank")
    tier = F.when(rank <= 0.20, TIERS[0]).when(rank <= 0.50, TIERS[1]).otherwise(TIERS[2])
    fields = ranked.withColumn(
        "target_achievement_pct", F.round(F.col(scored) / F.col("target_value") * 100.0, 1)
    ).withColumn("target_variance_amount", F.round(F.col(scored) - F.col("target_value"), 2))
    scored_rows = _score(fields, "target_achievement_pct", 90.0, 60.0, tier, advice_for(entity))
    age = text.aging_days(F.col(time), dict(gold.dtypes)[time], as_of) if time else F.lit(0)
    return scored_rows.withColumn("aging_days", age).drop("p_rank")


def dominant_period(df: DataFrame, document: str, period: Column) -> DataFrame:
    """Most frequent period of each document, number of candidates, and whether they conflict."""
    counts = (
        df.select(document, period.alias("period"))
        .filter("period IS NOT NULL")
        .groupBy(document, "period")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    candidates = counts.groupBy(document).agg(F.count(F.lit(1)).alias("candidates"))
    best = first_per_key(counts, [document], [F.col("_n").desc(), F.col("period")])
    everyone = df.select(document).distinct()
    return (
        everyone.join(best.join(candidates, document), document, "left")
        .select(
            document,
            F.coalesce("period", F.lit(text.UNKNOWN_PERIOD)).alias("period"),
            F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"),
            (F.coalesce("candidates", F.lit(0)) > 1).alias("warning"),
        )
    )


# States of one file.
ACTIVE_STATES = ("QUEUED", "DOWNLOADING", "PROCESSING")
SUCCESS_STATES = ("COMPLETED", "DUPLICATE")
FAILURE_STATES = ("FAILED", "UNSUPPORTED")


def rollup_status(df: DataFrame, job: str, state: str, cancel_requested: str | None = None) -> DataFrame:
    """State of a job from the states of its files; a job without files (NULL state) is pending."""
    s = F.col(state)

    def any_of(*states: str) -> Column:
        return F.bool_or(s.isin(*states))

    facts = df.groupBy(job).agg(
        F.count(s).alias("_files"),
        any_of(*ACTIVE_STATES).alias("_active"),
        any_of(*SUCCESS_STATES).alias("_success"),
        any_of(*FAILURE_STATES).alias("_failure"),
        F.bool_and(s.isin(*SUCCESS_STATES)).alias("_all_success"),
        F.bool_and(s == "CANCELLED").alias("_all_cancelled"),
        (F.bool_or(F.col(cancel_requested)) if cancel_requested else F.lit(False)).alias("_cancel"),
    )
    status = (
        F.when(F.col("_files") == 0, "PENDING")
        .when(F.col("_active"), "PROCESSING")
        .when(F.col("_cancel") & F.col("_all_cancelled"), "CANCELLED")
        .when(F.col("_all_success"), "COMPLETED")
        .when(F.col("_success") & F.col("_failure"), "PARTIAL_SUCCESS")
        .when(F.col("_failure"), "FAILED")
        .when(F.col("_all_cancelled"), "CANCELLED")
        .otherwise("FAILED")
    )
    return facts.select(job, F.col("_files").alias("files"), status.alias("status"))
