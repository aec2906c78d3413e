import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from strataforge.functions.windows import ordered_neighbours, percent_rank_global, rank_in_order, rows_between
from strataforge.operators.history import version_history
from strataforge.session import staged

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3), st.integers(-1000, 1000)), min_size=1, max_size=60))
def test_percent_rank_equals_the_window(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int").repartition(5)
    w = Window.orderBy(F.col("v").desc_nulls_last())
    wanted = sorted((r.id, r.p) for r in df.withColumn("p", F.percent_rank().over(w)).collect())
    found = sorted((r.id, r.p) for r in percent_rank_global(df, "v", "p").collect())
    assert found == wanted


def skewed(spark, n=5000):
    """One key with a third of the rows, and NULL keys."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        (F.xxhash64("id") % 1000).alias("v"),
        "id",
    )


def test_rank_in_order_equals_row_number(spark):
    df = skewed(spark)
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    wanted = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    assert rank_in_order(df, ["k"], order).exceptAll(wanted).count() == 0
    assert rank_in_order(df, ["k"], order).count() == df.count()


def test_rank_in_order_splits_a_large_key(spark):
    df = skewed(spark, 50_000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sorted_parts = df.orderBy("k", "v", "id").withColumn("p", F.spark_partition_id())
        assert sorted_parts.filter("k = 'hot'").select("p").distinct().count() > 1
        wanted = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")).cast("bigint"))
        assert rank_in_order(df, ["k"], [F.col("v"), F.col("id")]).exceptAll(wanted).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("start", [0, 4990, 150_000])
def test_rows_between(spark, start):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("v"))
    wanted = [r.v for r in df.orderBy("v").collect()][start : start + 10]
    assert [r.v for r in rows_between(df, ["v"], start, 10).collect()] == wanted


def test_ordered_neighbours_equal_the_windows(spark):
    df = skewed(spark).union(spark.range(50).selectExpr("CAST(NULL AS STRING)" if dict(skewed(spark).dtypes)["k"] == "string" else "CAST(NULL AS BIGINT)", "id", "id + 900000000")).repartition(5)
    w = Window.partitionBy("k").orderBy("v", "id")
    wanted = df.select(
        "k", "v", "id",
        F.row_number().over(w).cast("bigint").alias("n"),
        F.lag("id").over(w).alias("before"),
        F.lead("v").over(w).alias("after"),
    )
    found = ordered_neighbours(df, ["k"], ["v", "id"], number="n", previous={"before": F.col("id")}, following={"after": F.col("v")})
    assert found.count() == df.count() and found.exceptAll(wanted).count() == 0


def test_a_record_with_a_million_changes_in_one_day(spark):
    changes = spark.range(1_000_000).select(
        F.lit(7).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 1000).alias("ts"), "id", (F.col("id") % 3).alias("x"), F.lit(0).alias("y")
    )
    df = changes.union(changes.limit(20).withColumn("k", F.lit(1))).repartition(8)
    found = version_history(df, "k", "ts", "id", ["x", "y"])
    w = Window.partitionBy("k").orderBy("ts", "id")
    numbered = df.select("k", "id", F.row_number().over(w).cast("bigint").alias("version_number"), F.lead("ts").over(w).alias("valid_to"), F.lag("x").over(w).alias("was"))
    both = found.join(numbered, ["k", "id"])
    wrong = (found.version_number != numbered.version_number) | ~found.valid_to.eqNullSafe(numbered.valid_to)
    wrong = wrong | ((F.size("changes") > 0) != F.coalesce(numbered.was != found.x, F.lit(False)))
    assert both.count() == df.count() and both.where(wrong).count() == 0
    # the long record lies in several tasks
    parts = staged(df.orderBy("k", "ts", "id").withColumn("p", F.spark_partition_id()), "parts")
    assert parts.where("k = 7").select("p").distinct().count() > 3


def test_history_reports_values_that_become_null(spark):
    df = spark.createDataFrame(
        [(1, 10, 1, "a", 5), (1, 20, 2, "a", None), (1, 30, 3, "b", None)], "k int, s int, id int, x string, y int"
    ).withColumn("ts", F.timestamp_seconds(F.col("s") * 90_000)).withColumn("_op", F.when(F.col("id") == 3, "delete"))
    found = version_history(df, "k", "ts", "id", ["x", "y"]).orderBy("version_number").collect()
    assert [r.operation for r in found] == ["INSERT", "UPDATE", "DELETE"]
    assert [[tuple(c) for c in r.changes] for r in found] == [[], [("y", "5", None)], [("x", "a", "b")]]
    assert [r.is_current for r in found] == [False, False, True]
    assert found[0].valid_to == found[1].valid_from
