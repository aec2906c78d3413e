from strataforge import session


def test_partitions_grow_with_the_input():
    assert session.shuffle_partitions_for(10 * 1024**2, 8) == 8
    assert session.shuffle_partitions_for(1024**4, 200) == 12288
    assert session.shuffle_partitions_for(100 * 1024**4, 200) == 1228800


def test_shuffles_start_with_enough_partitions(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        assert session.size_shuffles(spark, 10 * 1024**3) == 120
        parts = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
        plan = parts._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and ", 120)" in plan
    finally:
        assert session.size_shuffles(spark, 0) == usual


def test_stored_bytes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 100)
    (tmp_path / "b").write_bytes(b"x" * 28)
    assert session.stored_bytes(spark, str(tmp_path)) == 128


def test_scratch_is_never_reused(spark):
    assert session.scratch(spark, "x") != session.scratch(spark, "x")
