"""The state that a stream keeps between batches and runs."""

import pytest
from pyspark.sql import functions as F

from strataforge.streaming import land

DELIVERIES = [
    [(1, "a", 100, 1), (2, "a", 160, 2), (3, "b", 150, 3), (4, None, 155, 4)],
    [(2, "a", 160, 2), (5, "a", 130, 5), (6, "b", 200, 6), (7, "c", 145, 7)],  # repeated, older than the latest, newer
    [(8, "b", 139, 8), (9, "c", 250, 9), (6, "b", 200, 6), (10, "d", 140, 10), (11, "d", 141, 11)],  # 139 and 140 are late
]
SCHEMA = "event bigint, k string, s bigint, v bigint"


@pytest.fixture()
def run(spark, tmp_path):
    def deliver(rows=None):
        if rows is not None:
            df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_seconds("s"))
            df.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        figures = land.stream_changes(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), schema, ["k"], "event", "at", "60 seconds")
        return figures, land.current(spark, str(tmp_path / "out"), schema, ["k"], "event", "at")

    return deliver


def test_late_and_repeated_events_and_a_restart(spark, run, tmp_path):
    wanted = [
        {("a", 2), ("b", 3), (None, 4)},
        {("a", 2), ("b", 6), (None, 4), ("c", 7)},
        {("a", 2), ("b", 6), (None, 4), ("c", 9), ("d", 11)},
    ]
    late = []
    for rows, want in zip(DELIVERIES, wanted):
        figures, state = run(rows)
        late.append(figures["late"])
        assert figures["rows"] == len(rows)
        assert {(r.k, r.event) for r in state.collect()} == want
    assert late == [0, 0, 2]
    before = spark.read.parquet(str(tmp_path / "out")).count()
    figures, state = run()  # nothing new
    assert figures["rows"] == 0 and {(r.k, r.event) for r in state.collect()} == wanted[-1]
    assert spark.read.parquet(str(tmp_path / "out")).count() == before


def test_rows_without_time_hide_no_change_and_only_changes_are_written(spark, run, tmp_path):
    _, state = run([(1, "a", None, 1), (2, "a", 100, 2), (3, "b", 110, 3)])
    assert {(r.k, r.event) for r in state.collect()} == {("a", 2), ("b", 3)}
    _, state = run([(4, "a", 90, 4), (5, "b", 120, 5)])  # 4 is older than the latest of its key
    assert {(r.k, r.event) for r in state.collect()} == {("a", 2), ("b", 5)}
    assert sorted(r.event for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3, 5]


def test_no_python_runs_per_key(spark, run, monkeypatch):
    def refuse(*_args, **_kwargs):
        raise AssertionError("a Python call per key and batch")

    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInPandasWithState", refuse)
    assert run(DELIVERIES[0])[0]["rows"] == 4
