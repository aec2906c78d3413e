import os

import pytest
from pyspark.sql import functions as F

from strataforge.operators import cdc
from strataforge.plans import contexts
from strataforge.session import scratch
from strataforge.sources import sinks
from strataforge.sources.entities import read_entity_files, widest


@pytest.fixture()
def folder(spark):
    path = scratch(spark, "test-files")
    os.makedirs(path)

    def put(name, text):
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        with open(f"{path}/{name}", "w", encoding="utf-8") as out:
            out.write(text)
        return f"{path}/{name}"

    put.root = path
    return put


@pytest.mark.parametrize(
    "kinds, wanted",
    [
        (["int", "bigint"], "bigint"), (["bigint", "double"], "double"), (["float", "decimal(5,2)"], "double"),
        (["int", "decimal(5,2)"], "decimal(12,2)"), (["decimal(38,0)", "decimal(38,10)"], "string"), (["date", "timestamp"], "timestamp"),
        (["boolean", "int"], "string"), (["date", "int"], "string"), (["void", "date"], "date"), (["void"], "string"), (["array<bigint>", "string"], "string"),
    ],
)
def test_widest(kinds, wanted):
    assert widest(kinds) == widest(reversed(kinds)) == wanted


def test_files_of_four_formats(spark, folder, rows):
    spark.createDataFrame([(9, "p")], "Id int, Name string").write.parquet(f"{folder.root}/g.parquet")
    spark.createDataFrame([("x10", "p")], "Id string, Name string").write.parquet(f"{folder.root}/h.parquet")
    paths = [
        folder("a b%.csv", 'Id,Name,When\n1,x,2024-01-01\n2,"y,""z",2024-01-02\n3,only\n'),
        folder("b.CSV", "Name,Id\nq,4\nr,5,extra\n"),
        folder("c.tsv", "\nId\tAmount\n6\t1.5\n"),
        folder("d.json", '{"id": 7, "amount": 3, "tags": [1,2]}\n{"id": broken\n'),
        folder("e.json", '[\n{"id": 8,\n "name": "arr"},\n {"id": 11}]\n'),
        folder("f.csv", ""), folder("g.csv", "Id,Name\n"),
        f"{folder.root}/g.parquet", f"{folder.root}/h.parquet",
    ]
    found, refused = read_entity_files(spark, paths)
    assert dict(found.dtypes) == {"id": "string", "name": "string", "when": "date", "amount": "double", "tags": "array<bigint>"}
    assert rows(found, "id", "name", "amount") == sorted(
        [("1", "x", None), ("2", 'y,"z', None), ("4", "q", None), ("6", None, 1.5), ("7", None, 3.0), ("8", "arr", None), ("11", None, None), ("9", "p", None), ("x10", "p", None)],
        key=repr,
    )
    assert {r["record"] for r in refused.collect()} == {"3,only", "r,5,extra", '{"id": broken'}


def test_entity_without_text(spark, folder):
    with pytest.raises(ValueError):
        read_entity_files(spark, [folder("a.csv", ""), folder("b.json", "\n")])


def test_values_with_line_breaks(spark, folder, rows):
    path = folder("a.csv", 'id,note\n1,"two\nlines"\n2,one\n')
    found, refused = read_entity_files(spark, [path], multiline=True)
    assert rows(found) == [(1, "two\nlines"), (2, "one")] and refused.isEmpty()


def manifest(spark, put, files):
    listed = [("shop", name.split("/")[0], put(f"staging/{name}", text)) for name, text in files.items()]
    return spark.createDataFrame(listed, "context_id string, entity string, path string")


ORDERS = "order_id,customer_id,total\n" + "".join(f"{i},{i % 4},{i * 10}\n" for i in range(1, 13))
CUSTOMERS = "".join(f'{{"customer_id": {i}, "segment": "s{i % 2}"}}\n' for i in range(4))
VISITS = "order_id,page\n" + "".join(f"{i % 12 + 1},p{i % 2}\n" for i in range(48))


def test_two_runs_of_a_context(spark, folder, rows):
    out = f"{folder.root}/out"
    one = manifest(spark, folder, {"orders/a.csv": ORDERS, "customers/a.json": CUSTOMERS, "visits/a.csv": VISITS})
    first = contexts.process_context(spark, one, "shop", out, "r1")
    roles = {r["entity"]: (r["role"], list(r["key"]), r["rows"]) for r in first.contract}
    assert roles["orders"] == ("anchor", ["order_id"], 12) and roles["customers"] == ("dimension", ["customer_id"], 4)
    assert roles["mart"] == ("mart", ["order_id"], 12)
    # no column or pair tells visits apart, so different rows are all kept and equal ones are one
    assert roles["visits"] == ("fact", [], 12)
    assert rows(first.mart.filter("order_id = 1"), "total", "customers__segment", "visits__record_count") == [(10, "s1", 1)]

    # a few rows only: the key of the contract holds; a new column, an id as text, a row without key, a broken row
    more = manifest(spark, folder, {"orders/b.csv": "order_id,customer_id,total,channel\n1,2,11,web\n13,3,130,app\n,3,9,app\n14,1\n", "customers/b.json": '{"customer_id": 9, "segment": "s9"}\n', "visits/b.csv": "order_id,page,seconds\n1,p0,\n1,p9,5\n"})
    second = contexts.process_context(spark, more, "shop", out, "r2")
    kept = {r["entity"]: (r["sequence"], r["rows"], r["refused"]) for r in second.contract}
    assert kept == {"orders": (2, 13, 2), "customers": (2, 5, 0), "visits": (2, 13, 0), "mart": (2, 13, 0)}
    assert rows(second.mart.filter("order_id IN (1, 2, 13)"), "order_id", "total", "channel", "customers__segment", "visits__record_count") == [
        (1, 11, "web", "s0", 2), (13, 130, "app", "s1", None), (2, 20, None, "s0", 1),
    ]
    rejected = spark.read.parquet(f"{out}/shop/quarantine")
    assert rows(rejected, "_batch", "entity", "rejection_reason") == [("r2", "orders", "MISSING_KEY"), ("r2", "orders", "UNREADABLE_RECORD")]

    # a run that is there is not made again; the earlier one can still be read
    again = contexts.process_context(spark, one, "shop", out, "r2")
    assert again.contract == second.contract
    assert contexts.published(spark, out, "shop", "r1").mart.count() == 12


def test_entities_without_new_files_keep_their_state(spark, folder):
    out = f"{folder.root}/out"
    first = contexts.process_context(spark, manifest(spark, folder, {"orders/a.csv": ORDERS, "customers/a.json": CUSTOMERS, "visits/a.csv": VISITS}), "shop", out, "r1")
    second = contexts.process_context(spark, manifest(spark, folder, {"customers/b.json": '{"customer_id": 1, "segment": "new"}\n'}), "shop", out, "r2")
    paths = [{r["entity"]: r["path"] for r in run.contract} for run in (first, second)]
    assert paths[0]["orders"] == paths[1]["orders"] and paths[0]["customers"] != paths[1]["customers"]
    assert second.mart.filter("customers__segment = 'new'").count() == 3


def test_failed_run_publishes_nothing(spark, folder, monkeypatch):
    out = f"{folder.root}/out"
    files = {"orders/a.csv": ORDERS + "99,1\n", "customers/a.json": CUSTOMERS, "visits/a.csv": VISITS}
    real = contexts.star.star_join
    monkeypatch.setattr(contexts.star, "star_join", lambda *a: real(*a).filter("order_id > 3"))
    with pytest.raises(contexts.ContextRefused):
        contexts.process_context(spark, manifest(spark, folder, files), "shop", out, "r1")
    assert contexts.published(spark, out, "shop") is None
    monkeypatch.undo()
    run = contexts.process_context(spark, manifest(spark, folder, files), "shop", out, "r1")
    assert run.mart.count() == 12 and spark.read.parquet(f"{out}/shop/quarantine").count() == 1


def test_context_without_safe_anchor(spark, folder):
    files = {"a/a.csv": "kind,size\n" + "x,1\nx,1\ny,2\ny,2\n" * 5}
    with pytest.raises(contexts.ContextRefused):
        contexts.process_context(spark, manifest(spark, folder, files), "shop", f"{folder.root}/out", "r1")
    with pytest.raises(contexts.ContextRefused):
        contexts.process_context(spark, manifest(spark, folder, files), "other", f"{folder.root}/out", "r1")


REPEATED = [(1, "a", 1), (1, "b", 2), (2, "a", 3), (None, "c", 4), (None, "c", 5), (3, "c", 6), (3, "c", 6), (4, "d", 7)]


def test_repair_keeps_one_row_per_key(spark, rows):
    df = spark.createDataFrame(REPEATED, "id int, part string, n int")
    repaired, audit = cdc.repair_duplicates(df, ["id"], [F.desc("n")])
    assert rows(repaired) == sorted([(1, "b", 2), (2, "a", 3), (None, "c", 5), (3, "c", 6), (4, "d", 7)], key=repr)
    assert rows(audit) == [(3, 0)]
    clean, audit = cdc.repair_duplicates(df.limit(0), ["id"], [F.desc("n")])
    assert clean.isEmpty() and rows(audit) == [(0, 0)]


def test_repair_does_not_shuffle_rows_of_single_keys(spark):
    path = scratch(spark, "test-repair")
    spark.range(20000).selectExpr("id", "repeat('x', 50) AS text", "id AS n").union(spark.sql("SELECT 5L, 'y', 1L")).write.parquet(path)
    repaired, _ = cdc.repair_duplicates(spark.read.parquet(path), ["id"], [F.desc("n")])
    plan = repaired._jdf.queryExecution().executedPlan().toString()
    (anti,) = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert "BroadcastHashJoin" in anti
    assert plan.count("Exchange hashpartitioning") == 1  # the few rows of repeated keys, for their rank
    assert repaired.count() == 20000


def test_repair_rewrites_only_partitions_with_repeats(spark, rows):
    path = scratch(spark, "test-partitions")
    spark.createDataFrame([*REPEATED, (5, None, 8), (5, "e", 9)], "id int, part string, n int").write.partitionBy("part").parquet(path)
    before = {f for f in spark.read.parquet(path).inputFiles() if "/part=d/" in f}
    assert sinks.repair_partitions(spark, path, ["part"], ["id"], [F.desc("n")]) == 5
    wanted = sorted([(1, 2, "b"), (2, 3, "a"), (None, 5, "c"), (3, 6, "c"), (4, 7, "d"), (5, 9, "e")], key=repr)
    assert rows(spark.read.parquet(path), "id", "n", "part") == wanted
    after = spark.read.parquet(path).inputFiles()
    assert before and {f for f in after if "/part=d/" in f} == before and not any("HIVE_DEFAULT" in f for f in after)
    assert sinks.repair_partitions(spark, path, ["part"], ["id"], [F.desc("n")]) == 0


def test_context_lines_are_computed_once(spark):
    """Both runs land lines, so their choice is read from files, not made again for each landing."""
    from types import SimpleNamespace

    from strataforge.plans.catalog.datasets import context_lines

    rows = [(1, 5, 10, "A"), (1, 5, 10, "A"), (1, 5, 12, "A"), (1, 7, 1, "B"), (None, 2, 3, "A"), (2, None, None, None)]
    lines = context_lines(SimpleNamespace(v_context_lines=spark.createDataFrame(rows, "order_id long, quantity long, amount long, return_flag string")))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert sorted(r.line_id for r in lines.collect()) == ["1-A", "1-B", "2", "A"]
    assert [r.amount for r in lines.filter("line_id = '1-A'").collect()] == [12]
