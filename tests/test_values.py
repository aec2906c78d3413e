"""Text, masking, planning, documents and readers on single cases."""

import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from strataforge.functions import checksum, masking, text
from strataforge.operators import audit, charts, marts, schema, star
from strataforge.operators.expectations import Expectation, apply_policy, validate
from strataforge.operators.quality import contract_violations, split_dq
from strataforge.plans.catalog.files import document_bytes
from strataforge.session import scratch
from strataforge.sources import documents, files, sinks


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Mã Chỉ Tiêu", "ma_chi_tieu"),
        ("studentID", "student_id"),
        ("HTTPServerName", "http_server_name"),
        ("Đơn-vị (tên)", "don_vi_ten"),
        ("__a  b__", "a_b"),
        ("???", "col"),
        ("Q4Total", "q4_total"),
    ],
)
def test_snake_case(name, expected):
    assert text.snake_case(name) == expected


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Quý 3 / 2025", "Q3/2025"),
        ("QUY 1 NĂM 2024", "Q1/2024"),
        ("năm 2024", "NĂM 2024"),
        ("Tháng 7/2024", "T7/2024"),
        ("tuần 3", "TUẦN 3"),
        ("N/A", None),
        ("", None),
        (None, None),
    ],
)
def test_normalize_period(spark, value, expected):
    assert one(spark, value, text.normalize_period) == expected


@pytest.mark.parametrize("value, expected", [(" 12,5% ", 12.5), ("7", 7.0), ("N/A", None), ("", None), (None, None), ("x1", None)])
def test_parse_number(spark, value, expected):
    assert one(spark, value, text.parse_number) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("Không đạt", "FAILED"), ("đạt", "PASSED"), ("chưa đến kỳ", "NOT_DUE"), ("success", "PASSED"), ("a\nb", "A B"), (None, None)],
)
def test_normalize_status(spark, value, expected):
    assert one(spark, value, text.normalize_status) == expected


def test_quarter_arithmetic(spark):
    assert one(spark, "Q4/2024", text.next_period) == "Q1/2025"
    assert one(spark, "Q2/2024", text.next_period) == "Q3/2024"
    assert one(spark, "Q4/2024", text.period_sort_key) == 20244
    assert one(spark, "UNKNOWN_KY", text.period_sort_key) is None
    assert [one(spark, p, text.next_period) for p in ("T5/2024", "T12/2024", "NĂM 2023", "UNKNOWN_KY")] == ["T6/2024", "T1/2025", "NĂM 2024", None]


def test_periods_of_all_forms_do_not_depend_on_row_order(spark):
    labels = ["other", "NĂM 2022", "Q1/2023", "T4/2023", "Q2/2023", "NĂM 2023", "T5/2024"]
    rows = [("a", p, float(i + 1)) for i, p in enumerate(labels)]
    found = []
    for given in (rows, rows[::-1]):
        compared = marts.compare_periods(spark.createDataFrame(given, "indicator string, period string, value_num double").coalesce(1))
        found.append({r.period: r.previous_period for r in compared.collect()})
        latest = marts.forecast(compared).collect()
        assert [(r.current_period, r.next_period) for r in latest] == [("T5/2024", "T6/2024")]
    assert found[0] == found[1] == dict(zip(labels, [None, *labels]))


def test_latest_period_is_not_the_largest_text(spark):
    df = spark.createDataFrame([("i", "Q4/2024", 1), ("i", "Q1/2025", 2)], "indicator string, period string, value_num int")
    assert marts.latest_per_group(df, "indicator", text.period_sort_key(F.col("period"))).first().period == "Q1/2025"


def test_growth_of_zero_or_missing_is_null(spark):
    data = [("i", "Q1/2024", 0), ("i", "Q2/2024", 5), ("i", "Q3/2024", None), ("i", "Q4/2024", 7)]
    found = marts.compare_periods(spark.createDataFrame(data, "indicator string, period string, value_num int"))
    assert [r.growth_pct for r in found.orderBy("period").collect()] == [None] * 4


def test_generic_target_defaults(spark):
    zero = spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, sum_x double")
    assert {r.target_value for r in marts.decision_fields(zero, "sum_x").collect()} == {115.0}
    negative = spark.createDataFrame([(1, -5.0)], "k int, sum_x double")
    assert marts.decision_fields(negative, "sum_x").first().target_value == 1.0


def test_scored_column():
    assert marts.scored_column([]) == "total_records"
    assert marts.scored_column(["size", "gpa"]) == "avg_gpa"
    assert marts.scored_column(["quantity", "amount_paid"]) == "sum_amount_paid"


@pytest.mark.parametrize(
    "states, cancel, expected",
    [
        (["QUEUED", "FAILED"], False, "PROCESSING"),
        (["CANCELLED", "CANCELLED"], True, "CANCELLED"),
        (["CANCELLED"], False, "CANCELLED"),
        (["COMPLETED", "DUPLICATE"], False, "COMPLETED"),
        (["COMPLETED", "FAILED"], False, "PARTIAL_SUCCESS"),
        (["UNSUPPORTED", "CANCELLED"], False, "FAILED"),
        (["COMPLETED", "CANCELLED"], False, "FAILED"),
        ([None], False, "PENDING"),
    ],
)
def test_job_status(spark, states, cancel, expected):
    df = spark.createDataFrame([(1, s, cancel) for s in states], "job int, s string, c boolean")
    assert marts.rollup_status(df, "job", "s", "c").first().status == expected


def test_masks(spark):
    df = spark.createDataFrame([("abc@x.org", "0901234567", "4111111111111111"), ("none", "12", None)], "e string, p string, c string")
    rules = {"e": "MASK_EMAIL", "p": "MASK_PHONE", "c": "MASK_CARD"}
    found = [tuple(r) for r in masking.mask(df, rules).collect()]
    assert found == [("ab***@x.org", "***-***-4567", "****-****-****-1111"), ("***@masked.com", "***", "****-****-****-")]
    short = [tuple(r) for r in masking.mask(df, rules, "short").collect()]
    assert short == [("a***@***.com", "090****67", "****-****-****-1111"), ("***@***.com", "***", "****-****-****-****")]
    assert masking.mask(df, {c: "EXCLUDE" for c in df.columns}).columns == ["placeholder"]


@pytest.mark.parametrize(
    "name, rule",
    [("password_hash", "EXCLUDE"), ("credit_limit", "MASK_CARD"), ("tax_id", "MD5_HASH"), ("e_mail", "MASK_EMAIL"), ("mobile_no", "MASK_PHONE"), ("city", "NONE")],
)
def test_mask_names(name, rule):
    assert masking.mask_for_name(name) == rule


def test_renamed_record_keeps_its_checksum(spark):
    old = spark.createDataFrame([(1, "é", None)], "id int, name string, note string")
    new = old.toDF("ma", "ten", "ghi_chu")
    aliases = {"ma": "id", "ten": "name", "ghi_chu": "note"}
    assert old.select(checksum.json_checksum(old)).first() == new.select(checksum.json_checksum(new, aliases)).first()


def profile(entity, columns, key, confidence=1.0, candidates=()):
    return star.Profile(entity, tuple(columns), tuple(key), confidence, 10, tuple((c,) for c in candidates))


def test_plan_prefers_the_key_the_others_share(spark):
    plan = star.star_plan(
        spark,
        [
            profile("courses", ["subject_id", "section_id", "unit_id"], ["subject_id"], candidates=["subject_id", "section_id"]),
            profile("attendance", ["row_id", "section_id", "rate"], ["row_id"]),
            profile("units", ["unit_id", "unit_name"], ["unit_id"]),
            profile("other", ["x"], ["x"]),
        ],
    )
    assert [(r.entity, r.role, r.join_columns) for r in plan] == [
        ("courses", "anchor", ["section_id"]), ("other", "apart", []), ("units", "dimension", ["unit_id"]), ("attendance", "fact", ["section_id"]),
    ]


def test_plan_with_pairs_and_without_keys(spark):
    pair = ["a_id", "b_id"]
    plan = star.star_plan(spark, [profile("x", [*pair, "v"], pair), profile("y", [*pair, "w", "z"], ["w"]), profile("half", ["a_id"], [])])
    assert {r.entity: (r.role, r.join_columns) for r in plan} == {"x": ("anchor", pair), "y": ("fact", pair), "half": ("apart", [])}
    bare = star.star_plan(spark, [profile("m", ["v"], []), profile("n", ["v"], [])])
    assert [(r.entity, r.role) for r in bare] == [("m", "anchor"), ("n", "apart")]


def test_weak_keys_are_marked(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 1)], "order_id int, line int")
    found = star.infer_key(df)
    assert found.key == ("order_id",) and found.confidence <= star.WEAK_BELOW


def test_composite_key(spark):
    df = spark.createDataFrame([(a, b) for a in range(5) for b in range(5)], "a_id int, b_id int")
    found = star.infer_key(df)
    assert sorted(found.key) == ["a_id", "b_id"] and 0.9 < found.confidence <= 0.99


def test_unsafe_anchor_is_refused(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 1)], "order_id int, line int")
    with pytest.raises(ValueError):
        star.context_gold({"orders": df}, "c")


def test_fact_without_match_gives_null(spark):
    orders = spark.createDataFrame([(1,), (2,)], "order_id int")
    lines = spark.createDataFrame([(1, 5.0), (1, 7.0)], "order_id int, amount double")
    plan = [Row(entity=e, role=r, join_columns=["order_id"]) for e, r in (("orders", "anchor"), ("lines", "fact"))]
    found = {r.order_id: r.lines__sum__amount for r in star.star_join({"orders": orders, "lines": lines}, plan).collect()}
    assert found == {1: 12.0, 2: None}


def test_columns_with_one_standard_name(spark):
    with pytest.raises(ValueError):
        schema.standardize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_null_predicate_passes(spark):
    df = spark.createDataFrame([(None,), (1,), (-1,)], "x int")
    valid, rejected = split_dq(df, [("NEGATIVE", "x < 0")])
    assert (valid.count(), [tuple(r) for r in rejected.collect()]) == (2, [(-1, "NEGATIVE")])


def test_violations_report_the_first_twenty(spark):
    df = spark.range(50).select("id", F.lit(None).cast("string").alias("x"))
    assert contract_violations(df, "id", required=["x"], limit=20).count() == 20
    assert contract_violations(df, "id", required=["x"]).count() == 50


def test_far_apart(spark):
    cases = [(1.0, 1.0 + 1e-12, False), (1e6, 1e6 * (1 + 1e-8), True), (None, 1.0, True), (None, None, False), (float("nan"), 1.0, True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a double, b double")
    assert [r[0] for r in df.select(audit.far_apart(F.col("a"), F.col("b"))).collect()] == [c for *_, c in cases]


@pytest.mark.parametrize(
    "severity, mode, status, allowed",
    [
        ("critical", "off", "PASSED", True),
        ("critical", "report", "WARNING", True),
        ("critical", "enforce", "FAILED", False),
        ("warning", "enforce", "WARNING", True),
        (None, "enforce", "FAILED", False),
    ],
)
def test_policy(spark, severity, mode, status, allowed):
    results = validate(spark.range(3), [Expectation("between", "id", severity=severity, high=1)])
    found = apply_policy(results, mode).first()
    assert (found.status, found.merge_allowed) == (status, allowed)


def test_documents(spark, tmp_path):
    good = document_bytes("quý 2/2025", [("1", "ĐT-MT01", "x & y", "5%", "", "đạt"), ("2", "", "no code", "", "", ""), ("3", "STT", "", "", "", "")])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.docx").write_bytes(good)
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    listed = files.list_files(spark, str(tmp_path), content=True)
    assert listed.count() == 2 and set(listed.columns) == {"path", "modified", "size", "content"}
    found = documents.extract_tables(listed).collect()
    assert [(r.path.rsplit("/", 1)[1], r.row_no, r.period, r.code, r.description, r.planned, r.achieved, r.cause) for r in found] == [
        ("a.docx", 1, "Q2/2025", "ĐT-MT01", "x & y", "5%", "N/A", "")
    ]


def test_files_that_are_no_tables(spark):
    for name in ("x.pdf", "x.DOCX", "x.zip"):
        with pytest.raises(ValueError):
            files.read_tabular(spark, name)


def test_unreadable_json(spark, tmp_path):
    (tmp_path / "x.json").write_text("{ not json")
    with pytest.raises(ValueError):
        files.read_tabular(spark, str(tmp_path / "x.json"))


def test_unknown_suffix_is_tried_as_json(spark, tmp_path):
    (tmp_path / "x.data").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_tabular(spark, str(tmp_path / "x.data")).count() == 2


def test_csv_quotes(spark):
    path = scratch(spark, "csv")
    sinks.write_csv(spark.createDataFrame([('a "b"', 1)], "x string, y int").coalesce(1), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ['"x","y"', '"a ""b""","1"']


def test_average_names():
    assert charts.is_average_metric("risk_score") and not charts.is_average_metric("amount")


def test_shared_folder_is_required_on_a_cluster(spark):
    assert scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_the_key_may_be_the_last_of_many_columns_by_name(spark):
    fixed = [F.lit(1).alias(f"z{i:02}_id") for i in range(13)]
    found = star.infer_key(spark.range(50).select(*fixed, F.col("id").alias("a_id")))
    assert found.key == ("a_id",) and found.candidates == (("a_id",),)


def test_key_pair_with_the_worst_names(spark):
    ids = [(F.col("id") % (i + 2)).alias(f"{c}_id") for i, c in enumerate("abcdefgh")]
    days = [(F.col("id") % 20).alias("region"), F.floor(F.col("id") / 20).alias("day")]
    found = star.infer_key(spark.range(1000).select(*ids, *days, F.lit(None).cast("string").alias("none")))
    assert set(found.key) == {"region", "day"} and found.confidence >= star.SAFE_FROM


def jobs_of(spark, monkeypatch, action):
    """How many frames an action collects from."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    count, collect = [], Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: count.append(1) or collect(self))
    return action(), len(count)


def test_a_pair_among_sixty_columns_takes_three_passes(spark, monkeypatch):
    crowd = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40 + i))).alias(f"c{i:02}_id") for i in range(58)]
    df = spark.range(4000).select(*crowd, (F.col("id") % 80).alias("region"), F.floor(F.col("id") / 80).alias("day"))
    found, passes = jobs_of(spark, monkeypatch, lambda: star.infer_key(df))
    assert found.key in (("region", "day"), ("day", "region")) and found.confidence >= star.SAFE_FROM
    assert passes <= 4  # the first pass sketches the columns, then counts them


def test_sketches_rule_no_key_out(spark):
    df = spark.range(30_000).select((F.col("id") % 200).alias("a"), F.floor(F.col("id") / 200).alias("b"), (F.col("id") % 7000).alias("c"), F.lit(5).alias("d"))
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "d")]
    assert star.likely_pairs(df, pairs, 30_000) == [("a", "b"), ("b", "c")]


def test_profile_counts_exactly_by_bitmap_and_by_hash(spark):
    df = spark.range(70_000).select(
        (F.col("id") - 35_000).alias("dense"), (F.col("id") * 10**12).alias("wide"), F.concat(F.lit("x"), F.col("id") % 6543).alias("words"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"), F.lit(None).cast("int").alias("none"),
    )
    assert star._is_dense(star.sketch_columns(df, ["dense"])["dense"]) and not star._is_dense(star.sketch_columns(df, ["wide"])["wide"])
    found = {r.column_name: (r.row_count, r.distinct_values, r.null_values) for r in star.profile_columns(df, df.columns).collect()}
    assert found == {"dense": (70_000, 70_000, 0), "wide": (70_000, 70_000, 0), "words": (70_000, 6543, 0), "half": (70_000, 35_000, 35_000), "none": (70_000, 0, 70_000)}


@pytest.mark.parametrize("name,want", [
    ("Tên Đơn Vị", "ten_don_vi"), ("userID", "user_id"), ("HTTPServer2Name", "http_server2_name"), ("a--b c", "a_b_c"), ("ABC1", "abc1"),
    ("A1B", "a1_b"), ("__x__", "x"), ("!!", "col"), ("already_snake", "already_snake"), ("X", "x"), ("ngày cập nhật", "ngay_cap_nhat"),
])
def test_snake_case(name, want):
    from strataforge.functions.text import snake_case

    assert snake_case(name) == want


def test_documents_are_opened_a_few_at_a_time():
    good = document_bytes("quý 1/2024", [("1", "Q-MT1", "a", "5", "6", "đạt")])
    batch = pa.record_batch({"path": pa.array([str(i) for i in range(1000)]), "content": pa.array([good] * 998 + [b"x", None], pa.binary())})
    parts = list(documents.opened(iter([batch])))
    assert max(p.num_rows for p in parts) <= documents.SLICE
    read = pa.Table.from_batches(parts)
    assert read["path"].to_pylist() == batch["path"].to_pylist()
    assert read["error"].to_pylist() == [None] * 998 + ["BadZipFile"] * 2
    assert read["tables"][0].as_py()[0][1] == ["1", "Q-MT1", "a", "5", "6", "đạt"]


def test_headers_of_each_table_place_its_own_cells(spark):
    known, turned = ["Mã", "Kết quả", "Nội dung"], ["Nội dung", "Mã", "Mức đăng ký"]
    tables = [[known, ["A-1", "đạt", "x"], ["STT", "", ""]], [["other"], ["B-1"]], [], [turned, ["y", "C-1"]]]
    shape = "path string, error string, text string, tables array<array<array<string>>>"
    rows = documents.table_rows(spark.createDataFrame([("d", None, "Q1/2024", tables), ("n", None, "", None)], shape)).collect()
    assert [(r.path, r.row_no, r.code, r.description, r.result, r.planned, r.cause) for r in rows] == [
        ("d", 1, "A-1", "x", "đạt", "N/A", ""),
        ("d", 2, "C-1", "y", "N/A", "N/A", ""),
    ]
