"""Queries for readers, sinks and work on listings of files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataforge.functions.frames import attach
from strataforge.operators import quality
from strataforge.operators.schema import stamp
from strataforge.plans.catalog.audits import EVENT_CONTRACT, event_records
from strataforge.plans.catalog.common import AS_OF, STAMP, shown
from strataforge.plans.catalog.star import ORDER_CONTRACT, order_records
from strataforge.plans.catalog.state import LINE_RULES, LINE_SQL
from strataforge.plans.registry import query
from strataforge.session import scratch
from strataforge.sources import documents, files, pages, sinks
from strataforge.sources.entities import read_entity_files
from strataforge.sources.ledger import Ledger


@query(
    "S1_read_tabular",
    """SELECT 'csv' AS format, c_custkey, c_name, c_mktsegment FROM customer
       UNION ALL SELECT 'tsv', c_custkey, c_name, c_mktsegment FROM customer
       UNION ALL SELECT 'json', c_custkey, c_name, c_mktsegment FROM customer
       UNION ALL SELECT 'parquet', c_custkey, c_name, c_mktsegment FROM customer""",
)
def s1(t):
    root = scratch(t.spark, "tabular")
    customer = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    customer.write.option("header", True).csv(f"{root}/c.csv")
    customer.write.option("header", True).option("sep", "\t").csv(f"{root}/c.tsv")
    customer.write.parquet(f"{root}/c.parquet")
    # the JSON reader takes whole files: one array of at most 10,000 customers (keys are unique) per file
    packed = customer.groupBy(F.floor(F.col("c_custkey") / 10_000)).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    packed.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/c.json")
    parts = [
        files.read_tabular(t.spark, f"{root}/c.{kind}")
        .select(F.lit(kind).alias("format"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment")
        for kind in ("csv", "tsv", "json", "parquet")
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "S2_read_declared_batch",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '{STAMP}') AS o_orderdate, 'b2' AS _batch_id
        FROM orders WHERE o_orderkey % 4 = 2""",
)
def s2(t):
    path = scratch(t.spark, "batches")
    stamped = stamp(order_records(t), ORDER_CONTRACT, "b0", AS_OF).withColumn(
        "_batch_id", F.concat(F.lit("b"), (F.col("o_orderkey") % 4).cast("string"))
    )
    stamped.write.partitionBy("_batch_id").parquet(path)
    batch = files.read_batch(t.spark, path, "b2", ORDER_CONTRACT)
    return shown(batch.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "_batch_id"))


PATHS = """SELECT CASE page_id % 6 WHEN 0 THEN 'staging/manual' WHEN 1 THEN 'bronze/tenant_id=t' || (page_id % 3) ELSE 'staging/ctx' || (page_id % 3) END
  || '/' || CASE WHEN page_id % 17 = 0 THEN '_control' ELSE 'entity' || (page_id % 4) END || '/' || split_part(url, '/', 4) || '/'
  || page_id || CASE page_id % 5 WHEN 0 THEN '.parquet' WHEN 1 THEN '.csv' WHEN 2 THEN '.PARQUET' WHEN 3 THEN '.pdf' ELSE '.json' END AS path,
  CASE WHEN page_id % 13 = 0 THEN 0 ELSE CAST(length(html) AS BIGINT) END AS size FROM pages"""


@query(
    "S3_context_manifest",
    f"""WITH f AS (SELECT path, size, str_split(path, '/') AS p FROM ({PATHS}))
      SELECT p[2] AS context_id, p[3] AS entity, p[-1] AS filename, path, size,
        count(*) OVER (PARTITION BY p[2], p[3]) AS files FROM f
      WHERE path LIKE 'staging/%' AND size > 0 AND len(p) >= 4 AND p[2] <> 'manual' AND p[3] <> '_control'
        AND regexp_matches(lower(path), '\\.(parquet|json|csv|tsv)$')""",
)
def s3(t):
    manifest = files.context_manifest(t.sql(PATHS))
    return manifest.join(files.manifest_entities(manifest).select("context_id", "entity", "files"), ["context_id", "entity"])


@query(
    "S4_read_entity",
    """SELECT n_nationkey AS entity_key, n_name AS label, n_regionkey FROM nation
       UNION ALL SELECT r_regionkey, r_name, NULL FROM region""",
)
def s4(t):
    root = scratch(t.spark, "entity")
    t.nation.toDF("EntityKey", "Label", "N RegionKey".replace(" ", "_")).write.parquet(f"{root}/a")
    t.region.toDF("EntityKey", "Label").write.parquet(f"{root}/b")
    rows, _ = read_entity_files(t.spark, [f"{root}/a", f"{root}/b"])
    return rows.withColumnRenamed("n_region_key", "n_regionkey")


@query(
    "S4_entity_formats",
    """SELECT c_custkey AS cust_key, c_name AS name, CAST(c_acctbal AS DOUBLE) AS balance,
         CASE WHEN c_custkey % 4 <> 1 THEN c_mktsegment END AS segment FROM customer""",
)
def s4_formats(t):
    """One entity in four formats: other column orders, a missing column, other types of one column."""
    root = scratch(t.spark, "formats")
    part = [t.customer.filter(F.col("c_custkey") % 4 == n) for n in range(4)]
    key, name, balance, segment = F.col("c_custkey").alias("CustKey"), F.col("c_name").alias("Name"), F.col("c_acctbal").cast("double").alias("Balance"), F.col("c_mktsegment").alias("Segment")
    part[0].select(key, name, balance, segment).write.option("header", True).csv(f"{root}/a.csv")
    part[1].select(balance, name, key).write.option("header", True).option("sep", "\t").csv(f"{root}/b.tsv")
    part[2].select(segment, key, balance, name).write.json(f"{root}/c.json")
    part[3].select(key.cast("int"), name, balance.cast("decimal(12,2)"), segment).toDF("CustKey", "Name", "Balance", "Segment").write.parquet(f"{root}/d.parquet")
    rows, _ = read_entity_files(t.spark, [f"{root}/{n}" for n in ("a.csv", "b.tsv", "c.json", "d.parquet")])
    return rows.withColumn("cust_key", F.col("cust_key").cast("bigint"))


def event_pages(t) -> DataFrame:
    """Responses of 100 events each; event ids are unique, so a page cannot grow."""
    record = F.struct("event_id", "user_id", "event_type")
    page = F.floor(F.col("event_id") / 100)
    return (
        t.events.groupBy(page.alias("page"))
        .agg(F.collect_list(record).alias("data"))
        .select(
            F.lit("shop").alias("source_system"),
            F.lit("events").alias("dataset"),
            F.when(F.col("page") % 10 == 3, "1.1").otherwise("1.0").alias("schema_version"),
            "data",
        )
    )


@query(
    "S5_merge_pages",
    """SELECT event_id, user_id, event_type, CAST(1 AS BIGINT) AS differing_headers, CAST(0 AS BIGINT) AS repeated_ids,
         (SELECT count(*) FROM events) AS returned, false AS accepted FROM events""",
)
def s5(t):
    records, audit = pages.merge_pages(event_pages(t), "event_id")
    return attach(records, audit)


@query(
    "S6_land_bronze",
    """SELECT 'b1' AS _batch_id, count(*) AS rows, count(*) AS reported, count(DISTINCT event_type) AS kinds FROM events""",
)
def s6(t):
    path = scratch(t.spark, "land")
    landed = sinks.land_bronze(stamp(event_records(t), EVENT_CONTRACT, "b1", AS_OF), path, "b1")
    back = t.spark.read.parquet(path)
    return back.groupBy("_batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(landed.rows).cast("bigint").alias("reported"), F.countDistinct("event_type").alias("kinds")
    )


@query("S7_replace_table", "SELECT s_suppkey, s_name FROM supplier")
def s7(t):
    ledger = Ledger(t.spark, scratch(t.spark, "replace"))
    ledger.replace("supplier", t.supplier.select("s_suppkey", "s_nationkey"))
    ledger.replace("supplier", t.supplier.select("s_suppkey", "s_name"))
    return ledger.live("supplier")


@query(
    "S8_partitioned_overwrite",
    """SELECT period, count(*) AS rows, CAST(sum(CASE WHEN sort_key % 10 = 4 THEN value_num + 1 ELSE value_num END) AS BIGINT) AS total
       FROM v_kpi GROUP BY period""",
)
def s8(t):
    path = scratch(t.spark, "periods")
    kpi = t.v_kpi.select("indicator", "value_num", "sort_key", "period")
    sinks.overwrite_partitions(kpi, path, ["period"])
    changed = kpi.filter("sort_key % 10 = 4").withColumn("value_num", F.col("value_num") + 1)
    sinks.overwrite_partitions(changed, path, ["period"])
    back = t.spark.read.parquet(path)
    return back.groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.sum("value_num").alias("total"))


@query(
    "S9_append_quarantine",
    LINE_SQL
    + """SELECT reasons AS rejection_reason, 2 * count(*) AS rows, 2 * (SELECT count(*) FROM marked WHERE reasons <> '') AS reported
         FROM marked WHERE reasons <> '' GROUP BY reasons""",
)
def s9(t):
    path = scratch(t.spark, "quarantine")
    _, rejected = quality.split_dq(t.lineitem, LINE_RULES)
    rows = quality.to_quarantine(rejected, ["l_orderkey", "l_linenumber"], ["l_orderkey"], AS_OF)
    written = sum(sinks.append_quarantine(part, path) for part in (rows, rows.filter("l_orderkey < 0"), rows))
    back = t.spark.read.parquet(path)
    return back.groupBy("rejection_reason").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(written).cast("bigint").alias("reported")
    )


@query(
    "S10_verify_files",
    """SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'MISSING' WHEN octet_length(encode(text)) = 0 THEN 'EMPTY'
         WHEN doc_id % 11 = 0 THEN 'SIZE_MISMATCH' WHEN doc_id % 5 = 0 THEN 'CHECKSUM_MISMATCH' ELSE 'OK' END AS state FROM documents""",
)
def s10(t):
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path")
    content = F.col("text").cast("binary")
    found = t.documents.filter("doc_id % 7 <> 0").select(name, content.alias("content"))
    manifest = t.documents.select(
        name,
        (F.length(content) + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).cast("bigint").alias("expected_size"),
        F.upper(F.sha2(F.concat(content, F.when(F.col("doc_id") % 5 == 0, "x").otherwise("").cast("binary")), 256)).alias("expected_sha256"),
    )
    return files.verify_files(found, manifest)


@query("S11_sample_files")
def s11(t):
    samples = []
    for name in ("customer", "part", "orders"):
        columns, rows = files.sample_file(getattr(t, name))
        samples.append(
            rows.select(
                F.lit(name).alias("file"),
                F.lit(", ".join(f"{c} {k}" for c, k in columns)).alias("columns"),
                F.to_json(F.struct("*")).alias("row"),
            )
        )
    return reduce(DataFrame.unionByName, samples)


@query(
    "S12_dedup_content",
    """WITH h AS (SELECT doc_id AS file_id, sha256(text) AS checksum, doc_id % 40 = 0 AS done FROM documents)
       SELECT file_id, checksum, CASE WHEN row_number() OVER (PARTITION BY checksum ORDER BY file_id) = 1
         AND NOT bool_or(done) OVER (PARTITION BY checksum) THEN 'CLAIMED' ELSE 'DUPLICATE' END AS status FROM h""",
)
def s12(t):
    arrived = t.documents.select(F.col("doc_id").alias("file_id"), F.col("doc_id").alias("arrival"), F.col("text").alias("content"))
    ledger = t.documents.filter("doc_id % 40 = 0").select(F.sha2("text", 256).alias("checksum"), F.lit("Completed").alias("status"))
    return files.dedup_content(arrived, ledger)


@query(
    "S13_expired_files",
    """WITH f AS (SELECT event_type || '/' || event_id AS path, (epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(ts)) / 86400000000.0::DOUBLE AS age FROM events)
       SELECT path, CAST(floor(age) AS BIGINT) AS age_days FROM f WHERE age >= 20 AND path LIKE 'c%'""",
)
def s13(t):
    listing = t.events.select(
        F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modified")
    )
    return files.expired_files(listing, 20, "2024-02-01 12:00:00", "c").select("path", "age_days")


@query(
    "S14_stream_stats",
    f"""WITH f AS (SELECT path, size, str_split(path, '/') AS p FROM ({PATHS})),
      s AS (SELECT regexp_replace(p[2], '^tenant_id=', '') AS tenant, p[3] AS table_name, path, size FROM f
            WHERE lower(path) LIKE '%.parquet' AND len(p) >= 4)
      SELECT tenant, table_name, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes, min(path) AS first_path, max(path) AS last_path
      FROM s GROUP BY tenant, table_name""",
)
def s14(t):
    return files.stream_stats(t.sql(PATHS))


@query(
    "S14_stream_files",
    f"""SELECT regexp_replace(split_part(path, '/', 2), '^tenant_id=', '') AS tenant, split_part(path, '/', 3) AS table_name, path, size
        FROM ({PATHS}) WHERE lower(path) LIKE '%.parquet'""",
)
def s14_files(t):
    return files.stream_files(t.sql(PATHS))


HEADERS = ("STT", "Mã chỉ tiêu", "Nội dung mục tiêu", "Mức đăng ký", "Mức đạt", "Kết quả")


def document_bytes(period: str, rows: list[tuple[str, ...]]) -> bytes:
    """A word-processor file with one paragraph and one table."""

    def cell(text: str) -> str:
        return f"<w:tc><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:tc>"

    lines = "".join("<w:tr>" + "".join(cell(c) for c in row) + "</w:tr>" for row in (HEADERS, *rows))
    xml = (
        '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
        f"<w:p><w:r><w:t>Báo cáo {period}</w:t></w:r></w:p><w:tbl>{lines}</w:tbl></w:body></w:document>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("word/document.xml", xml)
    return out.getvalue()


def order_documents(t) -> DataFrame:
    """One document per 20 orders; order keys are unique, so a document cannot grow."""
    row = F.struct(
        F.concat(F.lit("Q-MT"), F.col("o_orderkey").cast("string")).alias("code"),
        F.col("o_orderpriority").alias("description"),
        F.col("o_custkey").cast("string").alias("planned"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("achieved"),
    )
    grouped = t.orders.groupBy(F.floor(F.col("o_orderkey") / 20).alias("doc")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pandas()
            for start in range(0, batch.num_rows, documents.SLICE):
                docs, contents = numbers[start : start + documents.SLICE], []
                for doc, rows in zip(docs, batch.column(1).slice(start, documents.SLICE).to_pylist()):
                    cells = [(str(i), r["code"], r["description"], r["planned"], r["achieved"], "ĐẠT") for i, r in enumerate(rows)]
                    contents.append(document_bytes(f"quý {doc % 4 + 1}/2024" if doc % 3 else "năm 2023", [*cells, ("", "STT", "", "", "", "")]))
                yield pa.record_batch({"path": pa.array([f"doc{d}.docx" for d in docs], pa.string()), "content": pa.array(contents, pa.binary())})

    return grouped.mapInArrow(build, "path string, content binary")


@query(
    "S15_extract_document_tables",
    """SELECT 'doc' || (o_orderkey // 20) || '.docx' AS path,
         CASE WHEN (o_orderkey // 20) % 3 = 0 THEN 'NĂM 2023' ELSE 'Q' || ((o_orderkey // 20) % 4 + 1) || '/2024' END AS period,
         'Q-MT' || o_orderkey AS code, o_orderpriority AS description, 'N/A' AS frequency, CAST(o_custkey AS VARCHAR) AS planned,
         CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE o_orderstatus END AS achieved, 'ĐẠT' AS result, '' AS cause, '' AS action FROM orders""",
)
def s15(t):
    return documents.extract_tables(order_documents(t)).drop("row_no")


@query("S16_csv_export", """SELECT n_nationkey, 'the "' || n_name || '", here' AS n_name, n_regionkey FROM nation""")
def s16(t):
    path = scratch(t.spark, "export")
    nation = t.nation.withColumn("n_name", F.concat(F.lit('the "'), "n_name", F.lit('", here')))
    sinks.write_csv(nation, path)
    return t.spark.read.schema(nation.schema).option("header", True).option("escape", '"').csv(path)


def envelopes(t) -> DataFrame:
    """Responses of 50 events in different envelopes, and single events as objects."""
    record = F.struct("event_id", "user_id", "event_type")
    listed = (
        t.events.filter("event_id % 50 <> 49")
        .groupBy(F.floor(F.col("event_id") / 50).alias("page"))
        .agg(F.collect_list(record).alias("rows"))
    )
    empty = F.array().cast("array<string>")
    kind = F.col("page") % 4
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.col("rows").alias("data"), F.lit(1).alias("page"))))
        .when(kind == 1, F.to_json(F.struct(empty.alias("items"), F.col("rows").alias("records"))))
        .when(kind == 2, F.to_json("rows"))
        .otherwise(F.to_json(F.struct(F.col("rows").alias("results"))))
    )
    return listed.select(body.alias("body")).unionByName(t.events.filter("event_id % 50 = 49").select(F.to_json(record).alias("body")))


@query("S18_unwrap_envelope", "SELECT event_id, user_id, event_type FROM events")
def s18(t):
    return pages.unwrap(envelopes(t), "body", "struct<event_id: bigint, user_id: bigint, event_type: string>")


UPLOADED = """SELECT doc_id AS file_id, CASE WHEN doc_id % 10 = 0 THEN 'all' ELSE 'j' || CAST(floor(doc_id / 60) AS INT) END AS job,
  'f' || doc_id || CASE doc_id % 9 WHEN 0 THEN '.exe' WHEN 1 THEN '.CSV' ELSE '.docx' END AS name, n_chars * 9000 AS size FROM documents"""


@query(
    "S19_admit_files",
    f"""WITH f AS (SELECT *, CASE WHEN name LIKE '%.exe' THEN 'UNSUPPORTED' WHEN size > 104857600 THEN 'FILE_TOO_LARGE' ELSE 'ADMITTED' END AS own FROM ({UPLOADED})),
      j AS (SELECT job, sum(size) AS bytes, count(*) AS n FROM f WHERE own = 'ADMITTED' GROUP BY job)
      SELECT f.job, file_id, CASE WHEN own <> 'ADMITTED' THEN own WHEN n > 100 THEN 'TOO_MANY_FILES' WHEN bytes > 1073741824 THEN 'JOB_TOO_LARGE' ELSE own END AS decision
      FROM f LEFT JOIN j ON f.job = j.job""",
)
def s19(t):
    return files.admit_files(t.sql(UPLOADED))
