"""Reading tables and working with listings of files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strataforge.operators.schema import Contract

# File kinds, limits and layouts.
NOT_TABULAR = (".pdf", ".docx", ".doc", ".png", ".jpg", ".jpeg", ".zip", ".tar", ".gz")
TABULAR = (".parquet", ".json", ".csv", ".tsv")
ADMITTED = (".pdf", ".docx", ".csv", ".tsv", ".xlsx", ".xls", ".json", ".parquet")
MAX_FILE_BYTES = 100 * 1024 * 1024
MAX_JOB_BYTES = 1024 * 1024 * 1024
MAX_JOB_FILES = 100
STREAM_ROOTS = ("staging", "bronze_archive", "bronze")


def read_tabular(spark: SparkSession, path: str, schema: T.StructType | None = None, sampling: float = 1.0) -> DataFrame:
    """Choose the reader by suffix.  Give a schema, or a sampling ratio, to avoid a full inference pass."""
    low = path.lower().rstrip("/")
    if low.endswith(NOT_TABULAR):
        raise ValueError(f"not a table: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)

    def json_file() -> DataFrame:
        return reader.option("multiLine", True).option("samplingRatio", sampling).json(path)

    if low.endswith(".parquet"):
        df = reader.parquet(path)
    elif low.endswith(".json"):
        df = json_file()
    elif low.endswith((".csv", ".tsv")):
        df = (
            reader.option("header", True)
            .option("sep", "\t" if low.endswith(".tsv") else ",")
            .option("inferSchema", schema is None)
            .option("samplingRatio", sampling)
            .csv(path)
        )
    else:
        try:
            df = reader.parquet(path)
        except Exception:  # noqa: BLE001 - any unreadable parquet file is tried as JSON
            df = json_file()
    if df.columns == ["_corrupt_record"]:
        raise ValueError(f"no readable record in {path}")
    return df


def read_batch(spark: SparkSession, root: str, batch_id: str, contract: Contract) -> DataFrame:
    """One landed batch with the declared nullable schema; other partitions are pruned."""
    return spark.read.schema(contract.batch_schema()).parquet(root).filter(F.col("_batch_id") == batch_id)


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, modified, size[, content]) of all files below a folder; contents are read only on request."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    names = [F.col("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")]
    return files.select(*names, *(["content"] if content else []))


def context_manifest(files: DataFrame, context_id: str | None = None, root: str = "staging") -> DataFrame:
    """Files of relational contexts, one row each: (context_id, entity, filename, path, size).

    Path layout is ``root/context/entity/.../file``.  Control folders, manual
    uploads, empty files and other kinds of files are left out.  Rows instead of
    one list per entity keep an entity with very many files distributed.
    """
    prefix = root.strip("/") + "/"
    parts = F.filter(F.split(F.substr(F.col("path"), F.lit(len(prefix) + 1)), "/"), lambda p: p != "")
    name = F.lower(F.element_at(F.col("_parts"), -1))
    tabular = reduce(or_, [name.endswith(suffix) for suffix in TABULAR])
    rows = (
        files.filter(F.col("path").startswith(prefix) & ~F.col("path").endswith("/") & (F.col("size") > 0))
        .withColumn("_parts", parts)
        .filter((F.size("_parts") >= 3) & tabular)
        .select(
            F.col("_parts")[0].alias("context_id"),
            F.col("_parts")[1].alias("entity"),
            F.element_at("_parts", -1).alias("filename"),
            "path",
            "size",
        )
        .filter((F.lower("context_id") != "manual") & (F.col("entity") != "_control"))
    )
    return rows.filter(F.col("context_id") == context_id) if context_id else rows


def manifest_entities(manifest: DataFrame) -> DataFrame:
    """Per context and entity: files, bytes, first and last path."""
    return manifest.groupBy("context_id", "entity").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.min("path").alias("first_path"),
        F.max("path").alias("last_path"),
    )


def stream_files(files: DataFrame) -> DataFrame:
    """Parquet files of the landing layout ``root/tenant/table/...`` with tenant and table."""
    parts = F.split("path", "/")
    return (
        files.withColumn("_parts", parts)
        .filter(F.lower("path").endswith(".parquet") & (F.size("_parts") >= 4) & F.col("_parts")[0].isin(*STREAM_ROOTS))
        .select(
            F.regexp_replace(F.col("_parts")[1], "^tenant_id=", "").alias("tenant"),
            F.col("_parts")[2].alias("table_name"),
            "path",
            "size",
        )
    )


def stream_stats(files: DataFrame) -> DataFrame:
    """Per tenant and table: files, bytes, first and last path.  ``stream_files`` lists the files as rows."""
    return stream_files(files).groupBy("tenant", "table_name").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("total_bytes"),
        F.min("path").alias("first_path"),
        F.max("path").alias("last_path"),
    )


def verify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of each expected file: OK, MISSING, EMPTY, SIZE_MISMATCH or CHECKSUM_MISMATCH.

    ``files`` is (path, content); hashing happens where the file is read and
    only path, size and hash are shuffled.
    """
    found = files.select("path", F.length("content").cast("bigint").alias("_size"), F.sha2("content", 256).alias("_sha"))
    state = (
        F.when(F.col("_sha").isNull(), "MISSING")
        .when(F.col("_size") <= 0, "EMPTY")
        .when(F.col("_size") != F.col("expected_size"), "SIZE_MISMATCH")
        .when(F.col("_sha") != F.lower("expected_sha256"), "CHECKSUM_MISMATCH")
        .otherwise("OK")
    )
    return manifest.join(found, "path", "left").select("path", state.alias("state"))


def sample_file(df: DataFrame, n: int = 10) -> tuple[list[tuple[str, str]], DataFrame]:
    """Columns with types, and up to ``n`` rows."""
    return df.dtypes, df.limit(n)


def dedup_content(files: DataFrame, ledger: DataFrame | None = None, force: bool = False) -> DataFrame:
    """(file_id, checksum, status): one claimed file per content, later or completed ones DUPLICATE.

    ``files`` is (file_id, arrival, content).  The first arrival of a checksum
    is found by a partial aggregate; contents are hashed before any shuffle.
    """
    hashed = files.select("file_id", "arrival", F.sha2(F.col("content").cast("binary"), 256).alias("checksum"))
    first = hashed.groupBy("checksum").agg(F.min(F.struct("arrival", "file_id")).alias("_first"))
    known = first.withColumn("_done", F.lit(False))
    if ledger is not None:
        done = (
            ledger.filter(F.upper("status").isin("COMPLETED", "SUCCESS"))
            .select("checksum").distinct().withColumn("_done", F.lit(True))
        )
        known = first.join(done, "checksum", "left")
    claimed = F.col("file_id") == F.col("_first.file_id")
    fresh = F.lit(True) if force else ~F.coalesce("_done", F.lit(False))
    return hashed.join(known, "checksum").select(
        "file_id", "checksum", F.when(claimed & fresh, "CLAIMED").otherwise("DUPLICATE").alias("status")
    )


def expired_files(files: DataFrame, days: int, now, prefix: str = "") -> DataFrame:
    """Files below a prefix that are at least ``days`` old, with their age in whole days."""
    if days < 1:
        raise ValueError("retention must be at least one day")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("modified").cast("timestamp"))) / 86_400_000_000
    return (
        files.filter(F.col("path").startswith(prefix))
        .withColumn("age_days", F.floor(age).cast("bigint"))
        .filter(age >= days)
    )


def admit_files(files: DataFrame) -> DataFrame:
    """Decision per file of a job: (job, file_id, decision).

    Unsupported or too large files are refused one by one; a job beyond its
    byte or file limit is refused as a whole.  Limits are sums per job, so a job
    with very many files is never ordered in one task.
    """
    supported = F.coalesce(F.regexp_extract(F.lower("name"), r"\.[a-z]+$", 0).isin(*ADMITTED), F.lit(False))
    small = F.col("size") <= MAX_FILE_BYTES
    judged = files.withColumn(
        "_own", F.when(~supported, "UNSUPPORTED").when(~small, "FILE_TOO_LARGE").otherwise("ADMITTED")
    )
    jobs = judged.filter("_own = 'ADMITTED'").groupBy("job").agg(
        F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_files")
    )
    whole: Column = F.when(F.col("_files") > MAX_JOB_FILES, "TOO_MANY_FILES").when(
        F.col("_bytes") > MAX_JOB_BYTES, "JOB_TOO_LARGE"
    )
    return judged.join(jobs, "job", "left").select(
        "job", "file_id", F.when(F.col("_own") == "ADMITTED", F.coalesce(whole, "_own")).otherwise(F.col("_own")).alias("decision")
    )
