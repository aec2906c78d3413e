"""Writing: verified landing, table versions, partition overwrite, appends, exports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from strataforge.operators import cdc
from strataforge.session import staged


@dataclass(frozen=True)
class LandResult:
    path: str
    batch_id: str
    rows: int
    fingerprint: str


def observed(seen: Observation) -> dict:
    """Figures of a finished write; none where Spark knew its input to be empty and left the observed step out."""
    try:
        return seen.get
    except Py4JJavaError as error:
        if "AssertionError" in error.java_exception.getClass().getName():  # a row without columns
            return {}
        raise


def fingerprint(df: DataFrame) -> Column:
    """Digest of a multiset of rows: order-free sums of two hashes of all values of each row.

    Any changed, lost or repeated value changes it, also beside a stored checksum that is intact.
    """
    values = [F.to_json(F.col(f"`{f.name}`")) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]
    missing = [F.col(f"`{f.name}`").isNull() for f in df.schema]  # a hash passes over NULL
    sums = [F.sum(F.xxhash64(F.lit(seed), *values, *missing).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return F.concat_ws("/", *sums)


def _has_map(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, T.MapType) or any(map(_has_map, inner))


def land_bronze(stamped: DataFrame, path: str, batch_id: str) -> LandResult:
    """Write one batch to its own partition, read it back, and compare counts and digests of all values.

    Writing the same batch again replaces its partition, so a repeat changes nothing.
    The figures of the written rows are observed during the write itself.
    """
    spark = stamped.sparkSession
    seen = Observation()
    written = stamped.observe(seen, F.count(F.lit(1)).alias("rows"), fingerprint(stamped).alias("sum"))
    (
        written.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("_batch_id")
        .parquet(path)
    )
    wrote = observed(seen)
    if not wrote.get("rows"):
        raise ValueError("empty batch")
    verify_landed(spark, path, batch_id, stamped.schema, wrote["rows"], wrote["sum"])
    return LandResult(path, batch_id, wrote["rows"], wrote["sum"])


class LandingMismatch(RuntimeError):
    """What was read back is not what was written."""


def verify_landed(spark: SparkSession, path: str, batch_id: str, schema: T.StructType, rows: int, digest: str) -> None:
    """Read a landed batch and compare its rows with the figures of what was written."""
    back = spark.read.schema(schema).parquet(path).filter(F.col("_batch_id") == batch_id)
    back = back.select(*[F.col(f"`{f.name}`") for f in schema])  # the partition column in its place
    found = back.agg(F.count(F.lit(1)).alias("rows"), fingerprint(back).alias("sum")).first()
    if (found["rows"], found["sum"]) != (rows, digest):
        raise LandingMismatch(f"batch {batch_id}: wrote {rows} rows {digest}, read back {found['rows']} rows {found['sum']}")


def overwrite_partitions(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Rewrite only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def repair_partitions(spark: SparkSession, path: str, columns: Sequence[str], key: Sequence[str], order: Sequence[Column]) -> int:
    """Leave one row per key in a partitioned table and return the number of partitions rewritten.

    The keys are counted from their columns alone; the rest is read from partitions that hold a repeated
    key, and only these are written.  The driver learns the names of those partitions, fewer
    than it lists to plan any scan.  The result is staged before a partition is replaced, and a partition left
    without rows is removed last: a run that stops between can be repeated with the same choice of rows.
    """
    table = spark.read.parquet(path)
    keys = staged(cdc.repeated_keys(table, key).select(*key), "repeated")
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder")
    placed = table.select(*dict.fromkeys([*columns, *key]), folder)
    folders: dict[tuple, set[str]] = {}
    for row in cdc.join_nullsafe(placed, keys, key, "left_semi").select(*columns, "_folder").distinct().collect():
        folders.setdefault(tuple(row)[:-1], set()).add(row["_folder"])
    if not folders:
        return 0
    held = reduce(or_, [reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, values)]) for values in folders])
    repaired, _ = cdc.repair_duplicates(table.filter(held), key, order)
    repaired = staged(repaired, "repaired")
    overwrite_partitions(repaired, path, columns)
    for values in set(folders) - {tuple(r) for r in repaired.select(*columns).distinct().collect()}:
        for emptied in folders[values]:
            delete(spark, emptied)
    return len(folders)


def append_quarantine(df: DataFrame, path: str) -> int:
    """Append rejected rows and return their number; nothing is written when there are none."""
    if df.isEmpty():
        return 0
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return seen.get["rows"]


def replace_quarantine(df: DataFrame, path: str, batch_id: str) -> int:
    """Write the rejected rows of one batch in place of those an earlier try has written; return their number.

    Each batch has a folder of its own, so a retry neither doubles its rows nor keeps
    rows that are no longer rejected.  Readers see the batch as column ``_batch``.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")
    return observed(seen).get("rows", 0)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, every value quoted, quotes doubled."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False, and nothing done, when the target exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = new.getFileSystem(conf)
    files.mkdirs(new.getParent())
    old, new = files.makeQualified(old), files.makeQualified(new)
    keep = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(old, new, keep)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whichever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whichever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
