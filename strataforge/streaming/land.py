"""Streams of files into Bronze, and into a merged table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from strataforge.sources.ledger import Ledger


def stream_land(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType, files_per_trigger: int | None = None
) -> None:
    """Append all files not seen yet to Bronze Parquet, then stop.  A restart continues where it ended."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    query = (
        reader.parquet(source)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_upsert(
    spark: SparkSession,
    source: str,
    checkpoint: str,
    schema: StructType,
    ledger: Ledger,
    table: str,
    key: Sequence[str],
    step: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = 256,
    files_per_trigger: int | None = None,
) -> None:
    """Run ``step(batch, state) -> new state`` for every micro-batch and publish each new state.

    Only the key buckets that a micro-batch touches are read and rewritten.  The
    ledger commit that publishes a state also records the stream's batch number,
    so a repeated micro-batch is skipped.
    """
    marker = f"stream:{table}:{checkpoint}"  # numbers start anew with every checkpoint folder

    def merge(batch: DataFrame, number: int) -> None:
        if ledger.head()["state"].get(marker, -1) < number:
            ledger.merge_buckets(table, key, batch, step, buckets, {marker: number})

    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_changes(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: StructType,
    key: Sequence[str],
    event: str,
    at: str,
    delay: str,
    files_per_trigger: int | None = None,
) -> dict[str, int]:
    """Append the changes of the latest row per key to ``target``, then stop; figures of this run.

    Spark's state store holds what is known between batches and runs: the ids
    (``event``) of the last ``delay`` of event time, so that a repeated event is dropped,
    and each key's latest row by (``at``, ``event``), so that an event older than that
    changes nothing.  Events older than the watermark are dropped and counted as ``late``.
    Each micro-batch replaces its own folder, so a restart repeats nothing: one target belongs
    to one checkpoint.  ``current`` reads the changes.  A key's events may lie in any number of
    batches; the state of a key is one row, and no Python runs per key.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)  # readable before the first batch

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/_batch={number}")

    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    now = F.current_timestamp()  # one value in a micro-batch, the same when it is repeated
    stamped = reader.parquet(source).withColumn("_seen", now)
    once = stamped.withWatermark(at, delay).dropDuplicatesWithinWatermark([event])
    place = F.struct(at, event, -F.unix_micros("_seen"))  # of rows at one place the first seen stays
    latest = once.groupBy(*key).agg(F.max_by(F.struct(*schema.names, "_seen"), place).alias("_latest"))
    changes = latest.where(F.col("_latest._seen") == now).select("_latest.*").drop("_seen")
    query = (
        changes.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    figures = {"rows": 0, "late": 0, "batches": 0}
    for progress in query.recentProgress:
        figures["rows"] += progress["numInputRows"]
        figures["batches"] += progress["numInputRows"] > 0
        figures["late"] += sum(o["numRowsDroppedByWatermark"] for o in progress["stateOperators"])
    return figures


def current(spark: SparkSession, target: str, schema: StructType, key: Sequence[str], event: str, at: str) -> DataFrame:
    """The latest row of each key of the changes written so far."""
    rows = spark.read.schema(schema).parquet(target)
    best = F.max_by(F.struct(*schema.names), F.struct(at, event)).alias("_row")
    return rows.groupBy(*key).agg(best).select("_row.*")
