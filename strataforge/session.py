"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator may rely on.  Shuffle partition numbers are
# left to the cluster; adaptive execution coalesces and splits from there.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # documents differ in size: bound the batches handed to Python by bytes, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="strataforge-package-"), "strataforge.zip")
    with zipfile.ZipFile(archive, "w") as files:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    files.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def prepare(spark: SparkSession) -> SparkSession:
    ship(spark)
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "strataforge", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


SHUFFLE_TARGET = 256 * 1024**2  # bytes one shuffle partition should hold
EXPANSION = 3  # shuffled rows against the compressed columns they were read from
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shuffle_partitions_for(input_bytes: int, at_least: int) -> int:
    """Partitions that keep a shuffle of the input within executor memory."""
    return max(at_least, -(-input_bytes * EXPANSION // SHUFFLE_TARGET))


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Start shuffles with enough partitions for the input.

    Adaptive execution joins partitions that turn out small, but it splits only
    skewed ones, so a start with too few could not be repaired.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = shuffle_partitions_for(input_bytes, usual)
    if wanted > usual:
        spark.conf.set(INITIAL, str(wanted))
    else:
        spark.conf.unset(INITIAL)
    return wanted


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path, from the file system's own summary."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(target).getLength()


_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_roots:
        _local_roots[application] = tempfile.mkdtemp(prefix="strataforge-")
    return _local_roots[application]


def scratch(spark: SparkSession, label: str) -> str:
    """A path nobody has used before, below the shared folder."""
    return f"{shared_root(spark)}/strataforge/{label}-{uuid.uuid4().hex[:12]}"


_written: dict[str, list[str]] = {}


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it from there.

    Later steps neither repeat the work nor depend on executors that may be
    lost, and Spark plans their joins with the written size.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> int:
    """Delete the intermediate tables this application staged, once its results are published."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
