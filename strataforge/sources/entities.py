"""Reading the files of one entity that come in several formats."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strataforge.operators.schema import standardize_columns
from strataforge.session import staged

# Kinds of files by suffix; any other path is read as Parquet.
SEPARATORS = {".csv": ",", ".tsv": "\t"}
CORRUPT = "_corrupt_record"
REFUSED = "path string, record string"

INTEGERS = ("tinyint", "smallint", "int", "bigint")
FLOATS = ("float", "double")
TIMES = ("date", "timestamp_ntz", "timestamp")


def widest(kinds: Iterable[str]) -> str:
    """The type that holds the values of all given types; text where numbers, times and others mix.

    A floating type makes the column double, in which whole numbers above 2^53 are rounded.
    """
    found = sorted(set(kinds) - {"void"})
    if len(found) <= 1:
        return found[0] if found else "string"
    if set(found) <= set(INTEGERS):
        return max(found, key=INTEGERS.index)
    if set(found) <= set(TIMES):
        return max(found, key=TIMES.index)
    scales = [_decimal(k) for k in found if k not in FLOATS]
    if all(scales) and len(scales) < len(found):
        return "double"
    if all(scales):
        scale = max(s for _, s in scales)
        whole = max(w for w, _ in scales)
        return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else "string"
    return "string"


def _decimal(kind: str) -> tuple[int, int] | None:
    """Digits before and after the point that the values of a type need; None for other types."""
    if kind.startswith("decimal("):
        precision, scale = (int(n) for n in kind[8:-1].split(","))
        return precision - scale, scale
    digits = dict(zip(INTEGERS, (3, 5, 10, 19))).get(kind)
    return (digits, 0) if digits else None


def _as(column: str, kind: str, wanted: str) -> Column:
    value = F.col(f"`{column}`")
    if kind == wanted:
        return value
    if wanted == "string" and kind.startswith(("struct", "array", "map")):
        return F.to_json(value)
    return value.cast(wanted)


def aligned(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames, their common columns cast to the wider of the two types."""
    kinds = [dict(df.dtypes) for df in (first, second)]
    wanted = {n: widest(k[n] for k in kinds if n in k) for n in {**kinds[0], **kinds[1]}}
    a, b = (df.select(*[_as(n, k, wanted[n]).alias(n) for n, k in df.dtypes]) for df in (first, second))
    return a, b


def union_widened(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of the parts by column name, each column in the widest of its types, NULL where a part lacks it."""
    kinds: dict[str, list[str]] = defaultdict(list)
    for part in parts:
        for name, kind in part.dtypes:
            kinds[name].append(kind)
    wanted = {name: widest(found) for name, found in kinds.items()}
    same = [part.select(*[_as(n, k, wanted[n]).alias(n) for n, k in part.dtypes]) for part in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, line): the first line with text of every file below the paths.

    Each task combines its own lines, so one row per file travels.
    """
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    placed = lines.withColumn("at", F.struct("start", F.monotonically_increasing_id())).filter(F.trim("value") != "")
    return placed.groupBy("path").agg(F.min_by("value", "at").alias("line"))


def _groups(spark: SparkSession, paths: Sequence[str], kind: Column) -> dict[str, list[str]]:
    """Files by what their first line says; the driver reads a listing, as it does for any scan."""
    found: dict[str, list[str]] = defaultdict(list)
    for row in first_lines(spark, paths).select("path", kind.alias("kind")).collect():
        found[row["kind"]].append(unquote(row["path"]))
    return {kind: sorted(files) for kind, files in sorted(found.items())}


def _parsed(inferred: DataFrame, reader, load) -> DataFrame:
    """Rows by the inferred types, each with its path and, where it did not parse, its text; parsed once."""
    fields = [f for f in inferred.schema if f.name != CORRUPT]
    full = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    rows = load(reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    return staged(rows.select("*", F.col("_metadata.file_path").alias("_path")), "entity-text")


def _separated(spark: SparkSession, paths: Sequence[str], separator: str, sampling: float, multiline: bool) -> list[DataFrame]:
    """One frame for each different header."""
    def reader():
        return (
            spark.read.option("header", True).option("sep", separator).option("escape", '"').option("multiLine", multiline)
        )

    frames = []
    for files in _groups(spark, paths, F.col("line")).values():
        inferred = reader().option("inferSchema", True).option("samplingRatio", sampling).csv(files)
        frames.append(_parsed(inferred, reader(), lambda r, files=files: r.csv(files)))
    return frames


def _json(spark: SparkSession, paths: Sequence[str], sampling: float) -> list[DataFrame]:
    """One frame for files of one object a line, one for files that hold a single document or array."""
    whole = F.col("line").rlike(r"^\s*\{") & F.try_parse_json("line").isNotNull()
    frames = []
    for kind, files in _groups(spark, paths, F.when(whole, "lines").otherwise("document")).items():
        reader = spark.read.option("multiLine", kind == "document")
        inferred = reader.option("samplingRatio", sampling).json(files)
        again = spark.read.option("multiLine", kind == "document")
        frames.append(_parsed(inferred, again, lambda r, files=files: r.json(files)))
    return frames


def _parquet(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """One frame with the columns of all files; one for each schema where the types of a column differ."""
    try:
        return [spark.read.option("mergeSchema", True).parquet(*paths)]
    except (Py4JJavaError, PySparkException) as error:
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    same: dict[str, list[str]] = defaultdict(list)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(list(paths))
    for row in files.select("path").sort("path").collect():
        same[spark.read.parquet(row["path"]).schema.json()].append(row["path"])
    return [spark.read.parquet(*group) for group in same.values()]


def read_entity_files(
    spark: SparkSession, paths: Sequence[str], sampling: float = 1.0, multiline: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): all files of one entity in one schema, and the records that did not parse.

    Paths are files or folders; their suffix tells csv, tsv and json, anything else is
    Parquet.  Column names are standardised first, then types are widened by
    name: whole numbers to the longer type, numbers to double or a decimal that holds both,
    dates to times, all else to text.  CSV files are read by their own header, so columns
    may stand in another order or be missing in some of them; JSON files hold one object
    a line, or one document or array each.  Text is parsed once and staged as Parquet, with
    records that have too many or too few fields, broken JSON, or values outside the
    inferred type set aside as (path, record).  Files without text have no rows;
    an entity with no row in any file is an error, as it has no schema.  ``sampling`` below 1 infers
    types from a share of the rows; ``multiline`` admits line breaks inside quoted values.
    """
    kinds: dict[str, list[str]] = defaultdict(list)
    for path in paths:
        suffix = path.lower().rstrip("/")
        kinds[next((s for s in (*SEPARATORS, ".json") if suffix.endswith(s)), ".parquet")].append(path)
    text = []
    for suffix, separator in SEPARATORS.items():
        if kinds[suffix]:
            text += _separated(spark, kinds[suffix], separator, sampling, multiline)
    if kinds[".json"]:
        text += _json(spark, kinds[".json"], sampling)
    broken = F.col(CORRUPT).isNotNull()
    parts = [standardize_columns(df.filter(~broken).drop(CORRUPT, "_path")) for df in text]
    parts += [standardize_columns(df) for df in (_parquet(spark, kinds[".parquet"]) if kinds[".parquet"] else [])]
    if not parts:
        raise ValueError(f"no rows in {list(paths)}")
    refused = [df.filter(broken).select(F.col("_path").alias("path"), F.col(CORRUPT).alias("record")) for df in text]
    return union_widened(parts), reduce(DataFrame.unionByName, refused, spark.createDataFrame([], REFUSED))
