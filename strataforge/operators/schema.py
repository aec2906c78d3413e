"""Column names, contracts, metadata and schema evolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strataforge.functions.checksum import json_checksum
from strataforge.functions.frames import attach
from strataforge.functions.text import snake_case
from strataforge.functions.windows import rows_between
from strataforge.operators.audit import METADATA_COLUMNS


@dataclass(frozen=True)
class Contract:
    """A registered dataset: declared source fields, canonical names, key and control fields."""

    dataset: str
    schema_version: str
    source: T.StructType
    canonical: Mapping[str, str]
    key: Sequence[str]
    record_id: str
    updated_at: str
    deleted: str | None = None
    system: str = ""
    rules: Sequence[tuple[str, str]] = field(default_factory=tuple)

    @property
    def source_fields(self) -> list[str]:
        return self.source.fieldNames()

    @property
    def canonical_fields(self) -> list[str]:
        return [self.canonical.get(f, f) for f in self.source_fields]

    def batch_schema(self) -> T.StructType:
        """Declared fields and metadata, all nullable, so that damaged rows can be read and rejected."""
        timed = ("_source_updated_at", "_ingested_at")
        fields = [T.StructField(f.name, f.dataType, True) for f in self.source.fields]
        for name in METADATA_COLUMNS:
            fields.append(T.StructField(name, T.TimestampType() if name in timed else T.StringType(), True))
        return T.StructType(fields)


def standardize_columns(df: DataFrame) -> DataFrame:
    """Snake-case all column names; two names that become one are an error.  No data is read."""
    names = [snake_case(c) for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"columns with the same standard name: {repeated}")
    return df.toDF(*names)


def apply_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns that exist and whose standard name differs."""
    pairs = {snake_case(a): snake_case(b) for a, b in mapping.items()}
    return df.withColumnsRenamed({a: b for a, b in pairs.items() if a in df.columns and a != b})


def to_canonical(df: DataFrame, contract: Contract) -> DataFrame:
    """Declared fields under canonical names, then the metadata columns; other fields are left out."""
    missing = [c for c in [*contract.source_fields, *METADATA_COLUMNS] if c not in df.columns]
    if missing:
        raise ValueError(f"missing fields: {missing}")
    return df.select(
        *[F.col(a).alias(b) for a, b in zip(contract.source_fields, contract.canonical_fields)], *METADATA_COLUMNS
    )


def with_extra_fields(raw: DataFrame, column: str, contract: Contract) -> DataFrame:
    """Parse JSON text: declared fields by their declared types, others inferred and sorted by name.

    One aggregate over all records finds the fields; only its schema text
    reaches the driver.
    """
    found = raw.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column)))).first()[0]
    inferred = _struct_of(found)
    clash = sorted(set(inferred.fieldNames()) & set(METADATA_COLUMNS))
    if clash:
        raise ValueError(f"fields with reserved names: {clash}")
    extra = sorted((f for f in inferred.fields if f.name not in contract.source_fields), key=lambda f: f.name)
    full = T.StructType([*contract.source.fields, *extra])
    others = [c for c in raw.columns if c != column]
    return raw.withColumn("_parsed", F.from_json(F.col(column), full)).select(*others, "_parsed.*")


def _struct_of(schema_text: str) -> T.StructType:
    """The variant schema text ``OBJECT<a: BIGINT>`` as a struct type; untyped nulls become text."""
    if not schema_text.startswith("OBJECT<"):
        raise ValueError(f"records are not JSON objects: {schema_text}")
    ddl = schema_text.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return T.StructType.fromDDL(f"root: {ddl}").fields[0].dataType


# Type a new target column gets; every other type becomes text.
EVOLVED_TYPES = {
    "tinyint": "string",
    "smallint": "string",
    "int": "int",
    "bigint": "bigint",
    "float": "double",
    "double": "double",
    "boolean": "boolean",
    "timestamp": "timestamp",
    "date": "date",
}


def evolve(target: DataFrame, incoming: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Target with the incoming columns it lacks (names compared without case), NULL in its rows."""
    known = {c.lower() for c in target.columns}
    fresh = {
        name.lower(): F.lit(None).cast(EVOLVED_TYPES.get(kind, "string"))
        for name, kind in incoming.dtypes
        if name.lower() not in known
    }
    return target.drop(*drop).withColumns(fresh)


def stamp(
    df: DataFrame,
    contract: Contract,
    batch_id: str,
    ingested_at,
    mode: str = "FULL",
    source_type: str = "API",
) -> DataFrame:
    """Add the nine metadata columns; a record's own checksum covers its source fields."""
    reserved = sorted(set(METADATA_COLUMNS) & set(df.columns))
    if reserved:
        raise ValueError(f"fields with reserved names: {reserved}")
    values = {
        "_source_system": F.lit(contract.system),
        "_source_type": F.lit(source_type),
        "_dataset": F.lit(contract.dataset),
        "_schema_version": F.lit(contract.schema_version),
        "_ingestion_mode": F.lit(mode),
        "_batch_id": F.lit(batch_id),
        "_source_updated_at": F.col(contract.updated_at).cast("timestamp"),
        "_ingested_at": F.lit(ingested_at).cast("timestamp"),
        "_record_checksum": json_checksum(
            df.select(*contract.source_fields), {c: c for c in contract.source_fields}, contract.source_fields
        ),
    }
    return df.withColumns(values)


def search(df: DataFrame, text: str, order: Sequence[str], page: int = 1, size: int = 20) -> DataFrame:
    """Rows in which any column contains the text, without case; one page in the given order."""
    whole = F.lower(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in df.columns]))
    found = df.filter(whole.contains(text.lower()))
    return rows_between(found, order, (page - 1) * size, size)


def preview(df: DataFrame, n: int = 50, order: Sequence[Column] = (), where: Mapping | None = None) -> DataFrame:
    """The first ``n`` rows (1 to 500) in the given order, each with the number of all matching rows."""
    n = max(1, min(int(n), 500))
    for column, value in (where or {}).items():
        df = df.filter(F.col(column) == F.lit(value))
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return attach(df.orderBy(*order).limit(n), total)


def distinct_units(df: DataFrame, unit: str, label: str) -> DataFrame:
    return df.select(unit, label).distinct().orderBy(unit, label)


def prefix_columns(df: DataFrame, entity: str, keys: Sequence[str], technical: Sequence[str]) -> DataFrame:
    """Key columns as they are, business columns as ``entity__column``, technical columns left out."""
    business = [c for c in df.columns if c not in keys and not c.lower().startswith(tuple(technical))]
    return df.select(*keys, *[F.col(c).alias(f"{entity}__{c}") for c in business])
