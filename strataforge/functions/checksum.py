"""Row fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

SEPARATOR = "||"  # fixed values: separator and the mark for a missing value
NULL_MARK = "<NULL>"


def joined_text(columns: Sequence[str], null_mark: str = NULL_MARK, separator: str = SEPARATOR) -> Column:
    return F.concat_ws(
        separator, *[F.coalesce(F.col(c).cast("string"), F.lit(null_mark)) for c in columns]
    )


def row_checksum(columns: Sequence[str], null_mark: str = NULL_MARK) -> Column:
    """SHA-256 of the text of the columns."""
    return F.sha2(joined_text(columns, null_mark), 256)


def with_row_checksum(df: DataFrame, updated_at: str, name: str = "_record_checksum") -> DataFrame:
    """Add the checksum of all columns but the change time and the checksum itself."""
    return df.withColumn(name, row_checksum([c for c in df.columns if c not in (updated_at, name)]))


def json_checksum(df: DataFrame, aliases: Mapping[str, str] | None = None, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of compact JSON with sorted keys.

    ``aliases`` maps current names to the names the checksum was first built
    with; it applies only when the record has exactly those fields.
    """
    fields = list(columns or df.columns)
    names = {c: c for c in fields}
    if aliases and set(aliases) == set(fields):
        names = dict(aliases)
    ordered = sorted(fields, key=names.__getitem__)
    record = F.struct(*[F.col(c).alias(names[c]) for c in ordered])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def with_surrogate_key(
    df: DataFrame, name: str, null_mark: str = "", skip_prefixes: Sequence[str] = ()
) -> DataFrame:
    """Use the hash of the whole row as key when no business key exists."""
    used = [c for c in df.columns if not c.lower().startswith(tuple(skip_prefixes))]
    return df.withColumn(name, row_checksum(used, null_mark))
