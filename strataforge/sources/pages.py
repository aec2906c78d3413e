"""Landed responses of paged interfaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strataforge.functions.frames import side_by_side

# Fixed value: names under which a response may hold its records, first hit wins.
ENVELOPE_FIELDS = ("data", "items", "records", "results")
HEADER_FIELDS = ("source_system", "dataset", "schema_version")


def merge_pages(
    pages: DataFrame, id_field: str, header_fields: Sequence[str] = HEADER_FIELDS, data: str = "data"
) -> tuple[DataFrame, DataFrame]:
    """(records, audit).  ``audit`` counts headers that differ, repeated ids and records.

    The pages are valid when both counts are 0.
    """
    records = pages.select(F.inline(data))
    headers = pages.select(*header_fields).distinct().agg((F.count(F.lit(1)) - 1).alias("differing_headers"))
    repeated = (
        records.groupBy(id_field).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.count(F.when(F.col("_n") > 1, 1)).alias("repeated_ids"), F.coalesce(F.sum("_n"), F.lit(0)).alias("returned"))
    )
    audit = side_by_side(headers, repeated).withColumn(
        "accepted", (F.col("differing_headers") <= 0) & (F.col("repeated_ids") == 0)
    )
    return records, audit


def unwrap(responses: DataFrame, column: str, record_type: str) -> DataFrame:
    """Records of JSON responses: a list as is, the first non-empty known list of an object, or the object."""
    text = F.col(column)
    lists = f"array<{record_type}>"

    def listed(name: str) -> Column:
        part = F.get_json_object(text, f"$.{name}")
        found = F.when(part.startswith("["), F.from_json(part, lists))
        return F.when(F.size(found) > 0, found)

    plain = F.from_json(text, lists)
    whole = F.array(F.from_json(text, record_type))
    is_list = F.ltrim(text).startswith("[")
    records = F.when(is_list, plain).otherwise(F.coalesce(*[listed(n) for n in ENVELOPE_FIELDS], whole))
    others = [c for c in responses.columns if c != column]
    return responses.withColumn("_records", records).select(*others, F.inline("_records"))
