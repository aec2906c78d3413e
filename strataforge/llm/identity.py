"""A total order of rows whose ids may repeat or be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strataforge.functions.windows import rank_in_order


def ordered_key(docs: DataFrame, doc: str, text: str, key: str) -> DataFrame:
    """Add a unique long ``key`` that ascends with (id, text).

    Unique whole-number ids are the key themselves, which one count tells without moving
    texts.  Otherwise, and for ids of other types, rows are numbered by range partitions: NULL ids first, equal ids
    by text; rows equal in both are interchangeable.
    """
    if docs.schema[doc].dataType.typeName() in ("byte", "short", "integer", "long"):
        ids = docs.select(F.col(doc).alias("i"))
        total, given = ids.agg(F.count(F.lit(1)), F.count("i")).first()
        if total == given and ids.groupBy("i").count().where("count > 1").isEmpty():
            return docs.withColumn(key, F.col(doc).cast("long"))
    return rank_in_order(docs, [], [F.col(doc).asc_nulls_first(), F.col(text).asc_nulls_first()], key)
