"""Registration of queries and of their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from strataforge.plans.views import VIEWS, needed_tables, with_views
from strataforge.session import prepare, size_shuffles, stored_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_SIZES: dict[str, int] = {}
_SCHEMAS: dict[str, StructType] = {}  # per path: footers are read once per process


class Inputs:
    """The given tables and the views derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")
        if self.folder not in _SIZES:
            _SIZES[self.folder] = stored_bytes(spark, self.folder)
        size_shuffles(spark, _SIZES[self.folder])

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def sql(self, statement: str) -> DataFrame:
        """Run a statement over tables and views; no name stays registered."""
        names = needed_tables(statement)
        text = with_views(statement.replace("{", "{{").replace("}", "}}"), ",\n".join(f"{n} AS (SELECT * FROM {{{n}}})" for n in names))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register


def half_up(expression: str, digits: int) -> str:
    """DuckDB text that rounds a double the way Spark does: half up on its decimal form."""
    return (
        f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,15)), {digits}) AS DOUBLE)"
    )
