"""A ledger of table versions: audited publication, bundles, tags, checkpoints.

Each commit is one small file below ``<root>/_ledger/version=n``.  It is written
apart and renamed there, which fails when version n exists, so a writer that
started from an older state cannot publish, and one that dies blocks nobody.
The rename is one step where the store has such a step, as HDFS does; on a store
without it, and on local disks, writers need a lock of their own.  Tables are never changed in place: a commit names the folder
that holds the live version of each table, or, for a table split by key
buckets, the folder of each bucket.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strataforge.session import staged
from strataforge.sources.sinks import exists, rename_new

Gate = Callable[[DataFrame], DataFrame]  # candidate -> rows (check, failures)

_SHAPE = T.StructType([T.StructField(name, T.StringType()) for name in ("tables", "tags", "state")])


class VersionConflict(RuntimeError):
    """The ledger moved on since the caller read it."""


class GateFailure(RuntimeError):
    """A candidate did not pass its checks; it stays at ``path`` for inspection."""

    def __init__(self, path: str, failures: Mapping[str, int]):
        super().__init__(f"{path}: {dict(failures)}")
        self.path, self.failures = path, dict(failures)


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._folder = f"{self.root}/_ledger"

    def _commits(self) -> dict[int, str]:
        """The file of every finished commit; a listing, no job."""
        if not exists(self.spark, self._folder):
            return {}
        found = {}
        for path in self.spark.read.text(self._folder).inputFiles():
            found[int(re.search(r"/version=(\d+)/", path)[1])] = path
        return found

    def head(self) -> dict:
        """The latest commit: version, tables, tags, state.  Every commit holds all of them."""
        commits = self._commits()
        if not commits:
            return {"version": 0, "tables": {}, "tags": {}, "state": {}}
        version = max(commits)
        row = self.spark.read.schema(_SHAPE).json(commits[version]).first()
        return {"version": version, **{name: json.loads(row[name]) for name in _SHAPE.fieldNames()}}

    def commit(
        self,
        expected: int,
        tables: Mapping[str, str | Mapping[str, str]] | None = None,
        tags: Mapping[str, Mapping[str, str]] | None = None,
        state: Mapping[str, object] | None = None,
    ) -> int:
        """Append the commit after version ``expected``; fail when that is no longer the latest."""
        head = self.head()
        if head["version"] != expected:
            raise VersionConflict(f"expected version {expected}, found {head['version']}")
        row = (
            json.dumps({**head["tables"], **(tables or {})}, sort_keys=True),
            json.dumps({**head["tags"], **(tags or {})}, sort_keys=True),
            json.dumps({**head["state"], **(state or {})}, sort_keys=True),
        )
        version = expected + 1
        frame = self.spark.createDataFrame([row], _SHAPE).coalesce(1)
        written = f"{self.root}/_pending/{uuid.uuid4().hex}"
        frame.write.mode("errorifexists").json(written)
        if not rename_new(self.spark, written, f"{self._folder}/version={version}"):
            raise VersionConflict(f"version {version} was published by another writer")
        return version

    def stage(self, table: str, df: DataFrame) -> str:
        """Write a candidate version apart from the live one."""
        path = f"{self.root}/{table}/v={uuid.uuid4().hex[:12]}"
        df.write.mode("errorifexists").parquet(path)
        return path

    def live(self, table: str) -> DataFrame | None:
        return self._open(self.head()["tables"].get(table))

    def _open(self, place) -> DataFrame | None:
        """Read a table from its folder, or from the folders of its buckets."""
        if not place:
            return None
        # buckets written before and after a column was added differ: all columns are read
        return self.spark.read.option("mergeSchema", "true").parquet(*([place] if isinstance(place, str) else place.values()))

    def merge_buckets(
        self,
        table: str,
        key: Sequence[str],
        changes: DataFrame,
        step: Callable[[DataFrame, DataFrame], DataFrame],
        buckets: int = 256,
        state: Mapping[str, object] | None = None,
    ) -> int:
        """Publish ``step(changes, live rows)``, reading and writing only the key buckets that have changes.

        ``step`` must keep every row it does not replace.  The number of buckets
        is fixed when the table is first written; a bucket larger than one task
        should hold is split over several files.
        """
        head = self.head()
        places = dict(head["tables"].get(table) or {})
        setting = f"buckets:{table}"
        buckets = head["state"].get(setting, buckets)
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        changes = staged(changes, "bucket-changes")
        touched = [str(r[0]) for r in changes.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        before = self._open({b: places[b] for b in touched if b in places})
        if before is None:
            before = self.spark.createDataFrame([], changes.schema)
        path = f"{self.root}/{table}/v={uuid.uuid4().hex[:12]}"
        after = step(changes, before).withColumn("_bucket", bucket)
        after.hint("rebalance", "_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(path)
        for b in touched:
            places.pop(b, None)
            if exists(self.spark, f"{path}/_bucket={b}"):
                places[b] = f"{path}/_bucket={b}"
        return self.commit(head["version"], {table: places}, state={**(state or {}), setting: buckets})

    def replace(self, table: str, df: DataFrame) -> int:
        """Create or replace a table without gates."""
        version = self.head()["version"]
        return self.commit(version, {table: self.stage(table, df)})

    def write_audit_publish(self, table: str, df: DataFrame, *gates: Gate) -> int:
        """Stage, check, and publish only when no gate reports a failure."""
        version = self.head()["version"]
        path = self.stage(table, df)
        self._require(path, *gates)
        return self.commit(version, {table: path})

    def _require(self, path: str, *gates: Gate) -> None:
        candidate = self.spark.read.parquet(path)
        for gate in gates:
            failed = gate(candidate).filter("failures > 0").collect()  # one row per check
            if failed:
                raise GateFailure(path, {r["check_name"]: r["failures"] for r in failed})

    def prepare_bundle(self, frames: Mapping[str, DataFrame], gates: Mapping[str, Gate] | None = None) -> dict:
        """Stage several outputs against the versions that are live now."""
        head = self.head()
        paths = {name: self.stage(name, df) for name, df in frames.items()}
        for name, gate in (gates or {}).items():
            self._require(paths[name], gate)
        return {"base": head["version"], "before": {n: head["tables"].get(n) for n in paths}, "paths": paths}

    def publish_bundle(self, bundle: Mapping, sources: Mapping[str, str] | None = None) -> int:
        """Publish all outputs in one commit if sources and targets are as they were; a repeat does nothing."""
        head = self.head()
        if all(head["tables"].get(n) == p for n, p in bundle["paths"].items()):
            return head["version"]
        if any(head["tables"].get(n) != p for n, p in bundle["before"].items()):
            raise VersionConflict("a target changed since the bundle was prepared")
        if any(head["tables"].get(n) != p for n, p in (sources or {}).items()):
            raise VersionConflict("a source changed since the bundle was prepared")
        return self.commit(head["version"], bundle["paths"])

    def tag(self, name: str) -> int:
        """Give the present versions of all tables a name; an existing name is kept."""
        head = self.head()
        if name in head["tags"]:
            return head["version"]
        return self.commit(head["version"], tags={name: head["tables"]})

    def read_at(self, table: str, tag: str) -> DataFrame:
        return self._open(self.head()["tags"][tag][table])
