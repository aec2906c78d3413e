"""Related tables from their files to a published mart, run after run.

A run leaves one folder with the state of every entity and the mart, and a
contract that names them.  The contract is written last, as one Parquet folder: a
run counts once its contract is there, so readers see all outputs of a run or none.  The next run
starts from the contract: keys once inferred are kept, entities without new files keep
their state, and new columns or entities are planned with what is known.
One writer at a time works on a context.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from strataforge.functions.text import snake_case
from strataforge.operators import audit, star
from strataforge.session import staged
from strataforge.sources.entities import aligned, read_entity_files
from strataforge.sources.sinks import exists, observed, replace_quarantine

CONTRACT = """sequence int, run string, entity string, role string, key array<string>, candidates array<array<string>>,
  columns array<string>, join_columns array<string>, confidence double, rows bigint, refused bigint, path string"""
MART = "mart"
NO_KEY = "MISSING_KEY"
UNREADABLE = "UNREADABLE_RECORD"
REJECTED = "entity string, path string, record string, rejection_reason string"


class ContextRefused(RuntimeError):
    """The context has no safe anchor, or its outputs do not agree; nothing was published."""


@dataclass(frozen=True)
class ContextRun:
    run: str
    contract: tuple[Row, ...]
    mart: DataFrame
    states: Mapping[str, DataFrame]


def _folder(root: str, context_id: str) -> str:
    return f"{root.rstrip('/')}/{snake_case(context_id)}"


def contracts(spark: SparkSession, root: str, context_id: str) -> DataFrame | None:
    """The contracts of all published runs, one row per entity and one for the mart; None before the first."""
    path = f"{_folder(root, context_id)}/contracts"
    return spark.read.schema(CONTRACT).option("recursiveFileLookup", True).parquet(path) if exists(spark, path) else None


def published(spark: SparkSession, root: str, context_id: str, run: str | None = None) -> ContextRun | None:
    """Mart and states of one run, the latest by default."""
    known = contracts(spark, root, context_id)
    if known is None:
        return None
    wanted = known.filter(F.col("run") == run) if run is not None else known
    last = wanted.agg(F.max("sequence").alias("n")).first()["n"]
    rows = tuple(wanted.filter(F.col("sequence") == last).orderBy("entity").collect()) if last is not None else ()
    if not rows:
        return None
    tables = {r["entity"]: spark.read.parquet(r["path"]) for r in rows}
    return ContextRun(rows[0]["run"], rows, tables[MART], {n: df for n, df in tables.items() if n != MART})


def _entity_paths(manifest: DataFrame, context_id: str, base: str) -> dict[str, list[str]]:
    """Paths by entity; a listing, which the driver needs to plan the scans."""
    found: dict[str, list[str]] = {}
    for row in manifest.filter(F.col("context_id") == context_id).select("entity", "path").orderBy("entity", "path").collect():
        found.setdefault(snake_case(row["entity"]), []).append(f"{base}{row['path']}")
    return found


def _write(df: DataFrame, path: str) -> int:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return observed(seen).get("rows", 0)


def _safe(profile: star.Profile) -> star.Profile:
    """A key that is not safe would merge different rows into one: such a table is kept by whole rows."""
    if profile.confidence >= star.SAFE_FROM:
        return profile
    return star.Profile(profile.entity, profile.columns, (), profile.confidence, profile.row_count, ())


def _profile(known: Row | None, entity: str, df: DataFrame) -> star.Profile:
    """From the contract, with new columns added; inferred for an entity seen first."""
    if known is None:
        return _safe(star.infer_key(df, entity))
    columns = tuple(dict.fromkeys([*known["columns"], *df.columns]))
    return star.Profile(entity, columns, tuple(known["key"]), known["confidence"], known["rows"], tuple(map(tuple, known["candidates"])))


def _rejected(entity: str, df: DataFrame, refused: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a key, rejected records): text that did not parse, and rows whose key has a NULL or is absent."""
    bad = refused.select(F.lit(entity).alias("entity"), "path", "record", F.lit(UNREADABLE).alias("rejection_reason"))
    absent = [k for k in key if k not in df.columns]
    lacking = F.lit(True) if absent else reduce(or_, [F.col(k).isNull() for k in key], F.lit(False))
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    keyless = df.filter(lacking).select(F.lit(entity).alias("entity"), F.lit(None).cast("string").alias("path"), text.alias("record"), F.lit(NO_KEY).alias("rejection_reason"))
    return df.filter(~lacking), bad.unionByName(keyless)


def process_context(
    spark: SparkSession,
    manifest: DataFrame,
    context_id: str,
    root: str,
    run: str,
    base: str = "",
    tie_break: Mapping[str, Sequence[str]] | None = None,
    sampling: float = 1.0,
) -> ContextRun:
    """Read the files of a context, merge every entity into its state, build the star mart and publish all of it.

    ``manifest`` holds (context_id, entity, path) of the files of this run, as
    ``context_manifest`` gives them, below ``base``.  Records that do not parse and rows without key are
    written under the run's name and counted in the contract.  Published are states without
    repeated keys and a mart with exactly the rows of its anchor, or nothing.  A run that failed can be
    started again under its name; one that is published already is returned as it is.
    """
    done = published(spark, root, context_id, run)
    if done is not None:
        return done
    before = published(spark, root, context_id)
    known = {r["entity"]: r for r in before.contract if r["entity"] != MART} if before else {}
    paths = _entity_paths(manifest, context_id, base)
    if not paths:
        raise ContextRefused(f"{context_id}: no files")
    if MART in paths:
        raise ContextRefused(f"{context_id}: '{MART}' is no name for an entity")
    folder = f"{_folder(root, context_id)}/runs/{run}"
    order = tie_break or {}
    profiles, rejected, changes = {}, [], {}
    for entity, files in paths.items():
        rows, refused = read_entity_files(spark, files, sampling)
        profile = _profile(known.get(entity), entity, rows)
        changes[entity], bad = _rejected(entity, rows, refused, profile.key)
        profiles[entity] = profile
        rejected.append(bad)
    for entity, row in known.items():
        profiles.setdefault(entity, star.Profile(entity, tuple(row["columns"]), tuple(row["key"]), row["confidence"], row["rows"], tuple(map(tuple, row["candidates"]))))
    plan = star.star_plan(spark, [profiles[n] for n in sorted(profiles)])
    (anchor,) = star.role_rows(plan, "anchor")
    if not anchor["join_columns"] or anchor["confidence"] < star.SAFE_FROM:
        raise ContextRefused(f"{context_id}: no safe anchor key")
    rejects = staged(reduce(DataFrame.unionByName, rejected, spark.createDataFrame([], REJECTED)), "context-rejects")
    refused_rows = {r["entity"]: r["n"] for r in rejects.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).collect()}
    replace_quarantine(rejects, f"{_folder(root, context_id)}/quarantine", run)
    places, counts = {}, {}
    for entity, profile in profiles.items():
        if entity not in changes:
            places[entity], counts[entity] = known[entity]["path"], known[entity]["rows"]
            continue
        state = before.states.get(entity) if before else None
        fresh = changes[entity]
        if state is not None:
            state, fresh = aligned(state, fresh)
        places[entity] = f"{folder}/{entity}"
        counts[entity] = _write(star.entity_state(profile, fresh, state, order.get(entity, ())), places[entity])
    states = {n: spark.read.parquet(p) for n, p in places.items()}
    for entity, profile in profiles.items():
        repeated = audit.check_grain(states[entity], list(profile.key)).limit(5).collect() if profile.key and entity in changes else []
        if repeated:
            raise ContextRefused(f"{entity}: repeated keys {repeated}")
    places[MART] = f"{folder}/{MART}"
    counts[MART] = _write(star.star_join(states, plan, context_id, order), places[MART])
    if counts[MART] != counts[anchor["entity"]]:
        raise ContextRefused(f"{context_id}: {counts[MART]} rows in the mart, {counts[anchor['entity']]} in {anchor['entity']}")
    number = before.contract[0]["sequence"] + 1 if before else 1
    links = {r["entity"]: r for r in plan}
    lines = [
        (number, run, n, links[n]["role"], list(p.key), [list(c) for c in p.candidates], [c for c in states[n].columns if c != star.ROW_KEY],
         list(links[n]["join_columns"]), p.confidence, counts[n], refused_rows.get(n, 0), places[n])
        for n, p in sorted(profiles.items())
    ]
    mart = spark.read.parquet(places[MART])
    lines.append((number, run, MART, MART, list(anchor["join_columns"]), [], mart.columns, [], anchor["confidence"], counts[MART], 0, places[MART]))
    spark.createDataFrame(lines, CONTRACT).coalesce(1).write.mode("overwrite").parquet(f"{_folder(root, context_id)}/contracts/run={run}")
    return published(spark, root, context_id, run)
