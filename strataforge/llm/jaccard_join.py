"""N-gram Jaccard join with token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from strataforge.llm.graph import components
from strataforge.llm.text import batches_of, fresh, let_go, mix, ready, shingle_set, utf8, word_hashes
from strataforge.session import staged

WORDS = 5  # words of a shingle
PERCENT = 80  # two sets link from this share of their union
TABLE_BITS = 18  # buckets that count the documents with a shingle
COUNT_CHUNK = 1 << 12
SLICE_BYTES = 1 << 20
FREQUENT = 48  # a bucket this far above what chance explains holds a frequent shingle


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    words, at = word_hashes(data, offsets, True)
    return [shingle_set(words[at[i] : at[i + 1]], k) for i in range(len(offsets) - 1)]


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    a = int(mix(shingles).sum(dtype=np.uint64))
    b = int(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))


PARITY = [f"p{i}" for i in range(8)]  # 512 bits


BINS = 512


def binned(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of 512 bins by hash."""
    return np.bincount((mix(shingles + np.uint64(7)) >> np.uint64(55)).astype(np.int64), minlength=BINS)


def parity(counts: np.ndarray) -> np.ndarray:
    """512 bits, each telling whether a bin's count is odd.

    Sets that differ in d shingles differ in d of these bits at most.
    """
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def profile(counts: np.ndarray) -> bytes:
    """The counts, 255 at most.  Between sets that differ in d shingles their differences add up to d at most."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_link(left: str, right: str, n: str, m: str, percent: int):
    """A bound that no linked pair breaks: sets of sizes n and m that link differ in few enough shingles."""
    differ = sum((F.bit_count(F.col(f"{left}{p}").bitwiseXOR(F.col(f"{right}{p}"))) for p in PARITY), F.lit(0))
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col(n) + F.col(m)), F.lit(True))


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """Per document its set's size and fingerprint; further rows with ``chunk`` hold shingle counts.

    Sets that a task meets again are counted once: copies say nothing about how
    common a shingle is.  Each task adds one fixed table of counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n", "f1", "f2", *PARITY]
        kind = pa.schema([*((c, pa.int64()) for c in names), ("profile", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])
        table = np.zeros(1 << TABLE_BITS, np.uint32)
        seen: set[tuple[int, int]] = set()
        for part, data, offsets in batches_of(batches, "text", SLICE_BYTES):
            rows, bits, profiles, fresh_sets = [], [], [], []
            for shingles in sets_of(data, offsets, k):
                mark = fingerprint(shingles)
                rows.append((len(shingles), *mark))
                counts = binned(shingles)
                bits.append(parity(counts))
                profiles.append(profile(counts))
                if mark not in seen:
                    seen.add(mark)
                    fresh_sets.append(shingles)
            if fresh_sets:
                table += np.bincount((np.concatenate(fresh_sets) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(table)).astype(np.uint32)
            n, f1, f2 = zip(*rows)
            size = len(rows)
            known = [part.column(0), *(pa.array(x, pa.int64()) for x in (n, f1, f2)), *(pa.array(x) for x in np.array(bits).T.copy())]
            yield pa.record_batch([*known, pa.array(profiles, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], schema=kind)
        if seen:
            chunks = table.reshape(-1, COUNT_CHUNK)
            nulls = pa.nulls(len(chunks), pa.int64())
            yield pa.record_batch([*[nulls] * len(names), pa.nulls(len(chunks), pa.binary()), pa.array(np.arange(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], schema=kind)

    bits = ", ".join(f"{p} long" for p in PARITY)
    return docs.mapInArrow(run, f"doc long, n long, f1 long, f2 long, {bits}, profile binary, chunk int, counts binary")


def frequent_flags(counted: DataFrame) -> np.ndarray:
    """Which buckets hold a frequent shingle; what the driver gets has the table's fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(counts, "<u4").astype(np.int64)
                sums[chunk] = sums[chunk] + found if chunk in sums else found
        if sums:
            yield pa.record_batch({"chunk": pa.array(sums.keys(), pa.int32()), "counts": pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())})

    rows = counted.where("chunk IS NOT NULL").select("chunk", "counts").repartition(64, "chunk")
    table = np.zeros((1 << TABLE_BITS) // COUNT_CHUNK * COUNT_CHUNK, np.int64)
    for row in rows.mapInArrow(add, "chunk int, counts binary").collect():
        table[row.chunk * COUNT_CHUNK :][:COUNT_CHUNK] = np.frombuffer(row.counts, "<i8")
    typical = float(np.median(table))
    return table > typical + max(FREQUENT, 8 * typical**0.5)


@lru_cache(maxsize=4096)
def levels(n: int, percent: int) -> tuple[int, ...]:
    """Levels at which a set of n shingles and its possible partners meet."""
    low, high = -(-percent * n // 100), 100 * n // percent
    return tuple(range(low.bit_length(), high.bit_length() + 1))


def signatures(shingles: np.ndarray, flags: np.ndarray, percent: int) -> np.ndarray:
    """What a set is indexed under: two sets that link share at least one signature.

    Let t be the most shingles that a set of this size can lack in a linked
    one.  All shingles are ordered: rare ones by hash, then the frequent classes by
    number.  A rare shingle is a signature by itself.  The frequent ones fall into
    2**level classes by hash, and each pair within a class is a signature; c
    shingles of a class survive c - 1 losses.  The prefix is extended until it
    survives t losses.  Of two linked sets take the one whose prefix ends first:
    it lacks at most t of its prefix in the other, the rest lies in the other's
    prefix too, so some rare shingle or some pair of a class is in both.

    Sets of about the same size meet at a common level.  A set whose pairs
    cannot survive t losses is indexed by the usual single-shingle prefix as well:
    two such sets meet there, and one such set has all its pairs indexed.
    """
    n = len(shingles)
    lost = n - -(-percent * n // 100)
    if lost == 0 and 100 * n // percent == n:
        return shingles[:0]  # only equal sets link, and those are one class already
    often = flags[(shingles >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    rare = shingles[~often]
    if len(rare) > lost:
        return rare[: lost + 1]
    frequent = shingles[often]
    out = [rare]
    short = False
    for level in levels(n, percent):
        bits = np.uint64(level)
        spread = mix(frequent)
        group = (spread >> (np.uint64(64) - bits)).astype(np.int64)
        order = np.lexsort((frequent, group))
        ordered, group = frequent[order], group[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(first, len(group)))
        survived = len(rare) + np.cumsum(sizes - 1)
        enough = np.flatnonzero(survived > lost)
        if len(enough):
            sizes, first = sizes[: enough[0] + 1], first[: enough[0] + 1]
        else:
            short = True
        salt = np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for size in np.unique(sizes[sizes > 1]).tolist():
            at = first[sizes == size]
            block = ordered[at[:, None] + np.arange(size)]
            a, b = np.triu_indices(size, 1)
            out.append(mix(mix(block[:, a] + salt) + block[:, b]).ravel())
    if short:
        single = np.concatenate([rare, frequent])[: lost + 1]
        out.append(mix(single ^ np.uint64(0x5DEECE66D)))
    return np.unique(np.concatenate(out))


def index(docs: DataFrame, flags: np.ndarray, k: int, percent: int) -> DataFrame:
    """(sig, doc, n): the signatures of each set; a task indexes a set it meets again once."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part, data, offsets in batches_of(batches, "text", SLICE_BYTES):
            found, numbers, sizes = [], [], []
            for i, shingles in enumerate(sets_of(data, offsets, k)):
                mark = fingerprint(shingles)
                if mark in seen:
                    continue
                seen.add(mark)
                sigs = signatures(shingles, shared.value, percent)
                found.append(sigs)
                numbers.append(np.full(len(sigs), i))
                sizes.append(np.full(len(sigs), len(shingles), np.int32))
            if found:
                where = np.concatenate(numbers).astype(np.int64)
                yield pa.record_batch({"sig": np.concatenate(found).astype(np.uint64).view(np.int64), "doc": part.column(0).take(pa.array(where)), "n": np.concatenate(sizes)})

    return docs.mapInArrow(run, "sig long, doc long, n int")


def in_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of documents that occur in a pair."""
    return rows.join(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "doc", "left_semi")


def near(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs that their profiles do not rule out; no linked pair is ruled out.

    Parities fill up in sets of thousands of shingles, counts still tell those apart.
    An id that several sets share is never ruled out.
    """

    @arrow_udf("boolean")
    def possible(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        counts = [np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for x in (a, b)]
        differ = np.abs(counts[0] - counts[1]).sum(axis=1, dtype=np.int64)
        sizes = n.to_numpy(zero_copy_only=False) + m.to_numpy(zero_copy_only=False)
        return pa.array((100 + percent) * differ <= (100 - percent) * sizes)

    one_set = F.min(F.struct("f1", "f2")) == F.max(F.struct("f1", "f2"))
    known = in_pairs(marks, pairs).groupBy("doc").agg(one_set.alias("one"), F.max("n").alias("n"), F.max("profile").alias("profile"))
    for side in ("a", "b"):
        pairs = pairs.join(known.select(F.col("doc").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("one", "n", "profile")]), side)
    pairs = pairs.withColumn("possible", possible("profile_a", "profile_b", "n_a", "n_b"))
    return pairs.where("possible OR NOT one_a OR NOT one_b").select("a", "b")


def verify(pairs: DataFrame, rows: DataFrame, marks: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by comparing the whole sets; only texts of pairs that may link travel."""
    pairs = staged(near(pairs, marks, percent), "near")
    texts = staged(in_pairs(rows, pairs), "texts")

    @arrow_udf("boolean")
    def linked(left: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in left:
            out = []
            last, mine = None, None
            left_data, left_at = utf8(a)
            right_data, right_at = utf8(b)
            left_raw = left_data.tobytes()
            rights = sets_in_parts(right_data, right_at, k)
            for i, other in enumerate(rights):
                text = left_raw[left_at[i] : left_at[i + 1]]
                if text != last:
                    last = text
                    mine = sets_of(left_data[left_at[i] : left_at[i + 1]], np.array([0, len(text)]), k)[0]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                out.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pa.array(out, pa.bool_())

    one = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", linked("text_a", "text_b").alias("ok")).where("ok").select("a", "b")


def sets_in_parts(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    for i in range(0, len(offsets) - 1, 500):
        j = min(i + 500, len(offsets) - 1)
        yield from sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)


def by_class(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents as distinct pairs of the documents that stand for their sets."""
    for side in ("a", "b"):
        pairs = pairs.join(members.select(F.col("doc").alias(side), F.col("rep").alias(f"rep_{side}")), side)
    pairs = pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    return pairs.where("a < b").distinct()


def with_bits(rows: DataFrame, bits: DataFrame, column: str) -> DataFrame:
    """Add the size and parity bits of the document in ``column``, prefixed with its name."""
    return rows.join(bits.select(*[F.col(c).alias(column if c == "doc" else f"{column}_{c}") for c in bits.columns]), column)


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every document.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the distinct
    shingles of ``words`` words, or the whole sequence if shorter.  Two documents
    link when 100 * intersection >= percent * union; the component is the smallest
    id reachable.

    Equal sets are one class, whose smallest id stands for it and is the one
    compared.  Candidates are documents with a common signature (see ``signatures``).  First every document
    is compared with the smallest one of each of its signatures, which joins
    groups of copies without pairing their members; then only pairs that are
    still in different components are compared.  Every link lies within a
    component or is compared, so none is lost, and no group is ever paired out.
    Before whole texts are compared, pairs that cannot link are dropped by a bound on
    how many shingles two linked sets may differ in.

    NULL, empty and wordless texts have an empty set and link with nothing.  Rows
    that repeat an id are one document: linked to whatever any of them is.  A row without
    an id has a size, no component, and links with nothing.  An empty table gives
    an empty result.  Other columns are not read.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    counted = staged(fingerprints(rows, words), "fingerprints")
    marks = counted.where("chunk IS NULL").select("doc", "n", "f1", "f2")
    profiles = counted.where("chunk IS NULL AND n > 0").select("doc", "n", "f1", "f2", "profile")
    flags = frequent_flags(counted)
    named = marks.where("doc IS NOT NULL AND n > 0")
    # an id that several sets share has no bits, and is never ruled out by them
    one_set = F.min(F.struct("f1", "f2")) == F.max(F.struct("f1", "f2"))
    bits = counted.where("chunk IS NULL AND doc IS NOT NULL AND n > 0").groupBy("doc").agg(
        F.max("n").alias("size"), *[F.when(one_set, F.max(p)).alias(p) for p in PARITY]
    )
    classes = staged(named.groupBy("f1", "f2", "n").agg(F.min("doc").alias("rep")), "classes")
    members = staged(named.join(classes, ["f1", "f2", "n"]).select("doc", "rep").distinct(), "members")
    same = members.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))

    sigs = staged(index(rows.where("doc IS NOT NULL"), flags, words, percent), "signatures")
    buckets = sigs.groupBy("sig").agg(F.min(F.struct("doc", "n")).alias("pivot"), F.count(F.lit(1)).alias("size"))
    buckets = staged(buckets.where("size > 1").select("sig", F.col("pivot.doc").alias("pivot"), F.col("pivot.n").alias("m")), "buckets")
    shared = staged(sigs.join(buckets, "sig").select("sig", "doc", "n", "pivot", "m"), "shared")
    let_go(docs.sparkSession)

    def alike(n: str, m: str):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    stars = shared.where((F.col("doc") != F.col("pivot")) & alike("n", "m")).select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).distinct()
    known = staged(bits, "parities")
    stars = with_bits(with_bits(by_class(stars, members), known, "a"), known, "b")
    stars = staged(stars.where(may_link("a_", "b_", "a_size", "b_size", percent)).select("a", "b"), "stars")
    let_go(docs.sparkSession)
    links = staged(verify(stars, rows, profiles, words, percent), "links")
    let_go(docs.sparkSession)
    first = components(links.union(same))

    # what the stars left open: sets of one bucket in different components
    known_as = members.join(first.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "rep", F.coalesce("component", "rep").alias("c"))
    labelled = shared.select("sig", "doc", "n").join(known_as, "doc")
    labelled = staged(labelled.select("sig", F.col("rep").alias("doc"), "n", "c"), "labelled")
    let_go(docs.sparkSession)
    mixed = labelled.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("sig")
    open_rows = staged(with_bits(labelled.join(mixed, "sig", "left_semi").distinct(), known, "doc"), "open")
    left, right = open_rows.alias("l"), open_rows.alias("r")
    rest = left.join(right, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.c") < F.col("r.c")) & alike("l.n", "r.n") & may_link("l.doc_", "r.doc_", "l.n", "r.n", percent))
    rest = rest.select(F.least("l.doc", "r.doc").alias("a"), F.greatest("l.doc", "r.doc").alias("b")).distinct()
    rest = staged(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    let_go(docs.sparkSession)
    more = staged(verify(rest, rows, profiles, words, percent), "more-links")
    let_go(docs.sparkSession)
    final = components(links.union(same).union(more)) if not more.isEmpty() else first

    answer = marks.join(final.withColumnRenamed("node", "doc"), "doc", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return answer.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_group(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are the smallest of their component, and those without an id; of rows repeating an id one stays."""
    groups = near_duplicates(docs, doc, text, **options)
    kept = fresh(docs, "_kept")
    chosen = groups.where(F.col(doc) == F.col("component_id")).select(F.col(doc).alias(kept)).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.join(chosen, docs[doc] == chosen[kept], "left_semi")
    if not docs.select(doc).where(F.col(doc).isNotNull()).groupBy(doc).count().where("count > 1").isEmpty():
        named = named.dropDuplicates([doc])
    return named.union(docs.where(F.col(doc).isNull())).select(*columns)
