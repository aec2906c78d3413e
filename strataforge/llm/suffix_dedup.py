"""Repeated passages by a depth-limited radix sort of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from strataforge.llm.identity import ordered_key
from strataforge.llm.text import VALUES, batches_of, fresh, let_go, mix, powers, range_hashes, ready, utf8
from strataforge.session import staged

DEPTH = 100  # bytes of a passage that count as repeated
DIGIT = 24  # bytes of the first digit
WIDTHS = (8, 1)  # suffixes of a run in the passes after the first; the last pass has single ones
CHUNK = 1 << 20  # window starts handled at once, below 2**24
LOW = np.uint64((1 << 24) - 1)


def digits(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from every position."""
    n = len(data) - width + 1
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(VALUES[False][data] * up[: len(data)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, by doubling."""
    have = 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return keys if have == width else np.minimum(keys[: len(keys) - (width - have)], keys[width - have :])


def suffix_runs(data: np.ndarray, offsets: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """Suffixes of at least ``depth`` bytes, in runs: text, start, number, distance to the digit, digit and span hash of each.

    The first digit of a suffix is not taken at its start but where, within its
    first ``depth`` bytes, the hash of ``digit`` bytes is least (leftmost of equals):
    equal passages choose the same place.  Neighbouring suffixes mostly share that
    place, so they travel as one run; the span is all that the run's passages cover.
    """
    out = []
    for base in range(0, len(data), CHUNK):
        part = data[base : base + CHUNK + depth - 1]
        if len(part) < depth:
            break
        hashes = digits(part, digit)
        keys = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        place = (least_of(keys, depth - digit + 1) & LOW).astype(np.int64)[: len(part) - depth + 1]
        start = np.arange(base, base + len(place))
        text = np.searchsorted(offsets, start, "right") - 1
        good = start + depth <= offsets[text + 1]
        start, text, place = start[good], text[good], place[good]
        if not len(start):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        number = np.diff(np.append(cut, len(start)))
        first = start[cut]
        spans = range_hashes(data, first, first + number - 1 + depth)
        out.append((text[cut], first - offsets[text[cut]], number, place[cut] + base - first, hashes[place[cut]], spans))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out))


def shape(number: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Number of suffixes of a run, and how far before the digit the first one starts, as one column."""
    return (number << 16 | ahead).astype(np.int32)


def run_batch(head: np.ndarray, span: np.ndarray, doc: pa.Array, start: np.ndarray, form: np.ndarray) -> pa.RecordBatch:
    """Rows of runs; of runs that are equal within the batch, all but the first lose their digit: they are repeats."""
    order = np.lexsort((start, doc.to_numpy(), span, head))
    again = np.zeros(len(head), bool)
    again[order[1:]] = (head[order[1:]] == head[order[:-1]]) & (span[order[1:]] == span[order[:-1]])
    return pa.record_batch(
        {
            "digit": pa.array(head.view(np.int64), mask=again),
            "span": pa.array(np.where(again, start, span.view(np.int64))),
            "doc": doc,
            "start": pa.array(start.astype(np.int32)),
            "shape": pa.array(form),
        }
    )


RUNS = "digit long, span long, doc long, start int, shape int"


def first_pass(rows: DataFrame, depth: int, digit: int) -> DataFrame:
    """Every run of suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in batches_of(batches, "text", 2 << 20):
            text, start, number, ahead, head, span = suffix_runs(data, offsets, depth, digit)
            if len(text):
                yield run_batch(head, span, part.column(0).take(pa.array(text)), start, shape(number, ahead))

    return rows.mapInArrow(run, RUNS)


def narrower(rows: DataFrame, runs: DataFrame, depth: int, width: int) -> DataFrame:
    """The open runs cut into runs of ``width`` suffixes, at the same distances from the digit everywhere.

    The new digit of a run is all that suffixes at its distances have in common
    within their depth, so runs that differ there are told apart without going on.
    """
    lists = runs.groupBy("doc").agg(F.collect_list(F.struct("digit", "start", "shape")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            per_doc = []
            for i, found in enumerate(batch.column(2)):
                found = found.values.flatten()
                head, first, form = (x.to_numpy().astype(np.int64) for x in found)
                number, ahead = form >> 16, form & 0xFFFF
                # distance of each suffix from the digit, then runs of equal distance // width
                run_of = np.repeat(np.arange(len(head)), number)
                step = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                distance = np.repeat(ahead, number) - step
                part = distance // width
                cut = np.flatnonzero(np.concatenate([[True], (run_of[1:] != run_of[:-1]) | (part[1:] != part[:-1])]))
                size = np.diff(np.append(cut, len(step)))
                start = (first[run_of] + step)[cut]
                order = np.argsort(start, kind="stable")
                start, size, cut = start[order], size[order], cut[order]
                body = data[offsets[i] : offsets[i + 1]]
                # ends ascend with the starts only within a width; hash size by size
                span = np.empty(len(start), np.uint64)
                for n in np.unique(size).tolist():
                    at = np.flatnonzero(size == n)
                    span[at] = range_hashes(body, start[at], start[at] + n - 1 + depth)
                # what all suffixes at these distances share is the next digit
                core = start + distance[cut] - part[cut] * width
                order = np.argsort(core, kind="stable")
                shared = np.empty(len(start), np.uint64)
                shared[order] = range_hashes(body, core[order], core[order] + depth - width + 1)
                new_head = mix(shared + part[cut].astype(np.uint64))
                per_doc.append((np.full(len(start), batch.column(0)[i].as_py()), start, shape(size, distance[cut]), new_head, span))
            if per_doc:
                doc, start, form, head, span = (np.concatenate(x) for x in zip(*per_doc))
                yield run_batch(head, span, pa.array(doc), start, form)

    return rows.join(lists, "doc").select("doc", "text", "runs").mapInArrow(run, RUNS)


def settle(runs: DataFrame, label: str, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """One digit's pass: (repeated runs, open runs); the last pass leaves none open.

    Runs are sorted by digit and span, each shuffle being keyed by both, so that a
    digit with many runs is spread out: all but the first of equal spans are repeats.
    The first ones are then sorted by digit alone.  Those whose digit has several
    spans stay open for the next, narrower digit; a lone one is settled.
    """
    spark = runs.sparkSession
    placed = runs.repartition(F.coalesce("digit", "doc"), F.col("span")).sortWithinPartitions("digit", "span", "doc", "start")

    def equal_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            head, span = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            again = np.concatenate([[last == (head[0], span[0])], (head[1:] == head[:-1]) & (span[1:] == span[:-1])])
            if known[-1]:
                last = (head[-1], span[-1])
            first = known & ~again
            first[1:] |= known[1:] & ~known[:-1]  # rows without a digit come first
            yield pa.record_batch({"digit": pa.array(head, mask=~first), "doc": batch.column(2), "start": batch.column(3), "shape": batch.column(4)})

    found = staged(placed.mapInArrow(equal_spans, "digit long, doc long, start int, shape int"), f"{label}-runs")
    let_go(spark)
    repeats = found.where("digit IS NULL").select("doc", "start", F.shiftright("shape", 16).alias("number"))
    if last:
        return repeats, found.limit(0)
    firsts = found.where("digit IS NOT NULL").repartition(F.col("digit")).sortWithinPartitions("digit")

    def several_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None  # the last row, if its digit has been seen once so far
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            head = batch.column(0).to_numpy()
            follows = np.concatenate([[last == head[0]], head[1:] == head[:-1]])
            if waiting is not None and follows[0]:
                yield waiting
            last = head[-1]
            several = follows.copy()
            several[:-1] |= follows[1:]
            if several.any():
                yield batch.filter(pa.array(several))
            waiting = None if several[-1] else batch.slice(batch.num_rows - 1, 1)

    opened = staged(firsts.mapInArrow(several_spans, "digit long, doc long, start int, shape int"), f"{label}-open")
    let_go(spark)
    return repeats, opened


def merged_spans(suffixes: DataFrame, depth: int) -> DataFrame:
    """(doc, spans): the byte ranges that repeated suffixes cover, joined where they meet."""
    placed = suffixes.repartition(F.col("doc")).sortWithinPartitions("doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_now, start_now, end_now = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(0).to_numpy()
            start = batch.column(1).to_numpy().astype(np.int64)
            end = start + batch.column(2).to_numpy() - 1 + depth
            # one line of positions: texts far apart, so that a running maximum keeps them apart
            group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64) << 40
            reach = np.maximum.accumulate(end + group)
            fresh_span = np.concatenate([[True], (start + group)[1:] > reach[:-1]])
            cut = np.flatnonzero(fresh_span)
            docs, starts = doc[cut], start[cut]
            ends = np.append(reach[cut[1:] - 1], reach[-1]) - group[cut]
            if doc_now is not None and docs[0] == doc_now and starts[0] <= end_now:
                starts[0], ends[0] = start_now, max(ends[0], end_now)
            elif doc_now is not None:
                docs, starts, ends = np.append(doc_now, docs), np.append(start_now, starts), np.append(end_now, ends)
            # the running span may also swallow later ones of this batch
            if len(docs) > 1:
                inside = (docs == docs[0]) & (starts <= ends[0])
                inside[0] = True
                ends[0] = ends[inside].max()
                inside[0] = False
                docs, starts, ends = docs[~inside], starts[~inside], ends[~inside]
            doc_now, start_now, end_now = docs[-1], starts[-1], ends[-1]
            if len(docs) > 1:
                yield pa.record_batch({"doc": docs[:-1], "a": starts[:-1], "b": ends[:-1]})
        if doc_now is not None:
            yield pa.record_batch({"doc": [int(doc_now)], "a": [int(start_now)], "b": [int(end_now)]})

    spans = placed.mapInArrow(run, "doc long, a long, b long")
    return spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every document.

    A byte goes if it lies in a ``depth``-byte string of UTF-8 bytes that also starts
    earlier: in a document of smaller id, or earlier in the same one.  All strings
    are judged on the input.  ``kept`` is what is left, as bytes.

    Suffixes are ordered by most significant digits, each pass being one shuffle
    that sorts what the last one left open, and only to ``depth``: by a chosen digit
    and the span of a run of suffixes, by narrower runs, and by single suffixes.
    Equal ones after the last pass are the repeated strings.  Hashes of 64 bits stand for digits, spans and
    strings; strings are only compared when their digits agree too.  Sorted rows are
    read as a stream, so one very common passage fills no memory.

    NULL and empty texts have no bytes.  Repeated ids are ordered by text, NULL ids
    come first; of rows equal in both any one counts as the first.  An empty table
    gives an empty result.  Other columns are not read.
    """
    if not 0 < depth < 1 << 15:
        raise ValueError("depth must lie between 1 and 32,767")
    spark = ready(docs.sparkSession)
    key = fresh(docs, "_key")
    keyed = ordered_key(docs, doc, text, key)
    rows = keyed.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    repeats, opened = settle(first_pass(rows, depth, digit), "suffix")
    for width in WIDTHS:
        more, opened = settle(narrower(rows, opened, depth, width), f"suffix-{width}", last=width == WIDTHS[-1])
        repeats = repeats.union(more)
    spans = staged(merged_spans(repeats, depth), "spans")
    let_go(spark)

    @arrow_udf("binary")
    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in parts:
            data, offsets = utf8(texts)
            raw = data.tobytes()
            out = []
            for i, found in enumerate(lists.to_pylist()):
                body = raw[offsets[i] : offsets[i + 1]]
                at, kept = 0, []
                for s in found or ():
                    kept.append(body[at : s["a"]])
                    at = s["b"]
                out.append(b"".join([*kept, body[at:]]))
            yield pa.array(out, pa.binary())

    named = keyed.select(F.col(key).alias("doc"), F.col(doc).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    joined = named.join(spans, "doc", "left")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return joined.select(
        F.col("_id").alias(doc),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.greatest(F.coalesce(F.size("spans"), F.lit(0)), F.lit(0)).cast("long").alias("n_spans"),
        cut("text", "spans").alias("kept"),
    )
