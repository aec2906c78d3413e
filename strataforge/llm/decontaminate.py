"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from strataforge.llm.text import fresh, ready, slices, utf8, with_result
from strataforge.session import staged

WINDOW = 13  # words of one benchmark passage that count as copied
BLOCK_BYTES = 4 << 20  # benchmark text searched for in one pass over the documents
SCAN_BYTES = 2 << 20
LANE = 1024  # bytes scanned by one cursor
TABLE_BITS = 20
RESULT = "struct<n_words:long,n_hit:long,hits:array<struct<start:long,end:long>>,items:array<string>>"

#: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: all else becomes a space
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def canonical(text: bytes) -> tuple[bytes, int]:
    """Words with one space before, between and behind, and their number."""
    words = text.translate(FOLD).split(b" ")
    words = [w for w in words if w]
    return (b" " + b" ".join(words) + b" ", len(words)) if words else (b"", 0)


@dataclass
class Patterns:
    """Patterns of similar length with the tables Wu-Manber needs.

    ``shift`` tells by the hash of a block of ``block`` bytes how far the search
    may move; zero means that the block ends some pattern's first ``least``
    bytes.  ``keys`` and ``first`` are the buckets of such blocks.  A pattern is a
    range ``starts`` to ``ends`` of ``text``, the items of all windows one after the other; ``owners``
    from ``cuts`` on are the numbers of the items that have it.
    """

    least: int
    block: int
    shift: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    owners: np.ndarray
    cuts: np.ndarray

    def size(self) -> int:
        """Bytes of all tables."""
        arrays = (self.shift, self.keys, self.first, self.starts, self.ends, self.words, self.owners, self.cuts)
        return len(self.text) + sum(a.nbytes for a in arrays)


def block_values(data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """The ``block`` bytes from each position as one number; eight zero bytes must follow the data."""
    view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    value = view[at]
    return value if block == 8 else value & np.uint64((1 << (8 * block)) - 1)


def slot(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def compile_patterns(windows: Windows) -> list[Patterns]:
    """Tables per class of lengths, as one short pattern would shrink every shift."""
    out = []
    lengths = windows.ends - windows.starts
    kinds = np.minimum(6, np.frexp(lengths)[1])  # bits of the length
    data = np.frombuffer(windows.text + bytes(8), np.uint8)
    for kind in np.unique(kinds).tolist():
        chosen = np.flatnonzero(kinds == kind)
        starts, ends = windows.starts[chosen], windows.ends[chosen]
        least = int(lengths[chosen].min())
        block = min(8, least)
        shift = np.full(1 << TABLE_BITS, least - block + 1, np.int32)
        for i in range(least - block + 1):  # the last writer is the nearest to the end
            np.minimum.at(shift, slot(block_values(data, starts + i, block)), np.int32(least - block - i))
        tails = block_values(data, starts + least - block, block)
        # equal windows are one pattern with several owners
        names = np.fromiter((hash(windows.text[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
        order = np.lexsort((names, tails))
        starts, ends, tails, names, owners = starts[order], ends[order], tails[order], names[order], windows.items[chosen][order]
        text = windows.text
        new = [True] + [
            not (n and t and text[starts[i + 1] : ends[i + 1]] == text[starts[i] : ends[i]])
            for i, (n, t) in enumerate(zip((names[1:] == names[:-1]).tolist(), (tails[1:] == tails[:-1]).tolist()))
        ]
        heads = np.flatnonzero(new)
        keys, first = np.unique(tails[heads], return_index=True)
        out.append(
            Patterns(
                least, block, shift, keys, np.append(first, len(heads)).astype(np.int32),
                text, starts[heads], ends[heads], windows.words[chosen][order][heads], owners, np.append(heads, len(owners)).astype(np.int32),
            )
        )
    return out


def search(data: np.ndarray, size: int, patterns: Patterns) -> Iterator[tuple[int, int]]:
    """(position, pattern) of every occurrence in the first ``size`` bytes.

    The text is cut into lanes whose cursors move together: each step looks up
    the shift of every cursor's block; cursors with shift zero test the patterns
    of their bucket and move by one.
    """
    least, block = patterns.least, patterns.block
    if size < least:
        return
    reach = least - block  # from a window's start to its last block
    at = np.arange(0, size - least + 1, LANE, dtype=np.int64)
    stop = np.minimum(at + LANE, size - least + 1)
    raw = data[:size].tobytes()
    while len(at):
        values = block_values(data, at + reach, block)
        move = patterns.shift[slot(values)].astype(np.int64)
        hit = np.flatnonzero(move == 0)
        if len(hit):
            found = values[hit]
            bucket = np.minimum(np.searchsorted(patterns.keys, found), len(patterns.keys) - 1)
            same = patterns.keys[bucket] == found
            for where, b in zip(at[hit[same]].tolist(), bucket[same].tolist()):
                for p in range(patterns.first[b], patterns.first[b + 1]):
                    if raw.startswith(patterns.text[patterns.starts[p] : patterns.ends[p]], where):
                        yield where, p
            move[hit] = 1
        at = at + move
        going = at < stop
        at, stop = at[going], stop[going]


def scan(texts: pa.Array, tables: list[Patterns], names: list[str | None]) -> list[tuple]:
    """(n_words, n_hit, hits, items) of each text."""
    data, offsets = utf8(texts)
    raw = data.tobytes()
    out = []
    for a, b in slices(np.diff(offsets), SCAN_BYTES):
        folded = [canonical(raw[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
        ends = np.cumsum([len(f) + 1 for f, _ in folded])  # a zero byte parts the texts
        joined = np.frombuffer(b"\0".join([*(f for f, _ in folded), bytes(8)]), np.uint8)
        hits: dict[int, list[tuple[int, int, list[int]]]] = {}
        for table in tables:
            for where, p in search(joined, int(ends[-1]), table):
                doc = int(np.searchsorted(ends, where, "right"))
                owners = table.owners[table.cuts[p] : table.cuts[p + 1]].tolist()
                hits.setdefault(doc, []).append((where, int(table.words[p]), owners))
        for i, (form, n_words) in enumerate(folded):
            if i not in hits:
                out.append((n_words, 0, [], []))
                continue
            start = int(ends[i]) - len(form) - 1
            spaces = np.flatnonzero(np.frombuffer(form, np.uint8) == 32)
            spans, items = [], set()
            for where, words, numbers in hits[i]:
                word = int(np.searchsorted(spaces, where - start))
                spans.append((word, word + words))
                items.update(names[x] for x in numbers)
            merged = merge(spans)
            out.append((n_words, sum(e - s for s, e in merged), merged, sorted(x for x in items if x is not None)))
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@dataclass
class Windows:
    """Windows of items as ranges of their text in canonical form, with the number of their words and of their item."""

    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    items: np.ndarray


def passages(items: list[tuple[str | None, str | None]], window: int) -> Windows:
    """Every window of the items; an item of fewer words, but not none, is one window."""
    forms, at, parts = [], 0, []
    for number, (_, text) in enumerate(items):
        form, n = canonical((text or "").encode())
        if not n:
            continue
        spaces = np.flatnonzero(np.frombuffer(form, np.uint8) == 32)
        k = min(window, n)
        parts.append((at + spaces[: n - k + 1], at + spaces[k:] + 1, np.full(n - k + 1, k), np.full(n - k + 1, number)))
        forms.append(form)
        at += len(form)
    if not parts:
        return Windows(b"", *[np.zeros(0, np.int32)] * 4)
    return Windows(b"".join(forms), *[np.concatenate(x).astype(np.int32) for x in zip(*parts)])


def searcher(tables):
    """The search for one broadcast block of the benchmark."""

    @arrow_udf(RESULT)
    def overlap(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(span)), ("items", pa.list_(pa.string()))])
        patterns, ids = tables.value
        for texts in batches:
            found = scan(texts, patterns, ids)
            yield pa.array([{"n_words": n, "n_hit": h, "hits": [{"start": s, "end": e} for s, e in spans], "items": items} for n, h, spans, items in found], kind)

    return overlap


def block_tables(items: DataFrame, window: int):
    """(broadcast of the tables of some items and their ids, bytes of the tables)."""
    rows = sorted({(r.i, r.t) for r in items.collect()}, key=lambda r: (r[0] or "", r[1] or ""))
    tables = compile_patterns(passages(rows, window))
    return items.sparkSession.sparkContext.broadcast((tables, [r[0] for r in rows])), sum(t.size() for t in tables)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    into: str = "overlap", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add a struct of what each document shares with the benchmark.

    Fields: ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``hits`` (their word ranges, merged) and ``items`` (ids with occurring
    windows, as strings, sorted).

    The benchmark is taken in blocks of about ``block_bytes`` of text (an item is
    never divided).  With one block the documents are read once, without a shuffle.  With
    more, numbered documents are written to the shared folder and searched for one block after the
    other: the driver and every task hold the tables of one block at a time, however large the benchmark is, and each
    pass writes only the documents it has hits in.  The hits of all passes are then joined by row number.

    NULL or empty document: no words, no hits.  NULL or wordless item: no
    windows; a NULL item id takes part in ``hits`` but cannot be listed.  Repeated
    rows each get their own result, repeated items count by their id.  Other
    columns pass through; one named like ``into`` is replaced.
    """
    spark = ready(docs.sparkSession)
    chosen = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = chosen.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    found = F.col(text).cast("string")
    if blocks == 1:
        tables, _ = block_tables(chosen, window)
        return with_result(docs, into, searcher(tables)(found))
    row = fresh(docs, "_row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    passes = []
    for number in range(blocks):
        tables, size = block_tables(chosen.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number), window)
        hits = numbered.select(F.col(f"`{row}`").alias("row"), searcher(tables)(found).alias("o")).select("row", "o.*")
        # the first pass tells the words of every document, later ones have hits only
        passes.append(staged(hits if number == 0 else hits.where("n_hit > 0"), "hits"))
        tables.destroy()
    joined = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("hits"))),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    per_row = reduce(DataFrame.unionByName, passes).groupBy("row").agg(
        F.max("n_words").alias("n_words"), joined.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    result = fresh(docs, "_merged")
    merged = per_row.select(F.col("row").alias(row), F.struct("n_words", covered.alias("n_hit"), "hits", "items").alias(result))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()]
    return numbered.join(merged, row).select(*kept, F.col(result).alias(into))


def contaminated(overlap: str = "overlap", share: int = 20):
    """At least one hit word in ``share`` words."""
    hit, words = F.col(f"{overlap}.n_hit"), F.col(f"{overlap}.n_words")
    return (hit > 0) & (share * hit >= words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = fresh(docs, "_overlap")
    found = find_passages(docs, benchmark, into=name, **options)
    return found.where(~contaminated(name)).select(*[F.col(f"`{c}`") for c in docs.columns])
