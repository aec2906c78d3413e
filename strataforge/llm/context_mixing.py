"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is lower-cased (A-Z) and cut after each white-space byte and at its end into
units: a word, possibly empty, and its closing byte (``END`` at the end of the text).
Each byte of a unit is coded as eight bits.  Several predictors, each with counts of
the bytes that followed one hashed context within the unit, give a probability of
each bit; weights chosen by gates mix them in the logistic domain, and an adaptive map
refines the result.  Contexts never leave a unit, so a unit has one probability in the
whole corpus, which is computed once and multiplied by its occurrences.

All that is gathered from the corpus are words with counts and contexts with counts.
Both grow with the training texts and stay distributed.  Texts are handled in
blocks, which send their distinct units to parts of the alphabet.  A part adds up its
words; the longest contexts are whole words so far, which a part knows by itself but
for those that lead to its borders, and only short and border contexts are counted over
all parts.  A part then prices its units and answers the blocks, so no task holds more
than a block or a part.  Units travel packed, many in a row.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from strataforge.functions.windows import rank_in_order
from strataforge.llm.text import FOLD, SPACE, STEP, mix, range_hashes, ready, utf8, with_result
from strataforge.session import staged

BLOCK_BYTES = 16 << 20  # text whose distinct units are looked up together
PART_WORDS = 48 << 10  # words priced together, about
SAMPLES = 48  # sampled words of a part, which place its borders
STEP_WORDS = 512  # words between two updates of the weights
MERGE_ROWS = 1 << 20  # units a part collects before it adds up equal ones
END = 0xFF  # closes a text; no UTF-8 text holds this byte
CLOSERS = np.array([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, END], np.uint8)
CLOSED = SPACE.copy()
CLOSED[END] = True
CODE = np.zeros(256, np.int64)
CODE[CLOSERS] = np.arange(len(CLOSERS))

ORDERS = (1, 2, 3, 24)  # bytes before, within the unit; the last is nearly always the whole word so far
KINDS = len(ORDERS) + 1  # and one predictor by place in the word and class of the byte before
PRIOR = 0.1  # added to both counts of a bit
CLASS = np.full(257, 1)
CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 2
CLASS[[*b"0123456789"]] = 3
CLASS[0x80:0x100] = 4
CLASS[256] = 0  # nothing before
GATES = (8 * (KINDS + 1), 16, 16)  # bit and longest known context; rows seen in the longest; place in the word
RATE, FIRST_WEIGHT = 0.01, 0.25
KNOTS, REACH, TRUST = 33, 8.0, 20.0  # of the refining map: its knots over the logits, and how many bits move it
LEAST = 1e-6  # least probability of a bit
FIXED = float(1 << 20)  # sums over parts are taken in whole numbers, so their order does not matter

UNITS = pa.schema([("word", pa.large_binary()), ("code", pa.int8()), ("n", pa.int64())])
FOLLOWERS = pa.schema([("key", pa.uint64()), ("n", pa.int64())])




def pack(batch: pa.RecordBatch) -> bytes:
    return pa.compress(batch.serialize(), codec="zstd", asbytes=True) + len(batch.serialize()).to_bytes(8, "little")


def unpack(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), codec="zstd"), schema)


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 0 or more in seven bits a byte, and the bytes each takes."""
    sizes = 1 + sum((values >> (7 * i) > 0).astype(np.int64) for i in range(1, 9))
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for i in range(int(sizes.max(initial=0))):
        some = sizes > i
        out[at[some] + i] = (values[some] >> (7 * i) & 127) | (sizes[some] > i + 1) * 128
    return out, sizes


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    within = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * within), starts)


def binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Byte ranges that follow each other as an Arrow array."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def partial(schema: pa.Schema, size: int, **given) -> pa.RecordBatch:
    """Rows in which only the given columns are set."""
    return pa.record_batch([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema)


# ------------------------------------------------------------------- blocks


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words and closing codes of all units, and the first unit of each text."""
    marked = np.insert(FOLD[data], offsets[1:], END)
    shut = CLOSED[marked]
    at = np.flatnonzero(shut)
    cuts = np.cumsum(np.diff(at, prepend=-1) - 1)
    buffers = [None, pa.py_buffer(np.concatenate([[0], cuts]).astype(np.int64)), pa.py_buffer(marked[~shut])]
    first = np.searchsorted(at, offsets + np.arange(len(offsets)))
    return pa.Array.from_buffers(pa.large_binary(), len(at), buffers), CODE[marked[at]], first


def block_rows(block: int, rows: pa.Array, train: np.ndarray, texts: pa.Array, rate: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row with the distinct units of a block, sorted, and one for each text with the numbers of its units."""
    data, offsets = utf8(texts)
    words, codes, first = units(data, offsets)
    filled = np.diff(np.frombuffer(words.buffers()[1], np.int64)) > 0
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number = rank[coded.indices.to_numpy(zero_copy_only=False)] << 3 | codes
    distinct, unit = np.unique(number, return_inverse=True)
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    sorted_words = coded.dictionary.take(pa.array(order))
    counts = np.bincount(unit[train[owner]], minlength=len(distinct))
    packed = pack(pa.record_batch([sorted_words.take(pa.array(distinct >> 3)), pa.array(distinct & 7, pa.int8()), pa.array(counts)], schema=UNITS))
    body, cuts = utf8(sorted_words)
    sample = sorted_words.filter(pa.array(range_hashes(body, cuts[:-1], cuts[1:]) % np.uint64(rate) == 0)).cast(pa.binary())
    yield partial(schema, 1, block=[block], units=[packed], sample=pa.ListArray.from_arrays(pa.array([0, len(sample)], pa.int32()), sample))
    pairs, times = np.unique(owner << 32 | unit, return_counts=True)
    places = pairs & 0xFFFFFFFF
    heads = np.searchsorted(pairs >> 32, np.arange(n + 1))
    steps = np.diff(places, prepend=0)
    steps[heads[:-1]] = places[heads[:-1]]  # every text has at least its end
    lists, sizes = pack_numbers(steps << 2 | np.minimum(times - 1, 3))
    often = times > 3
    more, more_sizes = pack_numbers(times[often])
    at, more_at = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, more_sizes))
    at, more_at = at[heads], more_at[np.concatenate([[0], np.cumsum(often)])[heads]]
    tokens, n_bytes = np.bincount(owner[filled], minlength=n) + 1, np.diff(offsets)
    for a in range(0, n, 1000):
        b = min(n, a + 1000)
        yield partial(
            schema, b - a, block=np.full(b - a, block), row=rows.slice(a, b - a), n_tokens=tokens[a:b], n_bytes=n_bytes[a:b],
            lists=binaries(lists[at[a] : at[b]], at[a : b + 1] - at[a]), more=binaries(more[more_at[a] : more_at[b]], more_at[a : b + 1] - more_at[a]),
        )


def split_blocks(docs: DataFrame, train: Column, text: str, block_bytes: int, rate: int) -> DataFrame:
    """The units of each block (``units`` is set) and its texts (``row`` is set), written once."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    given = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("string").alias("text"))
    own = StructType([StructField("row", given.schema["row"].dataType)])
    for name, kind in {"block": "long", "lists": "binary", "more": "binary", "n_tokens": "long", "n_bytes": "long", "units": "binary", "sample": ArrayType(BinaryType())}.items():
        own = own.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size, schema = TaskContext.get().partitionId() << 32, [], 0, None
        plain = [("block", pa.int64()), ("lists", pa.binary()), ("more", pa.binary()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()),
                 ("units", pa.binary()), ("sample", pa.list_(pa.binary()))]

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            rows, flags, texts = (table.column(i).combine_chunks() for i in range(3))
            yield from block_rows(block, rows, flags.to_numpy(zero_copy_only=False).astype(bool), texts, rate, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([("row", batch.schema.field(0).type), *plain])
            held.append(batch)
            size += batch.column(2).nbytes
            if size >= block_bytes:
                yield from done()
                block, held, size = block + 1, [], 0
        if held:
            yield from done()

    return staged(given.mapInArrow(run, own), "lm-blocks")


def borders(blocks: DataFrame) -> list[bytes]:
    """The words at which parts begin: each SAMPLES-th of the sampled distinct words, a few for a million words."""
    words = blocks.where("units IS NOT NULL").select(F.explode("sample").alias("word")).distinct()
    placed = rank_in_order(words, [], [F.col("word")], "place").where(F.col("place") % SAMPLES == 0)
    return sorted(bytes(r.word) for r in placed.select("word").collect())


def requests(blocks: DataFrame, at: list[bytes]) -> DataFrame:
    """(part, block, first, units): the units of each block by part; ``first`` is the number of the first."""
    shared = blocks.sparkSession.sparkContext.broadcast(at)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = unpack(data, UNITS)
                words = found.column(0).to_pylist()
                cuts = [0, *(bisect_left(words, b) for b in shared.value), len(words)]
                some = [p for p in range(len(cuts) - 1) if cuts[p + 1] > cuts[p]]
                yield pa.record_batch({
                    "part": pa.array(some, pa.int64()), "block": pa.array([block] * len(some), pa.int64()), "first": pa.array([cuts[p] for p in some], pa.int64()),
                    "units": pa.array([pack(found.slice(cuts[p], cuts[p + 1] - cuts[p])) for p in some], pa.binary()),
                })

    return blocks.where("units IS NOT NULL").select("block", "units").mapInArrow(cut, "part long, block long, first long, units binary")


# ------------------------------------------------------------------ contexts


@dataclass
class Events:
    """Every coded byte of some words: the word, the symbol, its weight in training, its place, and its contexts by predictor."""

    word: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray
    place: np.ndarray
    closing: np.ndarray
    contexts: list[np.ndarray]  # 56-bit hashes with eight zero bits below


def events(words: pa.Array, times: np.ndarray, seen: np.ndarray) -> Events:
    """Words' bytes carry the word's count; a closing byte, one for each that the corpus has, its own count."""
    data, cuts = utf8(words)
    n, length = len(words), np.diff(cuts)
    total = times.sum(axis=1)
    closers = (seen[:, None] >> np.arange(len(CLOSERS))) & 1
    which, code = np.nonzero(closers)
    word = np.concatenate([np.repeat(np.arange(n), length), which])
    place = np.concatenate([np.arange(len(data)) - np.repeat(cuts[:-1], length), length[which]])
    symbol = np.concatenate([data, CLOSERS[code]]).astype(np.int64)
    weight = np.concatenate([np.repeat(total, length), times[which, code]])
    closing = np.concatenate([np.full(len(data), -1), code])
    order = np.argsort(word, kind="stable")  # closing bytes after the bytes of their word
    word, place, symbol, weight, closing = word[order], place[order], symbol[order], weight[order], closing[order]
    start = cuts[word]
    at = start + place
    contexts = []
    for kind, width in enumerate(ORDERS):
        low = np.maximum(start, at - width)
        h = mix(range_hashes(data, low, at) + np.uint64((2 * kind + 1) * int(STEP) % (1 << 64)) + (low == start).astype(np.uint64))
        contexts.append(h >> np.uint64(8) << np.uint64(8))
    padded = np.append(data, 0).astype(np.int64)
    before = np.where(place > 0, padded[at - 1], 256)
    h = mix(mix(np.minimum(place, 20).astype(np.uint64) * np.uint64(8) + CLASS[before].astype(np.uint64)) + np.uint64((2 * KINDS + 1) * int(STEP) % (1 << 64)))
    contexts.append(h >> np.uint64(8) << np.uint64(8))
    return Events(word, symbol, weight, place, closing, contexts)


class Words:
    """The distinct words of some sorted units, with training counts and closing bytes."""

    def __init__(self, found: pa.RecordBatch | pa.Table):
        column = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (found.column(i) for i in range(3))]
        code, n = column[1].to_numpy(zero_copy_only=False).astype(np.int64), column[2].to_numpy(zero_copy_only=False)
        other = pc.not_equal(column[0].slice(1), column[0].slice(0, max(0, len(code) - 1))).to_numpy(zero_copy_only=False).astype(bool)
        head = np.concatenate([[True], other])[: len(code)]
        self.of = np.cumsum(head) - 1  # word of each unit
        self.code = code
        self.words = column[0].filter(pa.array(head))
        self.times = np.zeros((len(self.words), len(CLOSERS)), np.int64)
        self.times[self.of, code] = n
        self.seen = np.bincount(self.of, 1 << code, len(self.words)).astype(np.int64)
        self.total = self.times.sum(axis=1)
        self.filled = np.diff(utf8(self.words)[1]) > 0

    def events(self) -> Events:
        return events(self.words, self.times, self.seen)


def added_up(tables: list[pa.RecordBatch | pa.Table]) -> pa.Table:
    """Units with the sums of their counts, sorted by word and closing byte."""
    together = pa.concat_tables([pa.Table.from_batches([t]) if isinstance(t, pa.RecordBatch) else t for t in tables])
    summed = together.group_by(["word", "code"]).aggregate([("n", "sum")]).rename_columns(["word", "code", "n"])
    return summed.sort_by([("word", "ascending"), ("code", "ascending")]).cast(UNITS)


def pair_sums(ctx: np.ndarray, symbol: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol in one sorted key, and how often they came in training; pairs that did not are left out."""
    key = ctx | symbol.astype(np.uint64)
    some = weight > 0
    distinct, back = np.unique(key[some], return_inverse=True)
    return distinct, np.bincount(back, weight[some], len(distinct)).astype(np.int64)


def alone(found: Events, edges: list[bytes]) -> np.ndarray:
    """Events whose longest context no other part has: whole words so far that lead to neither border."""
    words = pa.array(edges, pa.large_binary())
    led = events(words, np.zeros((len(edges), len(CLOSERS)), np.int64), np.ones(len(edges), np.int64))
    return (found.place <= ORDERS[-1]) & ~np.isin(found.contexts[-2], led.contexts[-2])


def edges_of(part: int, at: list[bytes]) -> list[bytes]:
    return at[max(0, part - 1) : part + 1]


def grouped(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The batches of each value of a column by which the rows are sorted; a group is read as it comes."""
    pieces = _pieces(batches, name)
    held = next(pieces, None)
    while held is not None:
        value, nothing = held[0], []

        def group(held=held, nothing=nothing):
            while held is not None and held[0] == value:
                yield held[1]
                held = next(pieces, None)
            nothing.append(held)

        of_value = group()
        yield value, of_value
        for _ in of_value:
            pass
        held = nothing[0]


def _pieces(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield int(values[a]), batch.slice(a, b - a)


def vocabulary(asked: DataFrame, at: list[bytes]) -> DataFrame:
    """The units of each part with their sums, the contexts it shares with others (``ctx``) and what followed them.

    Rows with a ``symbol`` count, those without ask.  Written once.
    """
    shared = asked.sparkSession.sparkContext.broadcast(at)
    schema = pa.schema([("part", pa.int64()), ("units", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("ends", pa.int64()),
                        ("ctx", pa.int64()), ("symbol", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in grouped(batches, "part"):
            held, size = [], 0
            for batch in group:
                for data in batch.column(batch.schema.get_field_index("units")).to_pylist():
                    held.append(unpack(data, UNITS))
                    size += held[-1].num_rows
                    if size > MERGE_ROWS:
                        held = [added_up(held)]
                        size = max(0, held[0].num_rows - MERGE_ROWS // 2)
            table = added_up(held).combine_chunks()
            words = Words(table)
            yield partial(
                schema, 1, part=[part], units=[pack(table.to_batches()[0])], words=[len(words.words)], tokens=[int(words.total[words.filled].sum())],
                distinct=[int((words.filled & (words.total > 0)).sum())], ends=[int(words.times[:, -1].sum())],
            )
            found = words.events()
            public = ~alone(found, edges_of(part, shared.value))
            ctx = [c[public] if k == len(ORDERS) - 1 else c for k, c in enumerate(found.contexts)]
            want = np.unique(np.concatenate(ctx)).view(np.int64)
            symbol = np.concatenate([found.symbol[public] if k == len(ORDERS) - 1 else found.symbol for k in range(KINDS)])
            weight = np.concatenate([found.weight[public] if k == len(ORDERS) - 1 else found.weight for k in range(KINDS)])
            key, n = pair_sums(np.concatenate(ctx), symbol, weight)
            yield partial(schema, len(want), part=np.full(len(want), part), ctx=want)
            yield partial(schema, len(key), ctx=(key >> np.uint64(8) << np.uint64(8)).view(np.int64), symbol=(key & np.uint64(255)).astype(np.int32), n=n)

    sorted_ = asked.select("part", "units").repartition("part").sortWithinPartitions("part")
    kinds = "part long, units binary, words long, tokens long, distinct long, ends long, ctx long, symbol int, n long"
    return staged(sorted_.mapInArrow(run, kinds), "lm-words")


def whole_parts(found: DataFrame) -> DataFrame:
    """(part, units, followers): one row for each part, with all that is known of its shared contexts.  Written once."""
    counted = found.where("symbol IS NOT NULL").groupBy("ctx", "symbol").agg(F.sum("n").alias("n"))
    packed = F.struct(F.col("symbol").cast("short").alias("symbol"), "n")
    table = counted.groupBy("ctx").agg(F.collect_list(packed).alias("followers"))
    answers = found.where("ctx IS NOT NULL AND symbol IS NULL").select("part", "ctx").join(table, "ctx")
    rows = found.where("units IS NOT NULL").select("part", "units").unionByName(answers, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in grouped(batches, "part"):
            units, keys, counts = None, [], []
            for batch in group:
                column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                units = next((u for u in column["units"].to_pylist() if u is not None), units)
                some = pc.is_valid(column["ctx"])
                lists, ctx = column["followers"].filter(some), column["ctx"].filter(some).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
                if len(flat):
                    symbol = flat.field("symbol").to_numpy(zero_copy_only=False).astype(np.uint64)
                    keys.append(np.repeat(ctx.view(np.uint64), sizes) | symbol)
                    counts.append(flat.field("n").to_numpy(zero_copy_only=False))
            key, n = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((keys, np.uint64), (counts, np.int64)))
            order = np.argsort(key)
            followers = pack(pa.record_batch([pa.array(key[order]), pa.array(n[order], pa.int64())], schema=FOLLOWERS))
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "units": pa.array([units], pa.binary()), "followers": pa.array([followers], pa.binary())})

    sorted_ = rows.repartition("part").sortWithinPartitions("part")
    return staged(sorted_.mapInArrow(run, "part long, units binary, followers binary"), "lm-parts")


# ---------------------------------------------------------------- predictors


class Counts:
    """How often each byte followed each context of a part."""

    def __init__(self, found: Events, local: np.ndarray, followers: pa.RecordBatch):
        key, n = pair_sums(found.contexts[-2][local], found.symbol[local], found.weight[local])
        key = np.concatenate([key, followers.column(0).to_numpy()])
        order = np.argsort(key)
        self.key = key[order]
        self.sums = np.concatenate([[0], np.cumsum(np.concatenate([n, followers.column(1).to_numpy()])[order])])

    def bits(self, ctx: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the eight bits of a symbol, highest first, the counts of 0 and 1 after the bits before it."""
        zero, one = np.zeros((len(ctx), 8), np.int64), np.zeros((len(ctx), 8), np.int64)
        low = np.searchsorted(self.key, ctx)
        high = np.searchsorted(self.key, ctx | np.uint64(255), "right")
        for i in range(8):
            shift = 7 - i
            middle = np.searchsorted(self.key, ctx | ((symbol >> shift | 1) << shift).astype(np.uint64))
            zero[:, i], one[:, i] = self.sums[middle] - self.sums[low], self.sums[high] - self.sums[middle]
            set_ = (symbol >> shift & 1).astype(bool)
            low, high = np.where(set_, middle, low), np.where(set_, high, middle)
        return zero, one


@dataclass
class Bits:
    """All bits of some events: inputs of the mixer, gates, and the bits themselves."""

    inputs: np.ndarray  # (bits, KINDS)
    gates: list[np.ndarray]
    y: np.ndarray
    weight: np.ndarray


class Predictors:
    """The bit predictors of all events of a part; equal pairs of context and symbol are looked up once."""

    def __init__(self, found: Events, counts: Counts):
        self.found, self.pairs = found, []
        for ctx in found.contexts:
            pair, back = np.unique(ctx | found.symbol.astype(np.uint64), return_inverse=True)
            symbol = (pair & np.uint64(255)).astype(np.int64)
            zero, one = counts.bits(pair >> np.uint64(8) << np.uint64(8), symbol)
            self.pairs.append((back, zero, one))

    def bits(self, some: np.ndarray, left_out: bool) -> Bits:
        """Bits of the chosen events; with ``left_out`` the counts lack the event's own occurrence, as for an unseen text."""
        found = self.found
        n = len(some)
        y = (found.symbol[some][:, None] >> np.arange(7, -1, -1)) & 1
        own = ((found.weight[some] > 0) & left_out).astype(np.int64)[:, None]
        inputs = np.empty((n, 8, KINDS))
        known = np.zeros((n, 8), np.int64)
        for k, (back, zero, one) in enumerate(self.pairs):
            n0, n1 = zero[back[some]] - own * (1 - y), one[back[some]] - own * y
            inputs[:, :, k] = np.log((n1 + PRIOR) / (n0 + PRIOR))
            seen = n0 + n1
            if k < len(ORDERS):
                known = np.where(seen > 0, k + 1, known)
            if k == len(ORDERS) - 1:
                longest = np.minimum(15, np.ceil(np.log2(seen + 1)).astype(np.int64))
        place = np.repeat(np.minimum(15, found.place[some])[:, None], 8, axis=1)
        gates = [(known * 8 + np.arange(8)).ravel(), longest.ravel(), place.ravel()]
        return Bits(inputs.reshape(-1, KINDS), gates, y.ravel().astype(bool), np.repeat(np.sqrt(found.weight[some]), 8))


@dataclass
class Mixer:
    """Weights per gate, and the map that refines the mixed probability."""

    weights: list[np.ndarray]
    hits: np.ndarray  # weight of ones per (first gate, knot)
    total: np.ndarray

    @classmethod
    def new(cls) -> Mixer:
        weights = [np.full((g, KINDS), FIRST_WEIGHT if i == 0 else 0.0) for i, g in enumerate(GATES)]
        return cls(weights, np.zeros((GATES[0], KNOTS)), np.zeros((GATES[0], KNOTS)))

    def logits(self, bits: Bits) -> np.ndarray:
        return np.einsum("ij,ij->i", bits.inputs, sum(w[g] for w, g in zip(self.weights, bits.gates)))

    @staticmethod
    def knots(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The knot below each logit and the share of the one above."""
        at = (np.clip(logits, -REACH, REACH) + REACH) / (2 * REACH) * (KNOTS - 1)
        below = np.minimum(at.astype(np.int64), KNOTS - 2)
        return below, at - below

    def ones(self, bits: Bits) -> np.ndarray:
        """The probability that each bit is 1: the mean of the mixed and the refined one."""
        logits = self.logits(bits)
        first = 1 / (1 + np.exp(-(np.arange(KNOTS) / (KNOTS - 1) * 2 - 1) * REACH))
        table = (self.hits + TRUST * first) / (self.total + TRUST)
        below, share = self.knots(logits)
        refined = table[bits.gates[0], below] * (1 - share) + table[bits.gates[0], below + 1] * share
        return np.clip((1 / (1 + np.exp(-np.clip(logits, -40, 40))) + refined) / 2, LEAST, 1 - LEAST)

    def learn(self, bits: Bits, squares: list[np.ndarray]) -> None:
        """One online step: the refining map counts what came, then the weights follow the coding cost."""
        logits = self.logits(bits)
        below, share = self.knots(logits)
        for at, part in ((below, 1 - share), (below + 1, share)):
            flat, w = bits.gates[0] * KNOTS + at, bits.weight * part
            self.total += np.bincount(flat, w, GATES[0] * KNOTS).reshape(-1, KNOTS)
            self.hits += np.bincount(flat, w * bits.y, GATES[0] * KNOTS).reshape(-1, KNOTS)
        error = bits.weight * (bits.y - 1 / (1 + np.exp(-np.clip(logits, -40, 40))))
        for w, g, s, size in zip(self.weights, bits.gates, squares, GATES):
            mass = np.maximum(np.bincount(g, bits.weight, size), 1e-9)[:, None]
            slope = np.stack([np.bincount(g, error * bits.inputs[:, k], size) for k in range(KINDS)], axis=1) / mass
            s += slope**2
            w += RATE * slope / np.sqrt(s + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([*(w.ravel() for w in self.weights), self.hits.ravel(), self.total.ravel()])


WEIGHTS = sum(GATES) * KINDS


def part_order(words: pa.Array) -> np.ndarray:
    """Words by a hash of their bytes, so that an online pass does not follow the alphabet."""
    data, cuts = utf8(words)
    return np.argsort(range_hashes(data, cuts[:-1], cuts[1:]), kind="stable")


def ranges(found: Events, order: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Events of STEP_WORDS words after the other, in the given order of words."""
    cuts = np.searchsorted(found.word, np.arange(n + 1))
    for a in range(0, n, STEP_WORDS):
        some = order[a : a + STEP_WORDS]
        size = cuts[some + 1] - cuts[some]
        yield np.repeat(cuts[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class Part:
    """The words of a part and the predictors of their bits."""

    def __init__(self, part: int, units: bytes, followers: bytes, at: list[bytes]):
        self.units = unpack(units, UNITS)
        self.words = Words(self.units)
        self.found = self.words.events()
        local = alone(self.found, edges_of(part, at))
        self.predictors = Predictors(self.found, Counts(self.found, local, unpack(followers, FOLLOWERS)))

    def learn(self) -> np.ndarray:
        """An online pass over the training words: weights by the part's tokens, the map, and the tokens."""
        mixer, squares = Mixer.new(), [np.zeros((g, KINDS)) for g in GATES]
        for some in ranges(self.found, part_order(self.words.words), len(self.words.words)):
            some = some[self.found.weight[some] > 0]
            if len(some):
                mixer.learn(self.predictors.bits(some, True), squares)
        values, tokens = mixer.flat(), float(self.words.total.sum())
        values[:WEIGHTS] *= tokens
        return np.append(values, tokens)

    def prices(self, mixer: Mixer) -> np.ndarray:
        """log10 probability of each unit."""
        found, n = self.found, len(self.words.words)
        bits = np.zeros(len(found.word))
        for some in ranges(found, np.arange(n), n):
            b = self.predictors.bits(some, False)
            ones = mixer.ones(b)
            bits[some] = np.log10(np.where(b.y, ones, 1 - ones)).reshape(-1, 8).sum(axis=1)
        body = found.closing < 0
        price = np.repeat(np.bincount(found.word[body], bits[body], n)[:, None], len(CLOSERS), axis=1)
        price[found.word[~body], found.closing[~body]] += bits[~body]
        return price[self.words.of, self.words.code]


def fit(parts: DataFrame, at: list[bytes]) -> Mixer:
    """Mean weights of the parts' online passes, by their tokens, and the sum of their maps.

    Each event is predicted without its own occurrence.  The result has a fixed size.
    """
    shared = parts.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = Part(**row, at=shared.value).learn()
                yield pa.record_batch({"at": np.arange(len(values)), "value": np.rint(values * FIXED).astype(np.int64)})

    rows = parts.mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    mixer = Mixer.new()
    values = np.zeros(WEIGHTS + 2 * GATES[0] * KNOTS + 1)
    for row in rows:
        values[row["at"]] = float(row["value"]) / FIXED
    if values[-1]:
        begin = 0
        for i, g in enumerate(GATES):
            mixer.weights[i] = (values[begin : begin + g * KINDS] / values[-1]).reshape(g, KINDS)
            begin += g * KINDS
        mixer.hits, mixer.total = values[begin:-1].reshape(2, GATES[0], KNOTS)
    return mixer


def answers(parts: DataFrame, asked: DataFrame, mixer: Mixer, at: list[bytes]) -> DataFrame:
    """(block, first, counts, prices): for the units that a block asked for, their words' training counts and their log10 probabilities."""
    shared = parts.sparkSession.sparkContext.broadcast((mixer, at))  # of a fixed size, and a few words for a million

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, at = shared.value
        for part, group in grouped(batches, "part"):
            known = prices = total = None
            for batch in group:
                for row in batch.to_pylist():  # the part itself comes first
                    if row["block"] is None:
                        own = Part(part, row["units"], row["followers"], at)
                        prices, known = own.prices(mixer), own.words.words
                        number = np.full((len(known), len(CLOSERS)), -1)
                        number[own.words.of, own.words.code] = np.arange(len(prices))
                        total = np.where(own.words.filled, own.words.total + 1, 0)
                        continue
                    units = unpack(row["units"], UNITS)
                    word = pc.index_in(units.column(0), known).to_numpy(zero_copy_only=False)
                    unit = number[word, units.column(1).to_numpy()]
                    counts, _ = pack_numbers(total[word])
                    yield pa.record_batch({
                        "block": pa.array([row["block"]], pa.int64()), "first": pa.array([row["first"]], pa.int64()),
                        "counts": pa.array([counts.tobytes()], pa.binary()), "prices": pa.array([prices[unit].tobytes()], pa.binary()),
                    })

    together = parts.unionByName(asked, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_first())
    return together.mapInArrow(run, "block long, first long, counts binary, prices binary")


# -------------------------------------------------------------------- texts


def add_up(lined: DataFrame, train_tokens: int, distinct: int, ends: int) -> DataFrame:
    """Scores of the texts of each block, before which the answers to the block come."""
    floor = train_tokens + distinct + 1
    end = math.log10((ends + 1) / floor)

    def texts(column: dict[str, pa.Array], known: np.ndarray, bases: np.ndarray, prices: np.ndarray) -> pa.RecordBatch:
        n = len(column["row"])
        (data, at), (more, _) = utf8(column["lists"]), utf8(column["more"])
        values = unpack_numbers(data)
        cuts = np.concatenate([[0], np.cumsum(data < 128)])[at]
        steps, times = values >> 2, (values & 3) + 1
        times[times == 4] = unpack_numbers(more)
        unit = np.cumsum(steps)
        owner = np.repeat(np.arange(n), np.diff(cuts))
        unit -= (unit[cuts[:-1]] - steps[cuts[:-1]])[owner]  # the steps of each text begin anew
        cost, base = (prices[unit] * times).tolist(), (bases[unit] * times).tolist()
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        # exact sums: the order of a block's units does not matter
        score = np.array([math.fsum(cost[x:y]) for x, y in spans])
        size = column["n_bytes"].to_numpy()
        hits = np.bincount(owner, known[unit] * times, n).astype(np.int64) + (ends > 0)
        names = ["row", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]
        scores = [pa.array([math.fsum([*base[x:y], end]) for x, y in spans]), pa.array(score), pa.array(-score / math.log10(2) / (size + 1))]
        return pa.record_batch([column["row"], column["n_tokens"], pa.array(hits), *scores], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in grouped(batches, "block"):
            told: list[tuple[int, bytes, bytes]] = []
            table = None
            for batch in group:
                column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                is_text = pc.is_valid(column["row"])
                some = [column[c].filter(pc.invert(is_text)).to_pylist() for c in ("first", "counts", "prices")]
                told += zip(*some)
                batch = batch.filter(is_text)
                if not batch.num_rows:
                    continue
                if table is None:
                    told.sort()
                    counts = unpack_numbers(np.frombuffer(b"".join(c for _, c, _ in told), np.uint8))
                    bases = np.where(counts > 0, np.log10(np.maximum(counts, 1) / floor), 0.0)
                    table = counts > 1, bases, np.frombuffer(b"".join(p for _, _, p in told))
                    told = []
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    yield texts({name: part.column(i) for i, name in enumerate(part.schema.names)}, *table)

    schema = StructType([lined.schema["row"]])
    for name, kind in {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "bits_per_byte": "double"}.items():
        schema = schema.add(name, kind)
    return lined.mapInArrow(run, schema)


def score_texts(docs: DataFrame, train: Column, text: str = "text", into: str = "lm", block_bytes: int = BLOCK_BYTES, part_words: int = PART_WORDS) -> DataFrame:
    """Add the scores of every whole text by a model of the texts where ``train`` holds.

    ``into`` is a struct: n_tokens (words and one end), n_known (those seen in
    training), train_tokens, base_score (log10 of smoothed word frequencies), score
    (the log10 probability of the whole lower-cased text by the mixed model, its end
    included) and bits_per_byte of the latter.  The text does not travel on; all other
    columns do.

    NULL and empty texts are one end.  A NULL ``train`` is not trained on.  Repeated rows are
    trained on and scored each.  Without any training text all words are unknown,
    base_score is 0 and the bits have the odds of an untrained model.  An empty table
    gives an empty result.  Texts and words may be of any length; contexts look back 24
    bytes at most.  The scores do not depend on how the rows are spread: words are parted
    by sampled hashes and summed exactly.
    """
    ready(docs.sparkSession)
    rate = max(1, part_words // SAMPLES)
    blocks = split_blocks(docs, train, text, block_bytes, rate)
    at = borders(blocks)
    asked = requests(blocks, at)
    words = vocabulary(asked, at)
    totals = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "ends")]).first()
    parts = whole_parts(words)
    told = answers(parts, asked, fit(parts, at), at)
    texts = blocks.where("row IS NOT NULL").select("block", "row", "lists", "more", "n_tokens", "n_bytes")
    lined = texts.unionByName(told, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("row").isNotNull())
    n = totals.tokens + totals.ends
    scored = add_up(lined, n, totals.distinct + (totals.ends > 0), totals.ends)
    fields = ["n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte"]
    others = [F.col(f"row.`{c}`") for c in docs.columns if c != text]
    return with_result(scored.select(*others, F.struct(*fields).alias("__lm")), into, F.col("__lm")).drop("__lm")
