"""Vectorised views of the texts of an Arrow batch, shared by the operators."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession

from strataforge.session import prepare

BATCH_BYTES = "4m"  # text handed to Python at once; one longer text travels alone


def ready(spark: SparkSession) -> SparkSession:
    """Session settings the Python operators rely on: batches bounded by bytes."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    return spark


def with_result(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a result column; a column of the same name (in any letter case) is replaced."""
    kept = [c for c in df.columns if c.lower() != name.lower()]
    return df.select(*[df[f"`{c}`"] for c in kept], value.alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let_go(spark: SparkSession) -> None:
    """Let the driver notice that finished shuffles are unused, so that their files go before the next ones come.

    Only to be called when all that is still needed has been written.
    """
    spark.range(1).collect()  # Spark holds on to the plan it ran last
    gc.collect()  # frames in Python hold their plans in the JVM
    spark.sparkContext._jvm.System.gc()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of each; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if len(raw) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to the limit at most; a larger row is alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


class Remembered:
    """Token ids of words seen before, by word, in one array; when there are too many words, those used most stay."""

    def __init__(self, limit: int):
        self.limit = limit
        self.places: dict = {}  # number of each word
        self.ids, self.cuts, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.places)

    def make_room(self, coming: int) -> bool:
        """Whether words were dropped, as the known and the coming ones are more than the limit; half of the limit at most stays."""
        if len(self) + coming <= self.limit:
            return False
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: max(0, min(self.limit // 2, self.limit - coming))])
        sizes, words = np.diff(self.cuts)[stay], list(self.places)
        self.ids = self.ids[np.repeat(self.cuts[stay] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        self.cuts, self.uses = np.append(0, np.cumsum(sizes)), self.uses[stay] // 2
        self.places = dict(zip([words[i] for i in stay.tolist()], range(len(stay))))
        return True

    def add(self, words: list, ids: list[np.ndarray], sizes: np.ndarray) -> None:
        """Learn words, in this order, from parts of their ids end to end and the number of ids of each."""
        self.places.update(zip(words, range(len(self), len(self) + len(words))))
        self.ids = np.concatenate([self.ids, *ids])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(sizes)])
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    """A 64-bit value per byte; with ``fold_case`` A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if fold_case:
        values[65:91] = values[97:123]
    return values


VALUES = {fold: byte_values(fold) for fold in (False, True)}
BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 18
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, CHUNK) + 1
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE)]
    return _powers[0], _powers[1]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; starts and ends must both ascend.

    Prefix sums of ``value(byte) * BASE**position`` give every range in constant
    time; the inverse power makes the hash independent of the position.
    """
    out = np.empty(len(starts), np.uint64)
    i, n, values = 0, len(starts), VALUES[fold_case]
    while i < n:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        up, down = powers(int(ends[j - 1]) - base)
        part = data[base : int(ends[j - 1])]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values[part] * up[: len(part)], dtype=np.uint64)])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


LINE_END = np.zeros(256, bool)
LINE_END[0x0A] = True
#: bytes outside the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts whose A-Z count as a-z
NO_LETTER = np.arange(256) < 128
NO_LETTER[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def word_ranges(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, and the first word number of each text.

    Another ``space`` gives the words between other bytes.
    """
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]  # a word never crosses two texts
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, fold_case: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words as one Arrow array, and the first word number of each text."""
    starts, ends, at = word_ranges(data, offsets, space)
    body = data[~space[data]]
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    buffers = [None, pa.py_buffer(cuts), pa.py_buffer(FOLD[body] if fold_case else body)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), at


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word number of each text."""
    starts, ends, at = word_ranges(data, offsets)
    return range_hashes(data, starts, ends, fold_case), at


STEP = np.uint64(0xD1342543DE82EF95)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    total = words[:n].copy()
    for i in range(1, k):
        total = mix(total * STEP + words[i : i + n])
    return total


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text; fewer words than k are one shingle, none give none."""
    if len(words) == 0:
        return words
    return np.unique(windows(words, min(k, len(words))))


def batches_of(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches whose texts take ``limit`` bytes at most, with bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(np.diff(offsets), limit):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
