"""Token ids in Parquet lists: one id column, small pages with indexes, delta or dictionary coding."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataforge.llm.identity import ordered_key
from strataforge.llm.text import SPACE, Remembered, fresh, ready, slices, utf8

END = 1
ROW_GROUP_BYTES = 64 << 20
PAGE_ROWS = 2000  # rows of a page: what a selective read skips by the page index
SLICE_BYTES = 4 << 20
CACHE_WORDS = 400_000  # word encodings a Python worker keeps
SCHEMA = "doc long, part int, at long, n_tokens long, ids array<int>"
FILE = pa.schema([("doc", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
LETTERS, MARKS, LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
MARKS[list(b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~")] = True  # all but those that control tokens begin and end with
LOWER[65:91] += 32
# the character that stands for each byte in a byte-level vocabulary: itself if it shows, else one from U+0100 on
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
UNITS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


# the splitting that the word-wise way below relies on
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def word_wise(definition: str) -> bool:
    """Whether a tokenizer is the lower-casing one whose texts can be encoded word by word."""
    d = json.loads(definition)
    return (
        (d.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and (d.get("pre_tokenizer") or {}).get("pretokenizers") == PRETOKENIZERS
        and d["model"].get("type") == "BPE"
        and d["model"].get("end_of_word_suffix") == "</w>"
        and not d["model"].get("continuing_subword_prefix")
        and not d["model"].get("dropout")
        and all(
            t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"])
            for t in d.get("added_tokens", [])
        )
    )


class WordTokens:
    """Encodings of words by a tokenizer that never joins two of them (see ``word_wise``); others encode whole texts.

    The tokenizer's own splitting parts text at white space and between a
    letter and a punctuation mark, and it folds case.  So a text's ids are those
    of its words, each encoded once and looked up after.  A word of plain Latin
    letters is one unit to the tokenizer, which NFC and splitting leave as it is; it goes to
    the tokenizer's model in lower case.  Others pass the whole tokenizer one by one.
    """

    def __init__(self, definition: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.word_wise = word_wise(definition)
        self.known = Remembered(limit)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        plain, other = [], []
        for raw in words:
            if raw.isalpha():
                plain.append(raw)
            else:
                w = raw.decode()
                # letters below U+0180 without the dotted capital I: one letter each, also in lower case
                (plain if w.isalpha() and max(w) < "\u0180" and "\u0130" not in w else other).append(raw)
        model = self.tokenizer.model.tokenize
        units = [raw.lower().decode() if raw.isascii() else raw.decode().lower().encode().decode("latin-1").translate(UNITS) for raw in plain]
        ids: list[int] = []
        sizes: list[int] = []
        for w in units:
            found = model(w)
            ids += [t.id for t in found]
            sizes.append(len(found))
        for found in self.encode([raw.decode() for raw in other]):
            ids += found
            sizes.append(len(found))
        self.known.add(plain + other, [np.array(ids, np.int32)], np.array(sizes, np.int64))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where the distinct words stand among the known ones."""
        found = list(map(self.known.places.get, words))
        new = [w for w, place in zip(words, found) if place is None]
        if new:
            if self.known.make_room(len(new)):
                new = [w for w in words if w not in self.known.places]
            self.learn(new)
            found = list(map(self.known.places.__getitem__, words))
        places = np.array(found, np.int64)
        self.known.uses[places] += 1
        return places


_tokens: dict[int, WordTokens] = {}


def tokens_of(definition: str) -> WordTokens:
    """One set of word encodings per Python worker, kept between its tasks."""
    key = hash(definition)
    if key not in _tokens:
        _tokens.clear()
        _tokens[key] = WordTokens(definition)
    return _tokens[key]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units that can be encoded apart, and the first unit of each text: cut at ASCII white space and before closing marks.

    Marks between a letter and white space, or the text's end, are together a
    word of their own to the tokenizer.
    """
    folded = LOWER[data]
    combining = np.flatnonzero((data == 0xCC) | (data == 0xCD))
    for i in np.unique(np.searchsorted(offsets, combining, "right") - 1).tolist():
        # with a combining mark case may not fold letter by letter
        folded[offsets[i] : offsets[i + 1]] = data[offsets[i] : offsets[i + 1]]
    # control tokens are matched on the raw text, so the case of what may be one stays
    bars = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(bars):
        spaces = np.flatnonzero(SPACE[data])
        bounds = np.union1d(np.union1d(spaces, offsets), [len(data)])
        for i in np.unique(np.searchsorted(bounds, bars, "right")).tolist():
            folded[bounds[i - 1] : bounds[i]] = data[bounds[i - 1] : bounds[i]]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # whether a text begins here
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    marks = MARKS[data]
    begin, end = marks.copy(), marks.copy()
    begin[1:] &= ~marks[:-1] | edge[1:-1]
    end[:-1] &= ~marks[1:] | edge[1:-1]
    closing, behind = np.flatnonzero(begin), np.flatnonzero(end) + 1
    after_letter = (closing > 0) & ~edge[closing] & LETTERS[data[closing - 1]]
    first[closing[after_letter & (edge[behind] | ~inside[np.minimum(behind, len(data) - 1)])]] = True
    starts = np.flatnonzero(first)
    cuts = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(folded[inside])])
    return words, np.searchsorted(starts, offsets)


def encode_slice(texts: pa.Array, tokens: WordTokens, end: int) -> pa.ListArray:
    """Ids of each text with the end id behind."""
    if not tokens.word_wise:
        return pa.array([[*ids, end] for ids in tokens.encode([t or "" for t in texts.to_pylist()])], pa.list_(pa.int32()))
    words, ends = words_of(*utf8(texts))
    coded = words.dictionary_encode()
    places = tokens.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    # the end id is one more word behind each text
    known = tokens.known
    places = np.insert(places, ends[1:], len(known))
    cuts = np.append(known.cuts, known.cuts[-1] + 1)
    words = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.append(known.ids, np.int32(end)), pa.int32()))
    placed = words.take(pa.array(places))
    where = placed.offsets.to_numpy()[ends + np.arange(len(ends))]
    return pa.ListArray.from_arrays(pa.array(where, pa.int32()), placed.values)


def encode_sorted(docs: DataFrame, tokenizer: str, key: str, text: str, end: int) -> DataFrame:
    """Ids of every whole text, sorted by key over the cluster, with positions within each partition."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(definition.value)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in slices(np.diff(offsets), SLICE_BYTES):
                ids = encode_slice(batch.column(1).slice(a, b - a), tokens, end)
                sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                starts = at + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                at += int(sizes.sum())
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(starts), pa.array(sizes), ids], schema=FILE)

    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("t"))
    placed = rows.repartitionByRange(F.col("doc")).sortWithinPartitions("doc")
    return placed.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc: str = "doc_id", text: str = "text", end: int = END) -> str:
    """Write the ids of every whole text in ascending id order; returns the path.

    ``path/ids`` holds Parquet files in the order of their part number: the id of the
    document, its place, its number of ids with the end id, and the ids as a list.  Row
    groups and pages are kept small, and the page index lets a reader take the
    pages of some documents, or the columns without the ids, alone.  Version 2
    pages code numbers as deltas; ids repeat, so they get a dictionary of the
    vocabulary's size while it is smaller.  ``path/parts`` has one row per file
    with the number of ids before it.

    NULL and empty texts are the end id alone.  Repeated ids are ordered by text,
    NULL ids come first and are numbered instead (see ``ordered_key``).  An empty
    table gives empty files.
    """
    spark = ready(docs.sparkSession)
    key = fresh(docs, "_key")
    rows = ordered_key(docs, doc, text, key)
    writer = encode_sorted(rows, tokenizer, key, text, end).write
    for option, value in {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "compression": "zstd",
    }.items():
        writer = writer.option(option, value)
    writer.parquet(f"{path}/ids")
    sizes = read_places(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in sizes:  # one row per file
        starts.append((row.part, total))
        total += row.n
    spark.createDataFrame(starts, "part int, before long").coalesce(1).write.parquet(f"{path}/parts")
    return path


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Documents, places and sizes, without reading any ids."""
    return spark.read.schema("doc long, part int, at long, n_tokens long").parquet(f"{path}/ids")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc, start, n_tokens, ids) from the files; ``where`` is pushed to the page index."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/ids")
    rows = rows if where is None else rows.where(where)
    parts = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    # one row per file: its size is bounded by the file listing the driver holds anyway
    return rows.join(F.broadcast(parts), "part").select("doc", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
