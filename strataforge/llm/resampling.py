"""Importance resampling towards a target distribution, with n-gram counts of distinct lines.

Texts are cut into lines at ``\\n``.  The features of a line are computed once and
multiplied by its occurrences; n-grams that cross lines are added from the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from strataforge.functions.windows import rank_in_order
from strataforge.llm.text import LINE_END, NO_LETTER, batches_of, fresh, ready, slices, utf8, with_result, word_array

BUCKETS = 10_000
SLICE_BYTES = 4 << 20
WEIGHED = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def buckets_of(grams: pa.Array, buckets: int) -> np.ndarray:
    """Bucket of each n-gram; equal ones are hashed once."""
    coded = pc.dictionary_encode(grams)
    hashed = np.fromiter((zlib.crc32(g) % buckets for g in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return hashed[coded.indices.to_numpy(zero_copy_only=False)]


def grams(words: pa.Array, owner: np.ndarray, longest: int, line: np.ndarray | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Runs of 1 to ``longest`` words of one owner, and their owners; with ``line`` only those that cross lines."""
    for n in range(1, longest + 1):
        size = len(words) - n + 1
        if size <= 0:
            return
        inside = owner[:size] == owner[n - 1 :]
        if line is not None:
            inside &= line[:size] != line[n - 1 :]
        places = np.flatnonzero(inside)
        if len(places):
            parts = [words.take(pa.array(places + j)) for j in range(n)]
            yield pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0], owner[places]


class Lines:
    """The distinct lines of some texts, and the lines of each text by number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lines, self.at = word_array(data, offsets, LINE_END)
        coded = lines.dictionary_encode()
        self.distinct, self.number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def line_grams(lines: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and line of each n-gram within lines."""
    words, at = word_array(*utf8(lines), NO_LETTER, True)
    owner = np.repeat(np.arange(len(lines)), np.diff(at))
    for found, whose in grams(words, owner, longest):
        yield buckets_of(found, buckets), whose


def crossing_grams(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of each n-gram that crosses lines."""
    if longest < 2:
        return
    words, at = word_array(data, offsets, NO_LETTER, True)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    lines, starts = word_array(data, offsets, LINE_END)
    _, first = word_array(*utf8(lines), NO_LETTER, True)
    line = np.repeat(np.arange(len(lines)), np.diff(first))
    for found, whose in grams(words, owner, longest, line):
        yield buckets_of(found, buckets), whose


def feature_counts(docs: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Occurrences of all features by bucket.

    Spark counts equal lines first, so that a common line is one row of each task before
    the shuffle and its features are computed once in the corpus.
    """
    ready(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text")).where("text <> ''")
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))

    def table(total: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(total)
        return pa.record_batch({"bucket": used, "n": total[used]})

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part, _, _ in batches_of([batch], "line", SLICE_BYTES):
                times = part.column(1).to_numpy()
                for where, whose in line_grams(part.column(0), longest, buckets):
                    np.add.at(total, where, times[whose])
        yield table(total)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in batches_of(batches, "text", SLICE_BYTES):
            for where, _ in crossing_grams(data, offsets, longest, buckets):
                total += np.bincount(where, minlength=buckets)
        yield table(total)

    counted = lines.mapInArrow(within, "bucket long, n long")
    if longest > 1:
        counted = counted.unionAll(texts.mapInArrow(across, "bucket long, n long"))
    counts = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        counts[row.bucket] = row.n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share of each bucket against its share of all documents."""
    k, s, t = len(raw), raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str, into: str, longest: int) -> DataFrame:
    """Add the number of words and features, and the floored mean gain of the features, of every whole text."""
    table = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def measure_part(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        n, value = len(offsets) - 1, table.value
        lines = Lines(data, offsets)
        m = len(lines.distinct)
        count, total, words = np.zeros(m, np.int64), np.zeros(m, np.int64), None
        for where, whose in line_grams(lines.distinct, longest, len(value)):
            size = np.bincount(whose, minlength=m)
            words = size if words is None else words  # the first are single words
            count += size
            np.add.at(total, whose, value[where])
        words = np.zeros(m, np.int64) if words is None else words
        owner = np.repeat(np.arange(n), np.diff(lines.at))
        sums = np.zeros((3, n), np.int64)
        for row, of_line in zip(sums, (words, count, total)):
            np.add.at(row, owner, of_line[lines.number])
        for where, whose in crossing_grams(data, offsets, longest, len(value)):
            np.add.at(sums[1], whose, 1)
            np.add.at(sums[2], whose, value[where])
        weight = np.where(sums[1] > 0, sums[2] // np.maximum(sums[1], 1), 0)
        return pa.StructArray.from_arrays([pa.array(x) for x in (sums[0], sums[1], weight)], fields=list(WEIGHED))

    @arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = utf8(texts)
            parts = [measure_part(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(np.diff(offsets), SLICE_BYTES)]
            yield pa.concat_arrays(parts) if parts else pa.array([], WEIGHED)

    return with_result(docs, into, measure(F.col(text).cast("string")))


def gumbel(doc: Column, seed: int) -> Column:
    """floor(1000 g), with g drawn from the standard Gumbel distribution by a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text", into: str = "drawn",
    longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20,
) -> DataFrame:
    """Draw documents without replacement with probabilities that follow the target distribution.

    Features are the runs of 1 to ``longest`` words, hashed into ``buckets``.  A
    document's weight is the mean log ratio of its features between ``target`` and all
    documents, in thousandths; a Gumbel value by id is added, and of the documents of at
    least ``least_words`` words the ``percent`` highest scores are drawn, ties to the
    smaller id.  ``into`` is a struct of n_words, n_features, weight, score and rank
    (NULL where not drawn); the text does not travel on, all other columns do.

    NULL and empty texts have no features, weight 0 and are never drawn.  Repeated rows
    count each and are drawn each; rows equal in score and id, NULL ids first, take any
    order among themselves.  Empty tables give an empty result, an empty target gives
    weights that favour rare features.  Ranks come from range partitions, so no task
    sees all scores.
    """
    raw, wanted = feature_counts(docs, text, longest, buckets), feature_counts(target, target_text, longest, buckets)
    found = fresh(docs, "_weighed")
    weighed = weigh(docs, gains(raw, wanted), text, found, longest).drop(text)
    # written once: the draw needs the number of eligible rows before their order
    score, able, place = (fresh(weighed, c) for c in ("_score", "_able", "_place"))
    ready_rows = weighed.withColumn(score, F.col(f"{found}.weight") + gumbel(F.col(doc), seed)).withColumn(able, F.col(f"{found}.n_words") >= least_words)
    order = [F.col(able).desc(), F.col(score).desc(), F.col(doc).asc_nulls_first()]
    placed = rank_in_order(ready_rows, [], order, place)
    eligible = placed.agg(F.count(F.when(F.col(able), 1)).alias("n")).select("n").scalar()
    rank = F.when(F.col(able) & (F.col(place) <= F.floor(F.lit(percent) * eligible / 100)), F.col(place))
    row = F.struct(*[F.col(f"{found}.{c}").alias(c) for c in ("n_words", "n_features", "weight")], F.col(score).alias("score"), rank.alias("rank"))
    return with_result(placed, into, row).drop(found, score, able, place)
