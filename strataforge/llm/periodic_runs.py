"""Periodic runs of words: stretches that repeat themselves at least twice, by an online sparse diagonal computation.

A diagonal of lag q follows the words that equal the word q places before.  m
such words in a row are a stretch of m + q words with period q, so a run needs
m >= q.  Lags below ``DENSE`` are followed at every word.  A larger lag q, from
``size`` to below 2 * ``size``, needs at least ``size`` equal words in a row, so a
cell of its diagonal exists only where a window of ``size`` words has occurred
before: the earlier occurrences of each window lengthen the active lags, and
diagonals that end are emitted at once if they are long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from strataforge.llm.text import STEP, mix, ready, slices, utf8, windows, with_result, word_array

LEAST = 12  # words a run has at least
DENSE = 8  # lags below are followed at every word
CELLS = 1 << 20  # cells of diagonals handled at once
SLICE_BYTES = 2 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"

Diagonals = tuple[np.ndarray, np.ndarray, np.ndarray]


def straight(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each row of words that equal the word ``lag`` before."""
    same = np.concatenate([[False], words[lag:] == words[:-lag], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return edges[::2] + lag, edges[1::2] + lag - 1


def joined(lags: np.ndarray, first: np.ndarray, last: np.ndarray) -> Diagonals:
    """Pieces of diagonals that follow each other on one lag become one."""
    order = np.lexsort((first, lags))
    lags, first, last = lags[order], first[order], last[order]
    new = np.concatenate([[True], (lags[1:] != lags[:-1]) | (first[1:] != last[:-1] + 1)]) if len(lags) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    return lags[heads], first[heads], last[np.append(heads[1:] - 1, len(lags) - 1)] if len(heads) else last


def follow(places: np.ndarray, earlier: np.ndarray, low: np.ndarray, high: np.ndarray) -> Diagonals:
    """Rows of cells (place, lag), where ``earlier[low:high]`` are the earlier occurrences of each place.

    Places ascend and are handled in blocks of bounded cells; only the diagonals that reach
    the end of a block stay active.
    """
    counts, ended = high - low, []
    active: Diagonals = (np.zeros(0, np.int64),) * 3
    for a, b in slices(counts, CELLS):
        n = counts[a:b]
        at = np.repeat(places[a:b], n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        lags = at - earlier[np.repeat(low[a:b], n) + within]
        lags, first, last = joined(*(np.concatenate(x) for x in zip(active, (lags, at, at))))
        open_ = last == places[b - 1]
        ended.append((lags[~open_], first[~open_], last[~open_]))
        active = lags[open_], first[open_], last[open_]
    return tuple(np.concatenate(x) for x in zip(active, *ended))


def smallest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the periods of one stretch the smallest; by start, then period.

    A stretch of two periods q or more whose smallest period is p < q has p as a
    divisor of q, and then the diagonal of p gives the same stretch.
    """
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(start) else np.zeros(0, bool)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find_runs(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all maximal runs of at least ``least`` words.

    ``words`` are numbers; texts are parted by numbers that occur once, which no run can hold.
    """
    none = np.zeros(0, np.int64)
    start, length, period = [none], [none], [none]

    def add(lags: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        equal = last - first + 1
        good = equal >= np.maximum(lags, least - lags)
        start.append((first - lags)[good])
        length.append((equal + lags)[good])
        period.append(lags[good])

    for lag in range(1, min(DENSE, len(words) // 2 + 1)):
        first, last = straight(words, lag)
        add(np.full(len(first), lag), first, last)
    size = DENSE
    hashes = windows(mix(words.astype(np.uint64) + np.uint64(1)), size)
    places = np.arange(len(hashes))
    while len(places) and 2 * size <= len(words):
        order = np.argsort(hashes, kind="stable")  # places ascend within equal hashes
        same = hashes[order[1:]] == hashes[order[:-1]]
        repeated = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        order = order[repeated]
        group = np.cumsum(np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])) if len(order) else order
        earlier = places[order]
        key = group << 32 | earlier
        # what lies in one run of a period up to size / 2 holds no run of a larger smallest period
        runs = smallest(*map(np.concatenate, (start, length, period)))
        inner = (2 * runs[2] <= size) & (runs[1] >= size)
        heads, tails = runs[0][inner], (runs[0] + runs[1])[inner] - size
        at = np.searchsorted(heads, earlier, "right") - 1
        until = earlier - size
        if len(heads):
            until = np.where((at >= 0) & (earlier <= tails[at]), np.minimum(until, heads[at] - 1), until)
        low = np.searchsorted(key, group << 32 | np.maximum(earlier - 2 * size + 1, 0))
        high = np.maximum(low, np.searchsorted(key, (group << 32) + until, "right"))
        some = np.flatnonzero(high > low)
        some = some[np.argsort(earlier[some])]
        if len(some):
            lags, first, last = follow(earlier[some], earlier, low[some], high[some])
            last = last + size - 1
            long = last - first + 1 >= lags
            wrong = [q for q, a, b in zip(lags[long], first[long], last[long]) if not np.array_equal(words[a : b + 1], words[a - q : b + 1 - q])]
            add(*(x[long & ~np.isin(lags, wrong)] for x in (lags, first, last)))
            for lag in set(wrong):  # unequal windows of one hash: compare the words themselves
                add(np.full(len(straight(words, lag)[0]), lag), *straight(words, lag))
        # windows of twice the size repeat only where both halves do
        back = np.argsort(earlier)
        places, hashes = earlier[back], hashes[order][back]
        other = np.minimum(np.searchsorted(places, places + size), max(0, len(places) - 1))
        both = np.flatnonzero(places[other] == places + size) if len(places) else places
        hashes = mix(hashes[both] * STEP + hashes[other[both]])
        places = places[both]
        size *= 2
    return smallest(*map(np.concatenate, (start, length, period)))


def collapse_texts(data: np.ndarray, offsets: np.ndarray, least: int) -> pa.Array:
    """Result rows of some texts: number of words, runs, and the words left after all repetitions."""
    words, at = word_array(data, offsets)
    n = len(offsets) - 1
    coded = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    begins = at + np.arange(n + 1)  # one number that occurs once follows each text
    numbers = np.empty(len(words) + n, np.int64)
    parted = np.zeros(len(numbers), bool)
    parted[begins[1:] - 1] = True
    numbers[~parted] = coded
    numbers[parted] = -2 - np.arange(n)
    start, length, period = find_runs(numbers, least)
    steps = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    kept = np.cumsum(steps[:-1])[~parted] == 0
    cuts = np.concatenate([[0], np.cumsum(kept)])[at]
    left = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.filter(pa.array(kept)).cast(pa.binary()))
    owner = np.searchsorted(begins, start, "right") - 1
    rows = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(length), pa.array(period)], fields=list(RUN))
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), rows)
    collapsed = pc.binary_join(left, b" ").cast(pa.string())
    return pa.StructArray.from_arrays([pa.array(np.diff(at)), runs, collapsed], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", into: str = "periodic", least: int = LEAST) -> DataFrame:
    """Add the runs of the words ``[^\\x20\\x09-\\x0D]+`` of every whole text, and the text without their repetitions.

    A run is a stretch of at least ``least`` words and two periods that no
    neighbouring word extends with its smallest period; several may overlap.  They
    come by start, then period, with word numbers from 0.  ``collapsed`` keeps the
    words that no run holds after its first period, joined by one space.

    Each row is worked on alone, without a shuffle.  NULL and empty texts, and texts of
    white space, have no words, no runs and an empty ``collapsed``.  Long texts are
    whole; one text of one repeated word costs time in proportion to its length.
    Repeated rows are searched each; an empty table gives an empty result.  Other columns
    pass through; one named like ``into`` is replaced.
    """
    ready(docs.sparkSession)

    @arrow_udf(RESULT)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = utf8(texts)
            parts = [
                collapse_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least)
                for a, b in slices(np.diff(offsets), SLICE_BYTES)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())]))

    return with_result(docs, into, search(F.col(text).cast("string")))
