"""Ordinal cumulative-link regression on graded ratings of hashed texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from strataforge.llm.text import batches_of, mix, range_hashes, ready, slices, utf8, with_result, word_ranges

FEATURE_BITS = 18
TRAIN_ROWS = 12_000  # graded documents the model is fitted on, at most
FOLDS = 5  # parts of the graded rows; each is held out once
PATIENCE, MOST_EPOCHS = 10, 400  # training ends when the held-out loss has not fallen for so many epochs
BATCH = 128
RATE = 0.1
RIDGE = 1e-3
EVIDENCE = 20.0  # chi-square a feature needs between its documents' grades and all grades to get a weight
LOST = 0.05  # share of the held-out rows of the highest grade that the selection may leave out
SLICE_BYTES = 2 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, and offsets: words without case, and words' last two bytes with case."""
    starts, ends, at = word_ranges(data, offsets)
    words = range_hashes(data, starts, ends, True)
    tails = mix(range_hashes(data, np.maximum(starts, ends - 2), ends) + np.uint64(1))
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(at))
    shift = np.uint64(64 - FEATURE_BITS)
    both = np.concatenate([owner << np.uint64(32) | words >> shift, owner << np.uint64(32) | tails >> shift])
    both = np.unique(both)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(both >> np.uint64(32), np.arange(len(offsets), dtype=np.uint64))


@dataclass
class Ordinal:
    """P(grade <= j) = 1 / (1 + exp(score - thresholds[j])); one score per text for all grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    least: float = 0.5  # tail probability of selected texts, at least

    def scores(self, where: np.ndarray, at: np.ndarray) -> np.ndarray:
        sizes = np.diff(at)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return np.bincount(owner, self.weights[where], minlength=len(sizes))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) per text and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def evidence(texts: list[np.ndarray], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Chi-square per feature: how far the grades of its documents are from those of all."""
    shares = np.bincount(grades, minlength=n_grades) / max(1, len(grades))
    flat = np.concatenate([np.zeros(0, np.int64), *texts])
    owner = np.repeat(grades, [len(t) for t in texts])
    seen = np.bincount(flat, minlength=1 << FEATURE_BITS)
    total = np.zeros(1 << FEATURE_BITS)
    for grade in np.flatnonzero(shares):
        expected = np.maximum(seen * shares[grade], 1e-9)
        total += (np.bincount(flat[owner == grade], minlength=1 << FEATURE_BITS) - expected) ** 2 / expected
    return total


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts end to end, and the offsets of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *texts]), np.concatenate([[0], np.cumsum(sizes)])


def loss(model: Ordinal, texts: list[np.ndarray], grades: np.ndarray) -> float:
    """Mean negative log-likelihood of the grades."""
    tails = model.tails(model.scores(*joined(texts)))
    edges = np.concatenate([np.ones((len(texts), 1)), tails, np.zeros((len(texts), 1))], axis=1)
    rows = np.arange(len(texts))
    return float(-np.log(np.maximum(edges[rows, grades] - edges[rows, grades + 1], 1e-9)).mean())


def epochs_of(texts: list[np.ndarray], grades: np.ndarray, n_grades: int, seed: int = 0) -> Iterator[Ordinal]:
    """The model after each epoch of Adagrad on the negative log-likelihood; thresholds stay ordered as sums of positive steps."""
    weights, squares = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-6)
    telling = evidence(texts, grades, n_grades) >= EVIDENCE
    texts = [t[telling[t]] for t in texts]  # the others would only be learned by heart
    raw = np.zeros(n_grades - 1)  # first threshold, then logarithms of the steps
    raw[0] = -1.0
    raw_squares = np.full(n_grades - 1, 1e-6)
    random = np.random.default_rng(seed)
    sizes = np.array([len(t) for t in texts])
    while True:
        order = random.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            where = np.concatenate([texts[i] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes[some])
            steps = np.exp(raw[1:])
            cuts = np.concatenate([[-np.inf], raw[0] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
            score = np.bincount(owner, weights[where], minlength=len(some))
            y = grades[some]
            with np.errstate(over="ignore"):
                upper = 1 / (1 + np.exp(score - cuts[y + 1]))
                lower = 1 / (1 + np.exp(score - cuts[y]))
            p = np.maximum(upper - lower, 1e-9)
            up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
            slope = (up - down) / len(some)  # of the loss by the score
            used, back = np.unique(where, return_inverse=True)
            grad = np.bincount(back, slope[owner], len(used)) + RIDGE * weights[used]
            squares[used] += grad**2
            weights[used] -= RATE * grad / np.sqrt(squares[used])
            by_cut = np.zeros(n_grades + 1)
            np.add.at(by_cut, y + 1, -up / len(some))
            np.add.at(by_cut, y, down / len(some))
            inner = by_cut[1:-1]
            grad_raw = np.array([inner.sum(), *(inner[j:].sum() * steps[j - 1] for j in range(1, n_grades - 1))])
            raw_squares += grad_raw**2
            raw -= RATE * grad_raw / np.sqrt(raw_squares)
        yield Ordinal(weights, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def best_epoch(texts: list[np.ndarray], grades: np.ndarray, held: np.ndarray, n_grades: int) -> tuple[int, np.ndarray]:
    """The epoch with the least loss of the held-out rows, and their tail probabilities of the highest grade then."""
    fitted, kept = np.flatnonzero(~held), np.flatnonzero(held)
    out = [texts[i] for i in kept]
    best = (math.inf, 0, np.zeros(len(kept)))
    for epoch, model in enumerate(epochs_of([texts[i] for i in fitted], grades[fitted], n_grades), 1):
        now = loss(model, out, grades[kept])
        if now < best[0]:
            best = (now, epoch, model.tails(model.scores(*joined(out)))[:, -1])
        if epoch >= min(MOST_EPOCHS, best[1] + PATIENCE):
            return best[1:]


def fit(texts: list[np.ndarray], grades: np.ndarray, n_grades: int) -> Ordinal:
    """Fit on all rows for as many epochs as the held-out folds ask for on average.

    The rows of the folds, each rated by a model that has not seen it, place the
    selection: the highest tail probability that leaves out at most LOST of the
    highest grade.  With fewer rows than folds the model is not fitted.
    """
    if len(texts) < FOLDS:
        return Ordinal(np.zeros(1 << FEATURE_BITS), np.linspace(-1.0, 1.0, n_grades - 1) if n_grades > 2 else np.zeros(1))
    fold = np.arange(len(texts)) % FOLDS
    best = [best_epoch(texts, grades, fold == k, n_grades) for k in range(FOLDS)]
    model, top = None, []
    for _, model in zip(range(max(1, round(sum(n for n, _ in best) / FOLDS))), epochs_of(texts, grades, n_grades)):
        pass
    for k, (_, tails) in enumerate(best):
        top.append(tails[grades[fold == k] == n_grades - 1])
    top = np.sort(np.concatenate(top))
    if len(top):
        model.least = float(top[int(LOST * len(top))])
    return model


def graded_sample(docs: DataFrame, grades: DataFrame, doc: str, text: str, limit: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most ``limit`` graded documents, first by a hash of the id; whole texts are read.

    Of several texts with one id, the one whose feature list is smallest in order is taken.
    """
    spark = docs.sparkSession
    rows = grades.where("grade IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(limit).collect()
    known = spark.sparkContext.broadcast({r.id: r.grade for r in chosen})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graded = known.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            some = [i for i, x in enumerate(ids) if x in graded]
            for part, data, offsets in batches_of([batch.take(pa.array(some, pa.int64()))], "text", SLICE_BYTES):
                where, at = features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(where, pa.int32()))
                names = part.column(0).to_pylist()
                yield pa.record_batch({"id": pa.array(names, pa.string()), "grade": pa.array([graded[i] for i in names], pa.int32()), "features": lists})

    texts = docs.select(F.col(doc).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    rows = texts.mapInArrow(run, "id string, grade int, features array<int>")
    # an id may repeat any number of times: one row of each travels
    found = rows.groupBy("id").agg(F.min(F.struct("features", "grade")).alias("row")).select("id", "row.grade", "row.features").toArrow()
    found = found.take(pc.sort_indices(found, [("id", "ascending")]))
    lists = found["features"].to_numpy(zero_copy_only=False) if found.num_rows else []
    return [np.asarray(x, np.int64) for x in lists], found["grade"].to_numpy().astype(np.int64)


def score(df: DataFrame, model: Ordinal, text: str = "text", into: str = "rating") -> DataFrame:
    """Add the expected grade, the probability of the highest grade, and the least one that is selected, of every whole text."""
    spark = ready(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<expected_grade:double,p_top:double,least:double>")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = utf8(texts)
            expected, top = [np.zeros(0)], [np.zeros(0)]
            for a, b in slices(np.diff(offsets), SLICE_BYTES):
                where, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                tails = shared.value.tails(shared.value.scores(where, at))
                expected.append(tails.sum(axis=1))
                top.append(tails[:, -1])
            least = np.full(sum(map(len, top)), shared.value.least)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(expected)), pa.array(np.concatenate(top)), pa.array(least)], ["expected_grade", "p_top", "least"])

    return with_result(df, into, rate(F.col(text).cast("string")))


def rate(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, doc: str = "doc_id", text: str = "text",
         into: str = "rating", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the graded documents and rate every document.

    ``grade`` is an expression over ``labels`` from 0 to ``n_grades`` - 1.  The
    classifier is fitted on at most ``train_rows`` graded documents; every
    document is scored.  NULL and empty texts have no features and get the
    probabilities of the thresholds alone.  A document graded twice takes the lower
    grade; of repeated ids one row is trained on, all are scored, equal texts alike; NULL
    ids are scored only.  Without graded documents every score is 0.  An empty table gives an
    empty result.  Ids of any type will do; texts of any length are read whole.  Other
    columns pass through; one named like ``into`` is replaced.
    """
    ready(docs.sparkSession)
    grades = labels.select(F.col(doc).cast("string").alias("id"), grade.cast("int").alias("grade"))
    texts, values = graded_sample(docs, grades, doc, text, train_rows)
    return score(docs, fit(texts, values, n_grades), text, into)


def selected(rating: str = "rating") -> Column:
    return F.col(f"{rating}.p_top") >= F.col(f"{rating}.least")
