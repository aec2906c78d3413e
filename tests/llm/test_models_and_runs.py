"""Resampling, language-model scores and periodic runs against plain versions, with the odd rows each must bear."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from strataforge.llm import context_mixing as cm, periodic_runs, queries, resampling
from tests.llm.test_operators import ODD, SPACED, lower

LETTERS = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, "a", "x", 1), (3, "other words here", "y", 2), (None, "a b", "z", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lm string, drawn int").repartition(3)


# ---------------------------------------------------------------- resampling


def features_plainly(t, longest):
    words = LETTERS.findall(lower(t or ""))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def drawn_plainly(rows, target, longest, buckets, seed, percent, least):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = collections.Counter(), collections.Counter()
    for texts, counts in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            counts.update(map(bucket, features_plainly(x, longest)[0]))
    S, T = sum(s.values()), sum(t.values())
    out = {}
    for i, x in rows:
        found, words = features_plainly(x, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words]
    able = sorted((i for i in out if out[i][3] >= least), key=lambda i: (-out[i][2], i))
    rank = {i: n for n, i in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((i, n, w, s, rank.get(i)) for i, (n, w, s, _) in out.items())


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, longest):
    rnd = random.Random(2)
    vocab = ["the", "Of", "und", "zwei", "3x", "é", "x-y", "big", "ÄÖ"]
    lines = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 9))) for _ in range(30)]
    rows = [(i, rnd.choice(["\n", "\n\n", " \n"]).join(rnd.choice(lines) for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    rows += [(500 + i, t) for i, t in enumerate(ODD)] + [(900, "line\n" * 30_000)]
    target = [" ".join(rnd.choice(vocab[:4]) for _ in range(20)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, wanted, longest=longest, buckets=97, seed=5, percent=30, least_words=8)
    d = "drawn"
    assert sorted(map(tuple, got.select("doc_id", f"{d}.n_features", f"{d}.weight", f"{d}.score", f"{d}.rank").collect())) == drawn_plainly(rows, target, longest, 97, 5, 30, 8)


def test_resampling_of_odd_rows(spark, odd):
    wanted = odd.select("text")
    got = resampling.resample(odd, wanted, least_words=1, percent=100)
    assert got.columns == ["doc_id", "lm", "drawn"] and got.count() == odd.count()
    ranks = sorted(r.drawn.rank for r in got.collect() if r.drawn.rank)
    assert ranks == list(range(1, len(ranks) + 1))  # equal scores and repeated ids still get ranks of their own
    assert resampling.resample(odd.limit(0), wanted).count() == 0
    assert all(r.drawn.rank is None for r in resampling.resample(odd, wanted.limit(0), least_words=10**6).collect())


# -------------------------------------------------------------------- scores


def units_plainly(t):
    data, out, word = "".join(lower(t or "")).encode(), [], b""
    for b in data:
        if b in b" \t\n\x0b\x0c\r":
            out.append((word, b))
            word = b""
        else:
            word += bytes([b])
    return [*out, (word, cm.END)]


def base_plainly(rows, held):
    tokens = {i: [w for w, _ in units_plainly(t) if w] + [None] for i, t in rows}
    c = collections.Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


@pytest.fixture(scope="module")
def written():
    rnd = random.Random(4)
    stems, ends = ["flow", "gard", "lant", "mir", "Pol", "é"], ["", "s", "ing", "ed", "er!", "o"]
    texts = [rnd.choice([" ", " ", "  ", "\n"]).join(rnd.choice(stems) + rnd.choice(ends) for _ in range(rnd.randint(1, 60))) for _ in range(240)]
    return [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, "long " * 20_000), (2001, "z" * 5000)]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def scores_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(options.pop("spread", 3))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return {r.doc_id: r.lm for r in cm.score_texts(df, ~held, **options).collect()}


def test_base_scores(spark, written):
    got = scores_of(spark, written)
    for i, (n, known, total, score) in base_plainly(written, {i for i, _ in written if held_out(i)}).items():
        assert tuple(got[i])[:3] == (n, known, total)
        assert got[i].base_score == pytest.approx(score, rel=1e-12)


def test_scores_do_not_depend_on_blocks_or_spread(spark, written):
    one = scores_of(spark, written)
    small = scores_of(spark, written, block_bytes=1000, spread=5)
    assert {i: tuple(x) for i, x in one.items()} == {i: tuple(x) for i, x in small.items()}


def test_parts_know_what_the_whole_knows(spark, written):
    """Many parts with an untrained mixer price units like one part does."""
    df = spark.createDataFrame(written, "doc_id long, text string").repartition(3)
    prices = []
    for part_words in (48, 10**9):
        blocks = cm.split_blocks(df, F.lit(True), "text", 4000, max(1, part_words // cm.SAMPLES))
        at = cm.borders(blocks)
        asked = cm.requests(blocks, at)
        parts = cm.whole_parts(cm.vocabulary(asked, at))
        assert (len(at) > 0) == (part_words == 48)
        table = {}
        for r in parts.collect():
            p = cm.Part(r.part, r.units, r.followers, at)
            table |= dict(zip(zip(p.units.column(0).to_pylist(), p.units.column(1).to_pylist()), p.prices(cm.Mixer.new())))
        prices.append(table)
    assert prices[0].keys() == prices[1].keys()
    assert all(v == pytest.approx(prices[1][k], rel=1e-12) for k, v in prices[0].items())


def price_plainly(train, word, closer, mixer):
    """log10 probability of a unit, bit by bit, from counts of every context."""

    def contexts(before):
        out = [("order", k, before[-k:], len(before) <= k) for k in cm.ORDERS]
        return [*out, ("place", min(len(before), 20), cm.CLASS[before[-1]] if before else 0)]

    counts = collections.defaultdict(collections.Counter)
    for w, c in train:
        for i, b in enumerate([*w, c]):
            for x in contexts(w[:i]):
                counts[x][b] += 1
    total = 0.0
    for i, b in enumerate([*word, closer]):
        found = [counts[x] for x in contexts(word[:i])]
        for bit in range(8):
            shift = 7 - bit
            pairs = []
            for c in found:
                same = [(s >> shift & 1, n) for s, n in c.items() if s >> (shift + 1) == b >> (shift + 1)]
                pairs.append((sum(n for v, n in same if not v), sum(n for v, n in same if v)))
            known = max([k + 1 for k, p in enumerate(pairs[:-1]) if sum(p)], default=0)
            longest = min(15, math.ceil(math.log2(sum(pairs[len(cm.ORDERS) - 1]) + 1)))
            gates = (known * 8 + bit, longest, min(15, i))
            logit = sum(math.log((one + cm.PRIOR) / (zero + cm.PRIOR)) * sum(w[g][k] for w, g in zip(mixer.weights, gates)) for k, (zero, one) in enumerate(pairs))
            at = (max(-cm.REACH, min(cm.REACH, logit)) + cm.REACH) / (2 * cm.REACH) * (cm.KNOTS - 1)
            low = min(int(at), cm.KNOTS - 2)
            knots = []
            for k in (low, low + 1):
                own = 1 / (1 + math.exp(-((k / (cm.KNOTS - 1) * 2 - 1) * cm.REACH)))
                knots.append((mixer.hits[gates[0], k] + cm.TRUST * own) / (mixer.total[gates[0], k] + cm.TRUST))
            refined = knots[0] * (1 - (at - low)) + knots[1] * (at - low)
            p = min(1 - cm.LEAST, max(cm.LEAST, (1 / (1 + math.exp(-logit)) + refined) / 2))
            total += math.log10(p if b >> shift & 1 else 1 - p)
    return total


def test_mixed_scores(spark, written):
    rows = [r for r in written if r[0] < 80 or 1000 <= r[0] < 1006]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = ~F.col("doc_id").isin([i for i, _ in rows if held_out(i)])
    blocks = cm.split_blocks(df, train, "text", 1 << 20, 1 << 20)
    asked = cm.requests(blocks, [])
    mixer = cm.fit(cm.whole_parts(cm.vocabulary(asked, [])), [])
    assert not np.allclose(mixer.weights[0], cm.FIRST_WEIGHT)
    units = [u for i, t in rows if not held_out(i) for u in units_plainly(t)]
    got = scores_of(spark, rows, part_words=10**9)
    for i in [i for i, _ in rows if held_out(i)][:4] + [1, 3, 1001]:
        want = sum(price_plainly(units, w, c, mixer) for w, c in units_plainly(dict(rows)[i]))
        assert got[i].score == pytest.approx(want, rel=1e-6)
        assert got[i].bits_per_byte == pytest.approx(-got[i].score / math.log10(2) / (len((dict(rows)[i] or "").encode()) + 1))


def test_held_out_texts_teach_nothing(spark, written):
    base = scores_of(spark, written)
    changed = [(i, "entirely other words zzz" if held_out(i) else t) for i, t in written]
    other = scores_of(spark, changed)
    for i, _ in written:
        if not held_out(i):
            assert tuple(other[i]) == tuple(base[i])


def test_scores_tell_language_from_noise(spark, written):
    rnd = random.Random(9)
    more = [(i, "".join(rnd.choice("qwxyzvkj") for _ in range(200))) for i in range(5000, 5200) if held_out(i)]
    got = scores_of(spark, written + more)
    own = [x.bits_per_byte for i, x in got.items() if i < 240 and held_out(i)]
    noise = [got[i].bits_per_byte for i, _ in more]
    assert max(own) < 4.5 < 5 < min(noise) and np.mean(own) < 3


def test_scores_of_odd_rows(spark, odd):
    got = cm.score_texts(odd, F.lit(True))
    assert got.columns == ["doc_id", "drawn", "lm"] and got.count() == odd.count()
    assert cm.score_texts(odd.limit(0), F.lit(True)).count() == 0
    for r in cm.score_texts(odd, F.lit(None).cast("boolean")).collect():  # nothing to learn from
        assert r.lm.base_score == 0 and r.lm.n_known == r.lm.train_tokens == 0


def test_numbers_pack():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 2 ** rnd.integers(0, 60, 2000))
    data, sizes = cm.pack_numbers(values)
    assert np.array_equal(cm.unpack_numbers(data), values) and sizes.sum() == len(data)


# ---------------------------------------------------------------------- runs


def runs_plainly(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic_words(rnd):
    n, k = rnd.choice([0, 1, 20, 60, 150]), rnd.choice([1, 2, 2, 3, 6])
    words = [rnd.choice(["a", "B", "b", "é", "c.", "dd"][:k]) for _ in range(n)]
    for _ in range(rnd.choice([0, 1, 3])):
        if n > 4:
            a, p = rnd.randrange(n), rnd.randrange(1, max(2, n // 3))
            for i in range(a + p, min(n, a + p * rnd.choice([2, 3, 6]))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("cells", [5, 1 << 20])
def test_runs(cells, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CELLS", cells)
    rnd = random.Random(cells)
    for _ in range(400):
        words, least = periodic_words(rnd), rnd.choice([2, 12, 12, 30])
        codes = np.array([sorted(set(words)).index(w) for w in words], np.int64)
        assert [tuple(map(int, r)) for r in zip(*periodic_runs.find_runs(codes, least))] == runs_plainly(words, least)


def test_unequal_windows_of_one_hash(monkeypatch):
    """Were all windows to share a hash, words would still be compared."""
    monkeypatch.setattr(periodic_runs, "windows", lambda words, k: np.zeros(max(0, len(words) - k + 1), np.uint64))
    rnd = random.Random(3)
    for _ in range(60):
        words = periodic_words(rnd)
        codes = np.array([sorted(set(words)).index(w) for w in words], np.int64)
        assert [tuple(map(int, r)) for r in zip(*periodic_runs.find_runs(codes))] == runs_plainly(words, 12)


def test_runs_of_texts(spark, odd):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([" ", "\n", " \t "]).join(periodic_words(rnd))) for i in range(200)] + [(500 + i, t) for i, t in enumerate(ODD)]
    rows += [(900, "again and " * 50_000), (901, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in periodic_runs.periodic_runs(docs).collect():
        words = SPACED.findall(dict(rows)[r.doc_id] or "")
        runs = runs_plainly(words, 12) if len(words) < 1000 else [(0, 100_000, 2)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [tuple(x) for x in r.periodic.runs] == runs and r.periodic.n_words == len(words)
        assert r.periodic.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    got = periodic_runs.periodic_runs(odd, into="LM")
    assert got.columns == ["doc_id", "text", "drawn", "LM"] and got.count() == odd.count()
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0


def test_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in (11, 12, 13))
    bare = {"op1_ordinal_quality", "op5_merge_replay", "op6_suffix_radix", "op7_longest_first", "op8_token_lists",
            "op9_likelihood_rules", "op10_bilstm_crf", "op12_context_mixing"}
    assert set(queries.QUERIES) - set(queries.ORACLES) == bare
    assert not contract.corpus_pipeline.ORACLE_SQL
