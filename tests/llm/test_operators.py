"""Every operator against a plain version on small fixtures, with the odd rows each must bear."""

import base64
import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from strataforge.llm import (
    bpe, chat, decontaminate, graph, identity, jaccard_join, ordinal, personal_data, quality_rules, sharding, suffix_dedup, text, token_files,
)

RANKS, WORD_TOKENS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n", "a", "a b", "A b", "x" * 3000, "é ü ñ\n" * 40, "a b", "\x1c\x85 z", "1.2.3.4 a@b.c +1 (938) 555-6477"]


def lower(value):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, "a", "x", 1), (3, "other words here", "y", 2), (None, "a b", "z", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, overlap string, _key int").repartition(3)


@pytest.fixture(scope="module")
def family(spark):
    """Near copies of a few texts, with edits, upper case and line breaks."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    seeds = [[rnd.choice(vocab) for _ in range(rnd.choice([5, 12, 30, 80, 200]))] for _ in range(15)]
    rows = []
    for i in range(220):
        words = list(rnd.choice(seeds))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            at, r = rnd.randrange(len(words)), rnd.random()
            if r < 0.4:
                words[at] = rnd.choice(vocab)
            elif r < 0.7:
                words.insert(at, rnd.choice(vocab))
            elif len(words) > 3:
                del words[at]
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else rnd.choice([" ", "\n"]).join(words)))
    return rows + [(300 + i, t) for i, t in enumerate(ODD)]


def linked_plainly(rows, k, percent):
    sets = {}
    for i, t in rows:
        words = SPACED.findall(lower(t or ""))
        n = min(k, len(words))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 80)])
def test_jaccard_join(spark, family, k, percent):
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard_join.near_duplicates(df, words=k, percent=percent).collect()))
    assert got == linked_plainly(family, k, percent)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_signature(share, percent):
    """Whatever shingles count as frequent, also when all or none do."""
    rnd = np.random.default_rng(int(share * 10) + percent)
    flags = rnd.random(1 << jaccard_join.TABLE_BITS) < share
    for _ in range(400):
        n = int(rnd.integers(1, 120))
        x = rnd.integers(0, 2**64, n, dtype=np.uint64)
        y = np.unique(np.concatenate([x[rnd.random(n) < 0.97], rnd.integers(0, 2**64, int(rnd.integers(0, 6)), dtype=np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both) and not np.array_equal(x, y):
            a, b = (jaccard_join.signatures(s, flags, percent) for s in (x, y))
            assert len(np.intersect1d(a, b))


def test_join_of_odd_rows(odd):
    got = jaccard_join.near_duplicates(odd, words=3, percent=90).collect()
    assert len(got) == len(ODD) + 3
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[8, 1] == 4 and by[5, 1] == 4  # equal but for case
    assert by[0, 0] == 0 and by[1, 0] == 1  # no words, no links
    kept = jaccard_join.one_per_group(odd, words=3, percent=90)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 6, 7, 9, 10] and None in ids


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, i) for i in range(2001, 2060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(map(tuple, graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: find(x) for x in list(root)}


def test_passages(spark, odd):
    rnd = random.Random(3)
    vocab = ["the", "of", "Und", "zwei", "3x", "é"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 13, 14, 30])))) for i in range(25)] + [(90, None), (91, " .. "), (None, "zwei zwei")]
    docs = []
    for i in range(150):
        parts = [rnd.choice(items)[1] or "" for _ in range(rnd.randint(0, 3))] + [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40)))]
        rnd.shuffle(parts)
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(parts)))
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for name, t in items:
        w = words.findall(lower(t or ""))
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(name)
    want = {}
    for i, t in docs:
        w, hit, found = words.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                names = windows.get(tuple(w[j : j + k]))
                if names:
                    hit.update(range(j, j + k))
                    found |= names
        want[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 300):  # one pass, and several
        got = decontaminate.find_passages(df, bench, block_bytes=block).collect()
        assert {r.doc_id: (r.overlap.n_words, r.overlap.n_hit, r.overlap["items"]) for r in got} == want
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    again = decontaminate.find_passages(odd, bench)  # has a column named like the result
    assert again.count() == odd.count() and dict(again.dtypes)["overlap"].startswith("struct")
    assert decontaminate.remove_contaminated(odd.limit(0), bench.limit(0)).count() == 0


def tiktoken_encoding():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tables_of_one_block_at_a_time(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(120)]
    docs = [(i, f"{word()} {items[i % 120][1]} {word()} {items[(i * 7) % 120][1][:200]}", i) for i in range(60)] + [(60, None, 1), (60, None, 1), (None, items[3][1], 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.find_passages(df, bench)
    alive, sizes, build = [], [], decontaminate.block_tables

    def counted(*args):
        assert all(t._jbroadcast is None or not t._jbroadcast.isValid() for t in alive)
        tables, size = build(*args)
        alive.append(tables)
        sizes.append(size)
        return tables, size

    monkeypatch.setattr(decontaminate, "block_tables", counted)
    parted = decontaminate.find_passages(df, bench, block_bytes=6000)
    assert parted.columns == whole.columns and sorted(map(str, parted.collect())) == sorted(map(str, whole.collect()))
    assert len(sizes) >= 5 and max(sizes) < (4 << 20) + (1 << 20)  # the shift table of the one class of lengths and a megabyte
    kept = decontaminate.remove_contaminated(df, bench, block_bytes=6000)
    assert kept.columns == df.columns and kept.count() == 2


def test_merge_replay(spark, odd):
    rnd = random.Random(1)
    texts = ODD + ["ab" * 999 + "aaa", "İstanbul ǅ ٣٤ ①②", "don't we'll 'S <|endoftext|>", "q" * 1500 + "zab" * 800]
    texts += ["".join(rnd.choice("abcdeft h'sTn\n é1") for _ in range(rnd.randint(1, 400))) for _ in range(200)]
    texts += [" ".join(chr(c) + chr(c) for c in range(a, a + 600) if not 0xD800 <= c < 0xE000) for a in range(1, 0x3000, 600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    encoding = tiktoken_encoding()
    read = bpe.packed(bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS)).collect()
    for r in read:
        want = encoding.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
        assert bytes(r.packed) == np.array(want, "<u4").tobytes()
    assert bpe.encode(odd, RANKS, P.PATTERN, into="OVERLAP").columns == ["doc_id", "text", "_key", "OVERLAP"]
    assert bpe.encode(odd.limit(0), RANKS, P.PATTERN).count() == 0


def merged_plainly(word, merges):
    ids = [int(merges.single[b]) for b in word]
    while True:
        found = [(merges.after[a][b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if b in merges.after.get(a, ())]
        if not found:
            return ids
        rank, i = min(found)
        ids[i : i + 2] = [rank]


def test_replay_over_one_index_of_all_words():
    merges = bpe.Merges(bpe.read_ranks(RANKS))
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aehinorst") for _ in range(rnd.randint(2, 60))).encode() for _ in range(200)]
    words += [b"a" * 301, b"ab" * 700 + b"aab", bytes(range(256)), b"x", "\u00e9\u0117".encode() * 40]
    ids, owner = bpe.replay_index(words, merges)
    for i, word in enumerate(words):
        assert ids[owner == i].tolist() == merged_plainly(word, merges)
    assert bpe.replay([b"ing", *words], merges)[0].tolist()[1:] == ids.tolist()
    assert [len(x) for x in bpe.replay_index([], merges)] == [0, 0]


def test_ranks_wait_for_a_lower_one_that_a_merge_makes():
    # token ranks: ab (258) comes after abc (257), so that abc is done wherever ab has just been made
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"abcabc"]
    merges = bpe.Merges(tokens)
    for word in (b"abcabcabc", b"ababcab", b"abab" * 50 + b"c", b"aabcbcab"):
        assert bpe.replay_index([word], merges)[0].tolist() == merged_plainly(word, merges)
    swapped = bpe.Merges([bytes([b]) for b in range(256)] + [b"abc", b"ab", b"abab"])  # abc only from ab and c
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 80))).encode() for _ in range(300)]
    ids, owner = bpe.replay_index(words, swapped)
    for i, word in enumerate(words):
        assert ids[owner == i].tolist() == merged_plainly(word, swapped)


def repeats_plainly(rows, depth):
    seen, out = set(), []
    for i, t in sorted(rows):
        body = (t or "").encode()
        gone = [False] * len(body)
        for p in range(len(body) - depth + 1):
            window = body[p : p + depth]
            if window in seen:
                gone[p : p + depth] = [True] * depth
            seen.add(window)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(body), sum(gone), spans, bytes(b for b, g in zip(body, gone) if not g)))
    return out


@pytest.mark.parametrize("depth,digit", [(100, 24), (30, 8), (20, 3)])
def test_suffix_dedup(spark, depth, digit):
    rnd = random.Random(2)
    vocab = ["thé", "of", "and ", "xx", "hein ", "qu", "zz\n"]
    passages = ["".join(rnd.choice(vocab) for _ in range(rnd.randint(20, 90))) for _ in range(6)]
    rows = []
    for i in range(100):
        parts = [rnd.choice([rnd.choice(passages), rnd.choice(passages)[: rnd.randint(1, 100)], "".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40)))]) for _ in range(rnd.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (204, "a" * 99), (205, rows[5][1]), (206, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((a, b, c, d, bytes(e)) for a, b, c, d, e in suffix_dedup.remove_repeats(df, depth=depth, digit=digit).collect())
    assert got == repeats_plainly(rows, depth)


def test_suffix_dedup_of_odd_rows(spark, odd):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    assert {r.n_bytes: r.n_removed for r in got}[3000] == 2999  # every byte but the first is in a string that starts earlier
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_longest_first_is_the_heap():
    rnd = random.Random(4)
    for _ in range(150):
        sizes = [rnd.choice([1, 2, 3, 8, 50, rnd.randint(1, 300)]) for _ in range(rnd.randint(1, 200))]
        shards = rnd.randint(1, 9)
        heap = [(0, s) for s in range(shards)]
        for size in sorted(sizes, reverse=True):
            heapq.heapreplace(heap, (heap[0][0] + size, heap[0][1]))
        classes = [(z, n, z * n) for z, n in sorted(collections.Counter(sizes).items(), reverse=True)]
        loads = [0] * shards
        for (size, n, _), (_, taken) in zip(classes, sharding.longest_first(classes, shards)):
            assert sum(taken) == n
            loads = [load + k * size for load, k in zip(loads, taken)]
        assert sorted(loads) == sorted(load for load, _ in heap)


def test_sharding(spark, odd, family):
    rows = family + [(1000 + i, "one text that a third of all rows share") for i in range(110)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.placed for r in sharding.assign_shards(df, shards=6).collect()}
    where, loads, slots = {}, collections.Counter(), collections.defaultdict(list)
    for i, t in rows:
        body = (t or "").encode()
        assert (got[i].size, got[i].text_crc32) == (len(body) + 8, zlib.crc32(body))
        assert where.setdefault(t or "", got[i].shard) == got[i].shard
        loads[got[i].shard] += got[i].size
        slots[got[i].shard].append(got[i].slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) <= 60
    assert sharding.assign_shards(odd).count() == odd.count()
    assert sharding.assign_shards(odd.limit(0)).count() == 0


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    texts = ODD + ["Å x.,!? don't We'Ll 'S <|endoftext|> a<|startoftext|>b İstanbul ٣٤ ①②", "a b　c é É H̱", "İ ŉa ªb ßß ſ ΣΑΣ", "</w> a</w> b"]
    texts += ["".join(rnd.choice("abCdeft h'sTn\n é1.,!?:;-_İ́ŉß") for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    path = token_files.write_tokens(df, str(tmp_path / "tokens"), WORD_TOKENS)
    got = token_files.read_tokens(spark, path).orderBy("doc").collect()
    tokenizer, at = Tokenizer.from_file(WORD_TOKENS), 0
    for r, t in zip(got, texts, strict=True):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids) == (at, len(want), want)
        at += len(want)
    some = token_files.read_tokens(spark, path, F.col("doc") == 7)
    assert [r.doc for r in some.collect()] == [7]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(doc,7)" in plan
    assert "ids" not in token_files.read_places(spark, path).columns
    odd_path = token_files.write_tokens(odd, str(tmp_path / "odd"), WORD_TOKENS)
    assert token_files.read_tokens(spark, odd_path).count() == odd.count()
    empty = token_files.write_tokens(odd.limit(0), str(tmp_path / "empty"), WORD_TOKENS)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_token_files_keep_control_tokens_and_other_tokenizers(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    texts = ["A <|ENDOFTEXT|> b", "x<|EndOfText|>Y Z", "Foo\n<|STARTOFTEXT|>", "<|endoftext|>A <|", "<|", "", None, "Plain Words.", "|> <|Bar|> É"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    with open(WORD_TOKENS, encoding="utf-8") as file:
        definition = json.load(file)
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(definition | {"normalizer": None}), encoding="utf-8")
    for tokenizer, folder in ((WORD_TOKENS, "lower"), (str(cased), "cased")):
        plain, at = Tokenizer.from_file(tokenizer), 0
        path = token_files.write_tokens(df, str(tmp_path / folder), tokenizer)
        for r, t in zip(token_files.read_tokens(spark, path).orderBy("doc").collect(), texts, strict=True):
            want = plain.encode(t or "", add_special_tokens=False).ids + [1]
            assert (folder, r.start, r.ids) == (folder, at, want)
            at += len(want)
    with open(WORD_TOKENS, encoding="utf-8") as file:
        assert token_files.word_wise(file.read()) and not token_files.word_wise(cased.read_text(encoding="utf-8"))


def test_unique_key(odd):
    keyed = identity.ordered_key(odd, "doc_id", "text", "k").collect()
    assert len({r.k for r in keyed}) == len(keyed)
    assert min(keyed, key=lambda r: r.k).doc_id is None


def test_key_of_ids_in_text(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "y"), ("10", "z"), (None, "w")], "doc_id string, text string")
    keyed = identity.ordered_key(docs, "doc_id", "text", "k").orderBy("k").collect()
    assert [r.doc_id for r in keyed] == [None, "10", "a", "b"]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, depth=1 << 15)


def base_plainly(t):
    words, seen, dup = SPACED.findall(t), set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    twice = {j + x for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for x in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(twice)


def test_quality_rules(spark, odd):
    rnd = random.Random(6)
    good = ["".join(rnd.choice("aeiou") + rnd.choice("nrst") for _ in range(rnd.randint(1, 3))) for _ in range(80)]
    rows, labels = [], []
    for i in range(160):
        words = [rnd.choice(good) for _ in range(90)]
        bad = i % 4 == 0
        rows.append((i, " ".join(f"{w}%%%" if bad else w for w in words) + rnd.choice(["", "\nsame line\nsame line\n"])))
        labels.append((i, int(not bad), 0))
    rows += [(500 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    graded = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_rules.rate(docs, graded).withColumn("kept", quality_rules.kept()).collect()
    for r in got:
        assert tuple(r.quality)[:5] == base_plainly(dict(rows)[r.doc_id] or "")
    verdict = {r.doc_id: r.kept for r in got}
    assert all(verdict[i] == bool(q) for i, q, _ in labels)
    assert not any(verdict[500 + i] for i in range(len(ODD)) if len(SPACED.findall(ODD[i] or "")) < 50)
    assert quality_rules.keep_good(docs, graded).columns == docs.columns
    assert quality_rules.rate(odd, graded.limit(0), into="overlap").count() == odd.count()
    assert quality_rules.rate(odd.limit(0), graded).count() == 0


def grams_plainly(t):
    words = SPACED.findall(lower(t or ""))
    return [*(("word", w) for w in words), *(("pair", *p) for p in zip(words, words[1:])), *(("tail", w.encode()[-2:]) for w in words)]


def ratio_plainly(rows, target, others):
    """Mean ratio of every text: exact grams, counted one by one."""
    total, wanted, docs = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        found = grams_plainly(t)
        total.update(found)
        if i in target:
            wanted.update(found)
        if i in target or i in others:
            docs.update(set(found))
    size, all_ = sum(wanted.values()), sum(total.values())
    ratio = {}
    for g in docs:
        e, n = size * total[g] / all_, wanted[g]
        r = np.log((n + quality_rules.SMOOTH) / (e + quality_rules.SMOOTH))
        sure = 2 * ((n * np.log(n / e) if n else 0) - (n - e))
        if docs[g] >= quality_rules.LEAST_DOCS and abs(r) >= np.log(quality_rules.FACTOR) and sure >= quality_rules.SURE:
            ratio[g] = r
    return {i: sum(ratio.get(g, 0) for g in grams_plainly(t)) / max(1, len(grams_plainly(t))) for i, t in rows}


def graded_texts(n, seed=6):
    """Good texts, junk with marked words, and toxic ones with a few rude words; labels of each."""
    rnd = random.Random(6)
    good = ["".join(rnd.choice("aeiou") + rnd.choice("nrst") for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    rnd = random.Random(seed)
    rude = ["clot", "scamp", "knave"]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(good) for _ in range(rnd.randint(60, 200))]
        kind = "junk" if i % 10 == 0 else "toxic" if i % 10 == 5 else "clean"
        if kind == "junk":
            words = [f"{w}%%%" for w in words]
        if kind == "toxic":
            for _ in range(5):
                words.insert(rnd.randrange(len(words)), rnd.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


def test_ratio_follows_its_definition(spark):
    rows, labels = graded_texts(300)
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    graded = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    trusted = (F.col("quality") == 1) & (F.col("toxic") == 0)
    target, held, others = quality_rules.labelled_sample(graded, "doc_id", trusted, 10_000)
    assert sorted(map(int, target + held)) == [i for i, q, x in labels[:200] if q and not x] and len(others) == 40
    want = ratio_plainly(rows, set(map(int, target)), set(map(int, others)))
    got = {r.doc_id: r.quality for r in quality_rules.rate(docs, graded).collect()}
    assert all(got[i].ratio == pytest.approx(r, abs=1e-12) for i, r in want.items())
    means = sorted(want[int(i)] for i in held)
    least = min(0.0, means[int(quality_rules.LOST * len(means))])
    assert all(q.least == pytest.approx(least) for q in got.values())


def test_every_labelled_document_is_used(spark):
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") + 100_000).cast("string")).alias("text"))
    graded = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    uses = quality_rules.labelled(graded, "doc_id", (F.col("quality") == 1) & (F.col("toxic") == 0))
    assert {r.use: r["count"] for r in uses.groupBy("use").count().collect()} == {"target": 30_000, "held": 10_000, "other": 10_000}
    _, counts, total = quality_rules.labelled_grams(docs, "doc_id", "text", uses)
    assert total == 2 * 30_000 and counts.sum() == 30_000  # one word and its tail each; the tails are those in three documents or more


def test_verdicts_hold_while_the_corpus_grows(spark):
    rows, labels = graded_texts(400)
    graded = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    verdicts = []
    for copies in (1, 4):
        more = [r for c in range(1, copies) for r in ((10_000 * c + i, t) for i, t in graded_texts(400, 50 + c)[0])]
        docs = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(4)
        kept = {r.doc_id for r in quality_rules.keep_good(docs, graded).collect()}
        verdicts.append([(i in kept) for i, _, _ in labels])
        unseen = labels[200:]
        clean = [i in kept for i, q, x in unseen if q and not x]
        assert np.mean(clean) >= 0.95
        assert not any(i in kept for i, q, _ in unseen if not q)
        assert np.mean([i in kept for i, _, x in unseen if x]) <= 0.1
    assert np.mean(np.array(verdicts[0]) == np.array(verdicts[1])) >= 0.98


def test_labelled_ids_of_any_type(spark):
    rows, labels = graded_texts(120)
    docs = spark.createDataFrame([(f"d-{i}", t) for i, t in rows], "doc_id string, text string")
    graded = spark.createDataFrame([(f"d-{i}", q, x) for i, q, x in labels], "doc_id string, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, graded).collect()}
    assert not any(f"d-{i}" in kept for i, q, _ in labels if not q) and len(kept) >= 90
    assert ordinal.rate(docs, graded, F.col("quality"), 2).count() == 120


def test_a_repeated_graded_id_is_one_row(spark):
    docs = spark.createDataFrame([(1, f"word{i} again") for i in range(50)] + [(2, "other text")], "doc_id long, text string")
    grades = spark.createDataFrame([("1", 1), ("2", 0)], "id string, grade int")
    texts, values = ordinal.graded_sample(docs, grades, "doc_id", "text", 10)
    assert len(texts) == 2 and sorted(values) == [0, 1]


def test_ordinal(spark, odd):
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(200)]
    marks = [["junk", "spam"], ["rude"], []]
    rows, grades = [], []
    for i in range(900):
        g = i % 3
        words = [rnd.choice(common) for _ in range(60)] + [rnd.choice(marks[g]) for _ in range(2) if marks[g]]
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        grades.append((i, g))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(grades, "doc_id long, g int")
    rated = ordinal.rate(docs, labels.where("doc_id < 600"), F.col("g"), 3).collect()
    held = [(r.rating.expected_grade, r.rating.p_top, grades[r.doc_id][1]) for r in rated if r.doc_id >= 600]
    assert np.mean([round(e) == g for e, _, g in held]) > 0.95
    assert np.mean([(p >= 0.5) == (g == 2) for _, p, g in held]) > 0.95
    chosen = [r.chosen for r in ordinal.rate(docs, labels.where("doc_id < 600"), F.col("g"), 3).select("doc_id", ordinal.selected().alias("chosen")).orderBy("doc_id").collect()]
    assert np.mean([c == (g == 2) for c, (_, g) in zip(chosen[600:], grades[600:])]) > 0.9
    assert all(0 <= e <= 2 and 0 <= p <= 1 for e, p, _ in held)
    assert ordinal.rate(odd, labels, F.col("g"), 3, into="overlap").count() == odd.count()
    assert ordinal.rate(docs, labels.limit(0), F.col("g"), 3).count() == 900


def test_thresholds_are_ordered():
    rnd = np.random.default_rng(0)
    texts = [np.unique(rnd.integers(0, 1000, 30)) for _ in range(300)]
    model = ordinal.fit(texts, rnd.integers(0, 4, 300), 4)
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(np.array([-1.0, 0.0, 2.0]))
    assert np.all(np.diff(tails, axis=1) <= 0) and np.all(np.diff(tails, axis=0) >= 0)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def spans_plainly(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], personal_data.KINDS.index(s[0])))


def test_base_spans():
    rnd = random.Random(1)
    for _ in range(5000):
        t = "".join(rnd.choice("01255.@a-+ ()4%é") for _ in range(rnd.randint(0, 60)))
        assert personal_data.base_spans(t) == spans_plainly(t)
    for t in ("1" * 200_000, "a" * 200_000 + "@" * 1000, "1." * 100_000, "+1" + " " * 100_000):
        personal_data.base_spans(t)  # in time near the length


def test_crf_sums_over_all_paths():
    rnd = np.random.default_rng(3)
    scores, move, begin = rnd.normal(size=(2, 3, 9)), rnd.normal(size=(9, 9)), rnd.normal(size=9)
    p, expected, total = personal_data.forward_backward(scores, move, begin)
    for n in range(2):
        paths = {
            (a, b, c): begin[a] + scores[n, 0, a] + move[a, b] + scores[n, 1, b] + move[b, c] + scores[n, 2, c]
            for a in range(9) for b in range(9) for c in range(9)
        }
        assert total[n] == pytest.approx(np.log(sum(np.exp(v) for v in paths.values())))
        assert p[n, 1, 4] == pytest.approx(sum(np.exp(v - total[n]) for k, v in paths.items() if k[1] == 4))
        assert tuple(personal_data.viterbi(scores, move, begin)[n]) == max(paths, key=paths.get)
    assert expected.sum() == pytest.approx(4)


def pii_rows(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aehinorst") for _ in range(rnd.randint(2, 8)))
    rows = []
    for i in range(n):
        parts = [word() for _ in range(40)]
        kind = rnd.randrange(4)
        if kind == 0:
            parts[20] = f"{word()}.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com"
        elif kind == 1:
            parts[20] = ".".join(str(rnd.randint(1, 255)) for _ in range(4))
        elif kind == 2:
            parts[20] = f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
        else:
            parts[20] = str(rnd.randint(1, 99999))
        rows.append((i, " ".join(parts)))
    return rows


def test_tagger_learns_held_out_spans():
    def windows(rows):
        xs, ys = [], []
        for _, t in rows:
            c = personal_data.codes(t)
            tags = np.concatenate([personal_data.tags_of(personal_data.base_spans(t), len(c)), np.zeros(64, np.int64)])
            for s in personal_data.window_starts(c):
                xs.append(personal_data.cut_windows(c, np.array([s]))[0])
                ys.append(tags[s : s + 64])
        return np.array(xs), np.array(ys)

    x, y = windows(pii_rows(500, 1))
    tagger = personal_data.train(x, y, epochs=4)
    x, y = windows(pii_rows(100, 2))
    found, _ = tagger.decode(x)
    assert (found == y)[y > 0].mean() > 0.9 and (found > 0)[y == 0].mean() < 0.02


def test_windows_cover_every_digit():
    rnd = random.Random(9)
    for _ in range(200):
        t = "".join(rnd.choice("ab @1" if rnd.random() < 0.05 else "ab ") for _ in range(rnd.randint(0, 400)))
        starts = personal_data.window_starts(personal_data.codes(t))
        covered = {s + j for s in starts.tolist() for j in range(64)}
        for m in re.finditer("[0-9@]", t):
            assert set(range(max(0, m.start() - 24), min(len(t), m.start() + 24))) <= covered


def test_personal_data(spark, odd):
    rows = pii_rows(60, 5) + [(100 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    for r in personal_data.find(df).collect():
        base = [tuple(s) for s in r.found.base]
        assert base == spans_plainly(r.text or "")
        assert set(base) <= {tuple(s) for s in r.found.spans}
    clean = personal_data.redact(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        assert not spans_plainly(r.text or "") and r.n_chars == len(r.text or "")
    assert personal_data.find(odd, into="overlap").count() == odd.count()
    assert personal_data.find(odd.limit(0)).count() == 0


def test_tagger_adds_spans_the_patterns_miss(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("aehinorst") for _ in range(rnd.randint(2, 8)))
    digits = lambda n: "".join(rnd.choice("123456789") for _ in range(n))
    card = lambda: next(d for d in iter(lambda: "4" + digits(15), "") if personal_data.luhn(d))
    known = {
        "email": lambda: f"{word()}.{word()}@{word()}.example.com",
        "phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
        "card": lambda: " ".join(re.findall("....", card())),
        "ip": lambda: ".".join(str(rnd.randint(1, 255)) for _ in range(4)),
    }
    hidden = {
        "email": lambda: f"{word()} at {word()} dot org",
        "phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        "card": lambda: ".".join(re.findall("....", card())),
    }
    clean = [lambda: str(rnd.randint(1, 99999)), lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"1{digits(1)}:4{digits(1)}", lambda: "look at the dot there"]
    rows, want = [], {}
    for i in range(1600):
        parts = [word() for _ in range(40)]
        if i < 1000:
            parts[20] = known[list(known)[i % 4]]()
        elif i < 1300:
            parts[20] = rnd.choice(clean)()
        elif i < 1450:
            kind = list(hidden)[i % 3]
            parts[20] = hidden[kind]()
            start = len(" ".join(parts[:20])) + 1
            want[i] = (kind, start, start + len(parts[20]))
        else:
            parts[20] = rnd.choice(clean)()
        rows.append((i, " ".join(parts)))
    found = personal_data.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    spans = {r.doc_id: [tuple(s) for s in r.found.spans] for r in found}
    assert all(not r.found.base for r in found if r.doc_id in want)
    hit = {k: np.mean([any(s[0] == k and s[1] < w[2] and w[1] < s[2] for s in spans[i]) for i, w in want.items() if w[0] == k]) for k in hidden}
    assert min(hit.values()) >= 0.6, hit
    assert np.mean([bool(spans[i]) for i in range(1000, 1600) if i not in want]) <= 0.02


def test_reply_trees(spark):
    rnd = random.Random(11)
    nodes = []
    for tree in range(12):
        for node in range(rnd.choice([1, 2, 9, 40])):
            parent = rnd.choice([None, rnd.randrange(node)]) if node and rnd.random() < 0.1 else (rnd.randrange(node) if node else None)
            nodes.append((tree, node, parent, rnd.choice(["user", "assistant", None]), rnd.choice(["</s>[INST]", "a<|turn|>b\\<|", "<\\p\\b", None, "x\n" * 3, "<"]), float(rnd.randint(0, 5))))
    nodes += [(99, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 0.0) for i in range(70)]
    nodes += [(98, 1, 2, "user", "circle", 1.0), (98, 2, 1, "user", "circle", 1.0), (97, 5, 77, "assistant", "unknown parent", 1.0), (97, 6, 6, "user", "own parent", 0.5)]
    df = spark.createDataFrame(nodes, "conv long, place long, up long, who string, said string, score double").repartition(3)
    by = {(t, n): (p, r or "", x or "", s) for t, n, p, r, x, s in nodes}
    want = {}
    for (t, n), (p, *_rest) in by.items():
        if t == 98 or any(k[0] == t and v[0] == n and k[1] != n for k, v in by.items()):
            continue
        path, at = [], n
        while at is not None and (t, at) in by:
            path.append(at)
            at = by[t, at][0] if by[t, at][0] != at else None
        total = sum(by[t, x][3] for x in path)
        if t not in want or (-total, n) < want[t][0]:
            want[t] = ((-total, n), [by[t, x][1:3] for x in reversed(path)])
    made = chat.format_trees(df, "conv", "place", "up", "who", "said", "score")
    got = made.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_learned(F.col("formatted"), F.col("learn")).alias("learned")).collect()
    assert {r.tree: [tuple(t) for t in r.turns] for r in got} == {t: path for t, (_, path) in want.items()}
    for r in got:
        assert r.learned == "".join(x for role, x in want[r.tree][1] if role == "assistant")
    every = chat.format_trees(df, "conv", "place", "up", "who", "said", "score", top=None)
    leaves = sum(1 for (t, n) in by if t != 98 and not any(k[0] == t and v[0] == n and k[1] != n for k, v in by.items()))
    assert every.count() == leaves
    assert chat.format_trees(df.limit(0), "conv", "place", "up", "who", "said", "score").count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_escapes_are_reversible(spark):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("<|\\bpn\nturn>") for _ in range(rnd.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect()
    assert all(r.u == r.t == r.r and "<|" not in r.e for r in got)


def test_word_hashes_follow_the_words():
    texts = ["Ab ab\tAB", "", "x", " é  É\x0b", "ab" * 9]
    import pyarrow as pa

    data, offsets = text.utf8(pa.array(texts))
    hashes, at = text.word_hashes(data, offsets, True)
    words = [lower(w) for t in texts for w in SPACED.findall(t)]
    assert at.tolist() == np.cumsum([0, *(len(SPACED.findall(t)) for t in texts)]).tolist()
    assert len(set(hashes.tolist())) == len(set(words))
    assert [hashes[i] == hashes[0] for i in range(3)] == [True] * 3
    assert hashlib.sha256(hashes.tobytes()).hexdigest() == hashlib.sha256(text.word_hashes(data, offsets, True)[0].tobytes()).hexdigest()


def test_words_used_most_are_remembered():
    known = text.Remembered(4)
    known.add(["a", "b", "c"], [np.array([1, 2, 2], np.int32), np.array([3, 3, 3], np.int32)], np.array([1, 2, 3]))
    known.uses += [1, 5, 3]
    assert not known.make_room(1) and known.make_room(2)
    assert known.places == {"b": 0, "c": 1} and known.ids.tolist() == [2, 2, 3, 3, 3] and known.cuts.tolist() == [0, 2, 5]
    known.add(["d"], [np.array([], np.int32)], np.array([0]))
    assert known.places["d"] == 2 and known.cuts.tolist() == [0, 2, 5, 5] and known.uses.tolist() == [2, 1, 0]
    assert known.make_room(9) and len(known) == 0 and known.ids.size == 0 and known.cuts.tolist() == [0]


def test_words_are_replayed_once(monkeypatch):
    """A worker replays a word once, not once a slice; words it had to drop are replayed again, with the same ids."""
    import regex

    asked = []
    replay = bpe.replay
    monkeypatch.setattr(bpe, "replay", lambda words, merges: asked.append(words) or replay(words, merges))
    merges, pattern = bpe.replayed_by(bpe.read_ranks(RANKS))[0], regex.compile(P.PATTERN)
    texts = pa.array(["qwxzv zzyxq", None, "qwxzv jjkkq", "", "zzyxq qwxzv été", "qwxzv"])
    coded = bpe.encode_texts(texts, merges, pattern, 1)
    assert sorted(w for words in asked for w in words) == sorted(w.encode() for w in ("qwxzv", " zzyxq", " jjkkq", "zzyxq", " qwxzv", " été"))
    small = text.Remembered(3)
    assert bpe.encode_texts(texts, merges, pattern, 1, small).equals(coded) and len(small) <= 3
    assert bpe.encode_texts(texts, merges, pattern).to_pylist() == coded.to_pylist()


def test_word_tokens_keep_the_words_used_most():
    with open(WORD_TOKENS, encoding="utf-8") as file:
        tokens = token_files.WordTokens(file.read(), 8)
    alone, learned = tokens.encode, []
    learn = tokens.learn
    tokens.learn = lambda words: learned.extend(words) or learn(words)
    texts = [f"common words stay rare{i}x unsaid{i}" for i in range(9)] + ["", None, "".join(map(chr, range(192, 384))), "ÀÉ ŸŽ ªº µ ŉſ İ ĸ ÐÞ"]
    texts += ["ab$$$ don't'! x'", "'s! a.'s! b''", "z!", "!z!!", "q<|endoftext|>!! q|> <|endoftext|>. y{}~\n", "é!! a\u0301!! e!\u0338 =\u0338", "a(b)-- c[1]! 9!!"]
    texts += [c for i in range(0x41, 0x180) if (c := chr(i)).isalpha()]
    got = [token_files.encode_slice(pa.array([t], pa.string()), tokens, 1).to_pylist()[0] for t in texts]
    assert got == [[*ids, 1] for ids in alone([t or "" for t in texts])]
    assert learned.count(b"common") == 1 and len(tokens.known) <= 8
