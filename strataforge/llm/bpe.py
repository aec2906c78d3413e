"""Byte-level BPE encoding and decoding by merge replay over an index of the pairs in a slice's distinct words."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from strataforge.llm.text import Remembered, ready, slices, utf8, with_result

SLICE_BYTES = 1 << 20  # texts whose distinct words are replayed together
KNOWN_WORDS = 400_000  # words whose ids a Python worker keeps


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


NONE = np.int64(1) << 40  # rank of a pair that never merges


class Merges:
    """All pairs of tokens that merge, sorted by the ids of their halves, with their ranks."""

    def __init__(self, tokens: list[bytes]):
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        found = [
            (left << 32 | right, i)
            for i, t in enumerate(tokens)
            for cut in range(1, len(t))
            if (left := self.ids.get(t[:cut])) is not None and (right := self.ids.get(t[cut:])) is not None
        ]
        found.sort()
        self.keys = np.array([k for k, _ in found] or [-1], np.int64)
        self.ranks = np.array([r for _, r in found] or [0], np.int64)
        self.after: dict[int, dict[int, int]] = {}  # ranks by left half, then right half
        self.before: dict[int, dict[int, int]] = {}  # ranks by right half, then left half
        for key, rank in found:
            left, right = key >> 32, key & 0xFFFFFFFF
            self.after.setdefault(left, {})[right] = rank
            self.before.setdefault(right, {})[left] = rank

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the offsets of each word; words that are a token as a whole need no merge."""
    whole = np.fromiter((merges.ids.get(w, -1) for w in words), np.int64, len(words))
    known, open_words = np.flatnonzero(whole >= 0), np.flatnonzero(whole < 0)
    ids, places = replay_index([words[i] for i in open_words.tolist()], merges)
    tokens, owner = np.concatenate([whole[known], ids]), np.concatenate([known, open_words[places]])
    order = np.argsort(owner, kind="stable")
    return tokens[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def pair_ranks(tokens: np.ndarray, owner: np.ndarray, merges: Merges) -> np.ndarray:
    """Rank of the pair that begins at each position; NONE at the end of a word and for pairs that never merge."""
    at = np.flatnonzero(owner[1:] == owner[:-1])
    pairs, which = np.unique(tokens[at] << 32 | tokens[at + 1], return_inverse=True)  # each distinct pair is looked up once
    ranks = np.full(len(tokens), NONE)
    ranks[at] = merges.lookup(pairs >> 32, pairs & 0xFFFFFFFF)[which]
    return ranks


def positions_by(ranks: np.ndarray) -> dict[int, list[int]]:
    """Ascending positions of every rank but NONE."""
    at = np.flatnonzero(ranks != NONE)
    at = at[np.argsort(ranks[at], kind="stable")]
    names, first = np.unique(ranks[at], return_index=True)
    bounds = [*first.tolist(), len(at)]
    return {r: at[a:b].tolist() for r, a, b in zip(names.tolist(), bounds, bounds[1:])}


def replay_index(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge replay over many words at once: the ids, and the number of the word of each.

    All words lie in one array of token ids.  ``index`` has, for each rank, the
    positions where a pair of that rank begins, in whatever word (all pairs of one
    rank make the same token); a heap names the lowest rank that has positions.  A merge
    removes the right half and looks up again only the pairs with its two neighbours,
    found by links.  When a merge makes a pair of lower rank, the places left wait until that
    one is done; what is made meanwhile holds the token of the waiting rank, so no place joins them.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    tokens = merges.single[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    if not len(tokens):
        return tokens, owner
    found = pair_ranks(tokens, owner, merges)
    index = positions_by(found)
    ranks, waiting = sorted(index), {}
    joined = owner[1:] == owner[:-1]
    numbers = np.arange(len(tokens))
    following = np.append(np.where(joined, numbers[1:], -1), -1).tolist()
    before = np.append(-1, np.where(joined, numbers[:-1], -1)).tolist()
    ids, begins = tokens.tolist(), found.tolist()  # ``begins``: rank of the pair that begins at a position now
    at_rank, never, nothing = index.get, int(NONE), {}
    while ranks:
        rank = heapq.heappop(ranks)
        with_right, with_left = merges.after.get(rank, nothing).get, merges.before.get(rank, nothing).get
        places = waiting.pop(rank, None) or iter(sorted(index.pop(rank)))
        for place in places:
            if begins[place] != rank:
                continue  # a merge next to it took one half
            right = following[place]
            after, previous = following[right], before[place]
            ids[place], ids[right], begins[right], following[place] = rank, -1, never, after
            made = never
            if after >= 0:
                before[after] = place
                made = with_right(ids[after], never)
                if made != never:
                    known = at_rank(made)
                    if known is None:
                        index[made] = [place]
                        heapq.heappush(ranks, made)
                    else:
                        known.append(place)
            begins[place] = made
            if previous >= 0:
                made = begins[previous] = with_left(ids[previous], never)
                if made != never:
                    known = at_rank(made)
                    if known is None:
                        index[made] = [previous]
                        heapq.heappush(ranks, made)
                    else:
                        known.append(previous)
            if ranks and ranks[0] < rank:
                waiting[rank] = places
                heapq.heappush(ranks, rank)
                break
    merged = np.array(ids, np.int64)
    left = merged >= 0
    return merged[left], owner[left]


_replayed: dict[int, tuple[Merges, Remembered]] = {}


def replayed_by(tokens: list[bytes]) -> tuple[Merges, Remembered]:
    """Merges and the words replayed with them, one set per Python worker, kept between its tasks."""
    key = hash(tuple(tokens))
    if key not in _replayed:
        _replayed.clear()
        _replayed[key] = Merges(tokens), Remembered(KNOWN_WORDS)
    return _replayed[key]


def places_of(found: list[str], merges: Merges, known: Remembered) -> np.ndarray:
    """Number of each word among the known ones; the distinct words not known yet are replayed together."""
    new = list(dict.fromkeys([w for w in found if w not in known.places]))
    if new and known.make_room(len(new)):
        new = list(dict.fromkeys([w for w in found if w not in known.places]))
    if new:
        ids, cuts = replay([w.encode() for w in new], merges)
        known.add(new, [ids], np.diff(cuts))
    places = np.fromiter(map(known.places.__getitem__, found), np.int64, len(found))
    known.uses += np.bincount(places, minlength=len(known))
    return places


def encode_texts(texts: pa.Array, merges: Merges, pattern, slice_bytes: int = SLICE_BYTES, known: Remembered | None = None) -> pa.Array:
    """Token ids of each text: words by the pattern, distinct words replayed once, ids put back in place."""
    known = Remembered(KNOWN_WORDS) if known is None else known
    data, offsets = utf8(texts)
    raw = data.tobytes()
    parts = []
    for a, b in slices(np.diff(offsets), slice_bytes):
        found: list[str] = []
        ends = [0]
        for i in range(a, b):
            found += pattern.findall(raw[offsets[i] : offsets[i + 1]].decode())
            ends.append(len(found))
        if not found:
            parts.append(pa.array([[]] * (b - a), pa.list_(pa.int32())))
            continue
        places = places_of(found, merges, known)
        del found
        words = pa.ListArray.from_arrays(pa.array(known.cuts, pa.int32()), pa.array(known.ids, pa.int32()))
        placed = words.take(pa.array(places))
        where = placed.offsets.to_numpy()[np.array(ends)]
        parts.append(pa.ListArray.from_arrays(pa.array(where, pa.int32()), placed.values))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "ids", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Add the token ids of every whole text.

    A word never depends on another, so the corpus is replayed in slices of
    bounded bytes: each slice indexes the pairs of its distinct words and applies every merge in
    rank order to all of them.  Words that a worker has replayed in an earlier slice are looked up, as long as it remembers them (``KNOWN_WORDS``).
    Larger slices share more words and take more memory; the ids are the same.  No shuffle is needed, and a lost task repeats its slices only.
    The rank file is read by the driver; its size, not the data's, bounds the broadcast.

    NULL and empty texts have no ids.  Repeated rows are encoded each.  Other columns
    pass through; one named like ``into`` is replaced.
    """
    spark = ready(df.sparkSession)
    tokens = spark.sparkContext.broadcast(read_ranks(ranks))

    @arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        (merges, known), compiled = replayed_by(tokens.value), regex.compile(pattern)
        for texts in batches:
            yield encode_texts(texts, merges, compiled, slice_bytes, known)

    return with_result(df, into, ids(F.col(text).cast("string")))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All ids of a batch, and the offsets of each list; NULL is empty."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type))
    starts = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(starts[0], starts[-1] - starts[0]), starts - starts[0]


def _bytes(flat: pa.Array, cuts: np.ndarray, known: pa.Array) -> pa.Array:
    """The tokens of each list end to end."""
    taken = known.take(flat)
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1][cuts]
    buffers = [None, pa.py_buffer(np.ascontiguousarray(at)), data if data is not None else pa.py_buffer(b"")]
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, buffers).cast(pa.binary())


def _packed(flat: pa.Array, cuts: np.ndarray) -> pa.Array:
    """The ids of each list as little-endian unsigned 32-bit integers."""
    numbers = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), "<u4")
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(numbers)])


def decode(df: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes the ids stand for; NULL ids give no bytes.  Unknown ids fail."""
    spark = ready(df.sparkSession)
    tokens = spark.sparkContext.broadcast(read_ranks(ranks))

    @arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(tokens.value, pa.large_binary())
        for lists in batches:
            yield _bytes(*_flat(lists), known)

    return with_result(df, into, joined(F.col(ids)))


def packed(df: DataFrame, ids: str = "ids", into: str = "packed") -> DataFrame:
    """Add the ids as little-endian unsigned 32-bit integers.

    NULL ids give no bytes; repeated rows are packed each; an empty table stays empty.
    Other columns pass through; one named like ``into`` is replaced.
    """
    ready(df.sparkSession)

    @arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield _packed(*_flat(lists))

    return with_result(df, into, pack(F.col(ids)))


def read_back(df: DataFrame, ranks: str, ids: str = "ids", into: str = "read") -> DataFrame:
    """Add a struct of the ``decoded`` bytes and the ``packed`` ids, in one pass over the ids; see ``decode`` and ``packed``."""
    spark = ready(df.sparkSession)
    tokens = spark.sparkContext.broadcast(read_ranks(ranks))

    @arrow_udf("struct<decoded:binary,packed:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(tokens.value, pa.large_binary())
        for lists in batches:
            flat, cuts = _flat(lists)
            yield pa.StructArray.from_arrays([_bytes(flat, cuts, known), _packed(flat, cuts)], ["decoded", "packed"])

    return with_result(df, into, both(F.col(ids)))
