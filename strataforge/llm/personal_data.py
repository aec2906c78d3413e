"""Personal data: base patterns, and a character BiLSTM with CRF transitions trained in numpy."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from strataforge.llm.text import STEP, fresh, mix, ready, utf8, with_result
from strataforge.session import staged

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32  # characters of a window, and between the starts of two
CONTEXT = 24  # characters on either side of a cue that the windows cover
TRAIN_WINDOWS = 3_000  # windows the tagger is fitted on, at most: a third each without spans, with base spans, with varied ones
HIDDEN, EMBED, CHARS = 16, 12, 130
EPOCHS, RATE = 20, 0.01
HELD_OUT = 5  # each fifth window is kept from training and sets the least probability of a span
RIGHT_SHARE = 0.98  # of the spans found in held-out windows that must be right
BATCH = 256
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
RESULT = "struct<base:array<struct<kind:string,start:long,end:long>>,spans:array<struct<kind:string,start:long,end:long>>>"
RESULT_KIND = pa.struct([("base", pa.list_(SPAN)), ("spans", pa.list_(SPAN))])

Span = tuple[str, int, int]

# fixed patterns of the four kinds; possessive quantifiers keep long runs linear
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
# where windows are cut: digits, @, and what stands for "@" and "." in spelled-out addresses; for re and RE2
CUE_WORDS = r"(?i)(?:^|[^a-z])dot(?:[^a-z]|$)|[\[({<] ?at ?[\])}>]|(?:^|[^a-z])at +[a-z0-9-]+\.[a-z][a-z]"
CUES = re.compile(CUE_WORDS.encode())
SPELLED = re.compile(r"(?i)[a-z0-9][^a-z0-9]{1,3}at[^a-z0-9]{1,3}[a-z0-9-]+(?:[^a-z0-9]{1,3}dot[^a-z0-9]{1,3}|\.)[a-z]")
# numbers written like a phone number or in groups like a card: nobody has labelled them, so they are no clean examples
GROUPED = re.compile(r"[0-9]{3}\W{1,2}[0-9]{3}\W[0-9]{4}(?![0-9])|[0-9]{4}(?:\W{1,3}[0-9]{4}){3}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """An address is found from its @: the local part reaches back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start and kind."""
    found = list(emails(text))
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = "".join(DIGITS.findall(m.group()))
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGITS.findall(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def codes(text: str) -> np.ndarray:
    """Classes of the characters: ASCII as it is, letters beyond it, all else."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, points, np.where(points < 0x250, 128, 129)).astype(np.int64)


def window_starts(chars: np.ndarray) -> np.ndarray:
    """Starts of overlapping windows that cover every digit, @ and spelled-out sign with its context."""
    triggers = np.flatnonzero(((chars >= 48) & (chars <= 57)) | (chars == 64))
    words = [m.start() + i for m in CUES.finditer(np.minimum(chars, 127).astype(np.uint8).tobytes()) for i in (0, m.end() - m.start() - 1)]
    if words:
        triggers = np.union1d(triggers, words)
    if not len(triggers):
        return triggers
    first = np.maximum(triggers - CONTEXT - STRIDE, 0) // STRIDE
    last = (triggers + CONTEXT) // STRIDE
    # numbers of windows, each reaching over the next one's first half
    wanted = np.unique(np.concatenate([first + i for i in range(int((last - first).max()) + 1)]))
    return wanted[wanted * STRIDE < len(chars)] * STRIDE


def tags_of(spans: list[Span], size: int) -> np.ndarray:
    """0 outside, 2k + 1 where a span of kind k begins, 2k + 2 within it."""
    tags = np.zeros(size, np.int64)
    for kind, start, end in spans:
        k = 2 * KINDS.index(kind)
        if not tags[start:end].any():
            tags[start:end] = k + 2
            tags[start] = k + 1
    return tags


N_TAGS = 2 * len(KINDS) + 1
PAD = CHARS - 1


@dataclass
class Tagger:
    """Parameters: embedding, two LSTMs, output layer, CRF transitions and starts; least probability of a span of each kind."""

    p: dict[str, np.ndarray]
    least: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 0) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"embed": r.normal(0, 0.3, (CHARS, EMBED))}
        for side in ("f", "b"):
            p[f"{side}w"] = r.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
            p[f"{side}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["out"], p["bias"] = r.normal(0, 0.2, (2 * HIDDEN, N_TAGS)), np.zeros(N_TAGS)
        p["move"], p["begin"] = np.zeros((N_TAGS, N_TAGS)), np.zeros(N_TAGS)
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Scores (window, place, tag), and what the backward pass needs."""
        embedded = self.p["embed"][x]
        sides, kept = [], []
        for side, order in (("f", 1), ("b", -1)):
            states, memory = lstm(embedded[:, ::order], self.p[f"{side}w"], self.p[f"{side}c"])
            sides.append(states[:, ::order])
            kept.append(memory)
        both = np.concatenate(sides, axis=2)
        return both @ self.p["out"] + self.p["bias"], [embedded, kept, both]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tag sequence of each window, and the probability of each of its tags."""
        scores, _ = self.emissions(x)
        probabilities, _, _ = forward_backward(scores, self.p["move"], self.p["begin"])
        best = viterbi(scores, self.p["move"], self.p["begin"])
        return best, np.take_along_axis(probabilities, best[:, :, None], 2)[:, :, 0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list]:
    n, steps, _ = x.shape
    h, s = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    states, memory = np.empty((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        joint = np.concatenate([x[:, t], h], axis=1)
        z = joint @ w + c
        i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, s = s, f * s + i * g
        squashed = np.tanh(s)
        h = o * squashed
        states[:, t] = h
        memory.append((joint, i, f, o, g, before, squashed))
    return states, memory


def lstm_back(grad: np.ndarray, memory: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, steps, _ = grad.shape
    dw, dc, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.empty((n, steps, EMBED), np.float32)
    dh, ds = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        joint, i, f, o, g, before, squashed = memory[t]
        dh = dh + grad[:, t]
        ds = ds + dh * o * (1 - squashed**2)
        dz = np.concatenate([ds * g * i * (1 - i), ds * before * f * (1 - f), dh * squashed * o * (1 - o), ds * i * (1 - g**2)], axis=1)
        dw += joint.T @ dz
        dc += dz.sum(axis=0)
        back = dz @ w.T
        dx[:, t], dh, ds = back[:, :EMBED], back[:, EMBED:], ds * f
    return dx, dw, dc


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(scores: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tag probabilities, expected transitions, and the log partition of each window."""
    n, steps, _ = scores.shape
    ahead = np.empty_like(scores)
    ahead[:, 0] = begin + scores[:, 0]
    for t in range(1, steps):
        ahead[:, t] = log_sum(ahead[:, t - 1, :, None] + move, 1) + scores[:, t]
    total = log_sum(ahead[:, -1], 1)
    behind = np.zeros_like(scores)
    expected = np.zeros((N_TAGS, N_TAGS), np.float64)
    for t in reversed(range(steps - 1)):
        onward = scores[:, t + 1] + behind[:, t + 1]
        behind[:, t] = log_sum(move + onward[:, None, :], 2)
        expected += np.exp(ahead[:, t, :, None] + move + onward[:, None, :] - total[:, None, None]).sum(axis=0)
    return np.exp(ahead + behind - total[:, None, None]), expected, total


def viterbi(scores: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    n, steps, _ = scores.shape
    best = begin + scores[:, 0]
    back = np.empty((n, steps, N_TAGS), np.int64)
    for t in range(1, steps):
        reach = best[:, :, None] + move
        back[:, t] = reach.argmax(axis=1)
        best = reach.max(axis=1) + scores[:, t]
    path = np.empty((n, steps), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Tagger:
    """Adam on the CRF's negative log-likelihood of windows x with tags y."""
    tagger = Tagger.new(seed)
    p = tagger.p
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    random, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for start in range(0, len(order), 64):
            some = order[start : start + 64]
            xs, ys = x[some], y[some]
            scores, (embedded, kept, both) = tagger.emissions(xs)
            probabilities, expected, _ = forward_backward(scores, p["move"], p["begin"])
            d = probabilities.copy()
            np.put_along_axis(d, ys[:, :, None], np.take_along_axis(d, ys[:, :, None], 2) - 1, 2)
            d /= len(some)
            seen = np.zeros((N_TAGS, N_TAGS))
            np.add.at(seen, (ys[:, :-1], ys[:, 1:]), 1)
            g = {"move": (expected - seen) / len(some), "begin": d[:, 0].sum(axis=0), "bias": d.sum(axis=(0, 1))}
            g["out"] = np.tensordot(both, d, ([0, 1], [0, 1]))
            dboth = d @ p["out"].T
            dx_f, g["fw"], g["fc"] = lstm_back(dboth[:, :, :HIDDEN], kept[0], p["fw"])
            dx_b, g["bw"], g["bc"] = lstm_back(dboth[:, ::-1, HIDDEN:], kept[1], p["bw"])
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], xs, dx_f + dx_b[:, ::-1])
            step += 1
            for k in p:
                grad = np.clip(g[k], -1, 1).astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tagger


def cut_windows(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([chars, np.full(WINDOW, PAD)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def spans_of(chosen: np.ndarray, level: np.ndarray) -> list[tuple[Span, float]]:
    """Spans of a tag sequence, each with the mean probability of its characters' tags."""
    kind = np.where(chosen > 0, (chosen + 1) // 2, 0)
    starting = np.concatenate([[True], (kind[1:] != kind[:-1]) | (chosen[1:] % 2 == 1)]) & (kind > 0) if len(chosen) else np.zeros(0, bool)
    out = []
    for start in np.flatnonzero(starting).tolist():
        end = start + 1
        while end < len(chosen) and kind[end] == kind[start] and not starting[end]:
            end += 1
        out.append(((KINDS[kind[start] - 1], start, end), float(level[start:end].mean())))
    return out


def reconcile(size: int, starts: np.ndarray, tags: np.ndarray, sure: np.ndarray, least: dict[str, float]) -> list[Span]:
    """Spans over a whole text: of overlapping windows each character follows the one it lies deepest in."""
    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    # windows are STRIDE apart, so a character lies in two at most: odd and even ones
    chosen, best, level = np.zeros(size + WINDOW, np.int64), np.full(size + WINDOW, -1), np.zeros(size + WINDOW)
    for parity in (0, 1):
        some = np.flatnonzero(starts // STRIDE % 2 == parity)
        where = (starts[some][:, None] + np.arange(WINDOW)).ravel()
        deep = np.tile(depth, len(some))
        better = deep > best[where]
        at = where[better]
        chosen[at], best[at], level[at] = tags[some].ravel()[better], deep[better], sure[some].ravel()[better]
    return [span for span, mean in spans_of(chosen[:size], level[:size]) if mean >= least.get(span[0], np.inf)]


LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 7}


def plausible(text: str, span: Span) -> bool:
    kind, start, end = span
    body = text[start:end]
    return len(DIGITS.findall(body)) >= LEAST_DIGITS[kind] and (kind != "email" or "@" in body[1:-1] or SPELLED.search(body) is not None)


def added_spans(texts: list[tuple[str, list[Span]]], tagger: Tagger) -> list[list[Span]]:
    """What the tagger finds outside the base spans, for each text; windows of all texts run together."""
    chars = [codes(t) for t, _ in texts]
    starts = [window_starts(c) for c in chars]
    total = sum(map(len, starts))
    if not total:
        return [[] for _ in texts]
    windows = np.concatenate([cut_windows(c, s) for c, s in zip(chars, starts)])
    tags, sure = np.empty((total, WINDOW), np.int64), np.empty((total, WINDOW))
    for a in range(0, total, BATCH):
        tags[a : a + BATCH], sure[a : a + BATCH] = tagger.decode(windows[a : a + BATCH])
    out, at = [], 0
    for (text, base), c, s in zip(texts, chars, starts):
        found = reconcile(len(c), s, tags[at : at + len(s)], sure[at : at + len(s)], tagger.least)
        at += len(s)
        taken = np.zeros(len(c) + 1, bool)
        for _, a, b in base:
            taken[a:b] = True
        out.append([x for x in found if not taken[x[1] : x[2]].any() and plausible(text, x)])
    return out


WORD = re.compile(r"[A-Za-z]{2,12}")
ENDINGS = ("com", "org", "net", "edu", "io", "de", "co")


def varied(kind: str, body: str, near: str, r: random.Random) -> str:
    """A base span in a form that the patterns do not read; addresses also with names from the words near them."""
    digits = "".join(DIGITS.findall(body))
    if kind == "email":
        local, _, host = body.partition("@")
        if (words := WORD.findall(near)) and r.random() < 0.7:
            local = r.choice(["", ".", "_"]).join(r.choices(words, k=r.randint(1, 2))) + r.choice(["", "", str(r.randint(0, 99))])
            host = ".".join([*r.choices(words, k=r.choice([1, 1, 2])), r.choice(ENDINGS)])
        at, dot = r.choice([(" at ", " dot "), (" AT ", " DOT "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" at ", "."), ("[at]", "."), (" (at) ", ".")])
        return (local.replace(".", dot) if r.random() < 0.5 else local) + at + host.replace(".", dot)
    if kind == "ip":
        return r.choice(["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)"]).join(body.split("."))
    if kind == "card":
        return r.choice([".", "_", "/", "  ", " - ", "--"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, middle, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    mark = r.choice([" ", "-", ".", "/"])
    number = r.choice([mark.join((area, middle, last)), f"({area}) {middle}{mark}{last}", f"({area}){middle}-{last}"])
    return r.choice(["", "", f"{digits[:-10]}{mark}", f"00{digits[:-10]}{mark}"] if len(digits) > 10 else [""]) + number


def harmless(r: random.Random) -> str:
    """A number, date or phrase that holds a cue but nothing personal."""
    n = lambda a, b: r.randint(a, b)
    return r.choice([
        str(n(0, 10 ** n(1, 9))), f"{n(1900, 2040)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28)}/{n(1, 12)}/{n(1900, 2040)}", f"{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}",
        f"{n(0, 9999)}.{n(0, 99)}", f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", "look at the dot", "a dot on the map", "dot by dot", "the dot", "at noon", f"{n(1900, 2040)}-{n(1900, 2040)}",
    ])


def replaced(text: str, span: Span, new: str, kind: str | None, r: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """A window and its tags where a span has been replaced; without a kind the new words are no span."""
    _, start, end = span
    left = text[max(0, start - 2 * WINDOW) : start]
    whole = left + new + text[end : end + 2 * WINDOW]
    body = (len(left), len(left) + len(new))
    others = [s for s in base_spans(whole) if s[2] <= body[0] or s[1] >= body[1]]
    tags = tags_of([*([(kind, *body)] if kind else []), *others], len(whole))
    at = max(0, body[0] - r.randint(0, max(0, WINDOW - len(new))))
    return cut_windows(codes(whole), np.array([at]))[0], np.concatenate([tags, np.zeros(WINDOW, np.int64)])[at : at + WINDOW]


CLEAN, LABELLED, VARIED = range(3)


def sample(docs: DataFrame, doc: str, text: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``limit`` windows around cues with their tags and groups, those first by a hash of text, id and place.

    A third each: windows without any span, windows with base spans, and
    windows where a base span is written in another form.  Windows that hold what
    looks like such a form in the text itself are not taken as clean.
    """
    share = max(1, limit // 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = [{}, {}, {}]
        bounds = [1 << 63] * 3

        def offer(group: int, order: int, x: np.ndarray, y: np.ndarray) -> None:
            best = kept[group]
            best[order] = (x.astype(np.uint8).tobytes(), y.astype(np.uint8).tobytes())
            if len(best) >= 2 * share:
                kept[group] = dict(sorted(best.items())[:share])
                bounds[group] = max(kept[group])

        def orders_of(order: int, places: np.ndarray, group: int) -> np.ndarray:
            seed = np.uint64(order & (1 << 64) - 1) + np.uint64(group)
            return mix(mix(places.astype(np.uint64) + seed) * STEP + np.uint64(1)) >> np.uint64(1)

        for batch in batches:
            for order, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                c = codes(t)
                starts = window_starts(c)
                if not len(starts):
                    continue
                spans = base_spans(t)
                tags = np.concatenate([tags_of(spans, len(c)), np.zeros(WINDOW, np.int64)])
                inside = np.concatenate([[0], np.cumsum(tags > 0)])
                group_of = (inside[starts + WINDOW] > inside[starts]).astype(int)
                orders = orders_of(order, starts, CLEAN)
                for group in (CLEAN, LABELLED):
                    for i in np.flatnonzero((group_of == group) & (orders < np.uint64(bounds[group]))).tolist():
                        a = int(starts[i])
                        near = t[max(0, a - STRIDE) : a + WINDOW + STRIDE]
                        if group == LABELLED or not (SPELLED.search(near) or GROUPED.search(near)):
                            offer(group, int(orders[i]), cut_windows(c, starts[i : i + 1])[0], tags[a : a + WINDOW])
                if spans:
                    places = np.array([s[1] for s in spans])
                    for group in (CLEAN, VARIED):
                        own = orders_of(order, places, VARIED + group)
                        for i in np.flatnonzero(own < np.uint64(bounds[group])).tolist():
                            r = random.Random(int(own[i]))
                            kind, start, end = spans[i]
                            new = varied(kind, t[start:end], t[max(0, start - 200) : start], r) if group == VARIED else harmless(r)
                            x, y = replaced(t, spans[i], new, kind if group == VARIED else None, r)
                            if group == VARIED or not y.any():
                                offer(group, int(own[i]), x, y)
        for group, best in enumerate(kept):
            if best:
                first = sorted(best.items())[:share]
                yield pa.record_batch({
                    "part": pa.array([group] * len(first), pa.int32()), "order": pa.array([k for k, _ in first], pa.int64()),
                    "x": pa.array([x for _, (x, _) in first], pa.binary()), "y": pa.array([y for _, (_, y) in first], pa.binary()),
                })

    rows = docs.select(F.xxhash64(F.col(text), F.col(doc)).alias("order"), F.col(text).cast("string").alias("text"))
    found = staged(rows.mapInArrow(run, "part int, order long, x binary, y binary"), "windows")  # at most ``limit`` rows of each task
    xs, ys, groups = [], [], []
    for group in (CLEAN, LABELLED, VARIED):
        some = found.where(F.col("part") == group).select("order", "x", "y").distinct().orderBy("order", "x", "y").limit(share).toArrow()
        xs += some["x"].to_pylist()
        ys += some["y"].to_pylist()
        groups += [group] * some.num_rows
    x, y = (np.array([np.frombuffer(b, np.uint8) for b in rows], np.int64).reshape(-1, WINDOW) for rows in (xs, ys))
    return x, y, np.array(groups, np.int64)


def least_probability(tagger: Tagger, x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Per kind the lowest probability from which spans of held-out windows are right: none in clean ones, RIGHT_SHARE of all."""
    found: dict[str, list] = {kind: [] for kind in KINDS}
    for a in range(0, len(x), BATCH):
        for tags, sure, want in zip(*tagger.decode(x[a : a + BATCH]), y[a : a + BATCH]):
            for (kind, start, end), mean in spans_of(tags, sure):
                k = 2 * KINDS.index(kind)
                found[kind].append((mean, bool(np.isin(want[start:end], (k + 1, k + 2)).any()), bool(want.any())))
    least = {}
    for kind, spans in found.items():
        right = 0
        for n, (mean, good, labelled) in enumerate(sorted(spans, reverse=True), 1):
            if not labelled:
                break
            right += good
            if right >= RIGHT_SHARE * n:
                least[kind] = mean
    return least


def fit(x: np.ndarray, y: np.ndarray, group: np.ndarray) -> Tagger | None:
    """Train on four fifths of the windows; the clean and the varied ones of the rest set the least probability."""
    if not y.any():
        return None
    held = np.arange(len(x)) % HELD_OUT == HELD_OUT - 1
    tagger = train(x[~held], y[~held])
    held &= group != LABELLED  # the patterns find those themselves
    tagger.least = least_probability(tagger, x[held], y[held])
    return tagger


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text", into: str = "found", train_windows: int = TRAIN_WINDOWS) -> DataFrame:
    """Add a struct with the ``base`` spans and all ``spans`` (kind, start, end) of every whole text.

    The tagger is trained on at most ``train_windows`` windows: clean ones, ones
    labelled by the base spans, and ones where a base span is written in another form
    (see ``varied``).  Overlapping windows over all digits, @ signs and spelled-out
    signs with their context are decoded, reconciled over the text, and spans
    outside the base ones are added from the probability that the windows held out
    of training give.  Ends are exclusive, in code points.

    NULL and empty texts have no spans.  Repeated rows are searched each.  Without any
    labelled window nothing is added.  Other columns pass through; one named like
    ``into`` is replaced.
    """
    spark = ready(docs.sparkSession)
    tagger = spark.sparkContext.broadcast(fit(*sample(docs, doc, text, train_windows)))

    @arrow_udf(RESULT)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list = [{"base": [], "spans": []}] * len(texts)
            for i, _, base, every in found_spans(texts, tagger.value):
                out[i] = {name: [dict(zip(("kind", "start", "end"), s)) for s in spans] for name, spans in (("base", base), ("spans", every))}
            yield pa.array(out, RESULT_KIND)

    return with_result(docs, into, search(F.col(text).cast("string")))


def found_spans(texts: pa.Array, tagger: Tagger | None) -> Iterator[tuple[int, str, list[Span], list[Span]]]:
    """Number, body, base spans and all spans of each text that has a digit, an @ or a spelled-out sign."""
    data, offsets = utf8(texts)
    trigger = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    spelled = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, CUE_WORDS), False).to_numpy(zero_copy_only=False))
    hot = np.union1d(np.searchsorted(offsets, trigger, "right") - 1, spelled).tolist()
    found = []
    for i in hot:
        body = data[offsets[i] : offsets[i + 1]].tobytes().decode()
        found.append((body, base_spans(body)))
    more = added_spans(found, tagger) if tagger is not None else [[]] * len(found)
    for i, (body, base), extra in zip(hot, found, more):
        yield i, body, base, sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))


def covered(body: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first shows its kind."""
    parts, at = [], 0
    for kind, start, end in spans:
        if end <= at:
            continue
        if start >= at:
            parts += [body[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, body[at:]])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: str | None = "n_chars", train_windows: int = TRAIN_WINDOWS) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; ``length`` follows the text.

    Found and covered in one pass over the texts.  NULL and empty texts, and texts without
    spans, stay as they are; repeated rows are covered each; an empty table stays empty.
    Texts of any length are read whole.  Other columns pass through, whatever their names.
    """
    spark = ready(docs.sparkSession)
    tagger = spark.sparkContext.broadcast(fit(*sample(docs, doc, text, train_windows)))
    name = fresh(docs, "_covered")

    @arrow_udf("string")
    def cover(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list = [None] * len(texts)  # a text without spans does not travel again
            for i, body, _, every in found_spans(texts, tagger.value):
                if every:
                    out[i] = covered(body, every)
            yield pa.array(out, pa.string())

    changed = docs.withColumn(name, cover(F.col(text).cast("string")))
    new = [F.coalesce(name, F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if length in docs.columns:
        size = F.when(F.col(name).isNotNull(), F.length(name).cast(docs.schema[length].dataType)).otherwise(F.col(f"`{length}`"))
        new[docs.columns.index(length)] = size.alias(length)
    return changed.select(*new)
