"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions trained in numpy.

The model is trained from labelled spans that a seeded generator writes, among them forms that the
patterns miss (telephone numbers without a plus, cards with dots, guarded addresses, and secrets
such as passwords and keys). Texts are read in overlapping windows; a span that goes on at a
window's edge is read again in a wider one. The spans that windows propose are reconciled by the
heaviest set of spans that don't overlap. All kinds hold a digit or an @, so that windows without
one hold no span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.kit import Texts, code_points, named, slices, texts_of

KINDS = ["email", "ip", "card", "phone"]
SECRET = len(KINDS)
# The base patterns.
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
# The same matches in one pass: a run of digits is entered at its start only, and nothing is given back. An address is found from its @.
_HOST = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ONE_PASS = [None, re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), re.compile(rb"[0-9]++(?:[\x20-][0-9]++)*+"), re.compile(PATTERNS[3].encode())]
#: Characters that a match of each kind consists of, and one that it must hold: a maximal run of them holds whole matches.
_ALPHABETS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@", b"0123456789.", b"0123456789 -", b"0123456789+ ().-"]
_MUST = [b"@", b".", b"0123456789", b"+"]

#: Window and step in bytes, what a wider window has before its span, and the widest window: no kind has longer spans.
WINDOW, STEP, BEFORE, WIDEST = 96, 48, 16, 4096
HIDDEN = 16
TAGS = 1 + 2 * (len(KINDS) + 1)
SEED, BATCH, LENGTH, UPDATES, RATE = 5, 96, 80, 480, 0.02


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind: int, text: str) -> bool:
    """The check of a base match."""
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in text.split("."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == 3 else True


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_IN = [_table(a) for a in _ALPHABETS]
_HAS = [_table(m) for m in _MUST]
_EVIDENCE = _table(b"0123456789@")


def _addresses(run: bytes) -> Iterator[tuple[int, int]]:
    """Matches of the first pattern in a run of its alphabet: before an @ stands all since the last one, or since the last match."""
    free, at = 0, run.find(b"@")
    while at >= 0:
        host = _HOST.match(run, at + 1)
        if free < at and host:
            yield free, host.end()
            free = host.end()
            at = run.find(b"@", free)
            continue
        free, at = at + 1, run.find(b"@", at + 1)


def base_spans(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of one text's bytes, in bytes: leftmost matches that don't overlap, of each kind, less those that fail its check. Time grows with the text's length alone."""
    found = []
    for kind, pattern in enumerate(_ONE_PASS):
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _IN[kind][data]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_HAS[kind][data], out=sums[1:])
        for a, b in zip(starts[keep := sums[ends] > sums[starts]], ends[keep], strict=True):
            run = data[a:b].tobytes()
            for start, end in _addresses(run) if pattern is None else (m.span() for m in pattern.finditer(run)):
                if passes(kind, run[start:end].decode("ascii")):
                    found.append((kind, int(a) + start, int(a) + end))
    return found


# The model's alphabet: a class for each letter whatever its case, for digits, for signs, and for all else.
_SIGNS = "@.-_+()[] \n:/=\"',*#|%"
_CLASS = np.full(256, 26 + 1 + len(_SIGNS), np.int64)
for _i in range(26):
    _CLASS[0x41 + _i] = _CLASS[0x61 + _i] = _i
_CLASS[0x30:0x3A] = 26
for _i, _c in enumerate(_SIGNS):
    _CLASS[ord(_c)] = 27 + _i
_CLASS[0x80:] = 26 + 2 + len(_SIGNS)
CLASSES = 26 + 3 + len(_SIGNS)


def labelled(rng: np.random.Generator, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded texts with labelled spans, as character classes and tags (0: outside, 1 + 2k: begin of kind k, 2 + 2k: inside)."""
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda x: x[rng.integers(len(x))]

    def card() -> str:
        body = digits(15)
        full = body + str(next(d for d in range(10) if luhn(body + str(d))))
        return pick(["", " ", "-", ".", "/"]).join(full[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        name = word() + pick(["", "", ".", "_", "."]) + pick(["", word(), digits(2)])
        host = word() + pick(["", digits(1), "-" + word()]) + "." + pick(["com", "org", "net", "de", "example.com", "example.org", "co.uk"])
        return name + pick(["@", "@", "@", " @ "]) + host

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{digits(rng.integers(1, 3))} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(11)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}"])

    def ip() -> str:
        return pick([".", ".", ".", "[.]"]).join(str(x) for x in rng.integers(0, 256, 4))

    def drawn(alphabet: str, low: int, high: int) -> str:
        return "".join(alphabet[c] for c in rng.integers(0, len(alphabet), rng.integers(low, high)))

    def secret() -> tuple[str, str, str]:
        """What stands before a secret, the secret, and what stands after it."""
        upper, small, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
        if rng.random() < 0.35:
            return "", pick(["AK" + drawn(upper, 16, 20), "AKIA" + drawn(upper, 16, 17), "sk-" + drawn(small + upper, 20, 33), "ghp_" + drawn(small + upper, 24, 37)]), ""
        name = pick(["token", "password", "passwd", "secret", "api_key", "key", "pwd", "auth", word() + "_token"])
        quote = pick(["", "", '"', "'"])
        return name + pick(["=", " = ", ": ", ":", "="]) + quote, pick([drawn(hexes, 16, 41), drawn(hexes, 16, 24), drawn(small + upper, 12, 33)]), quote

    def other() -> str:
        return pick([f"commit {drawn('0123456789abcdef', 7, 10)}", f"ISBN 978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"1Z {digits(3)} {digits(4)} {digits(4)}", f"no. {digits(3)} {digits(4)} {digits(4)}", f"order {digits(10)}", f"{word()}={digits(3)}", f"{word()} = {word()}", f"{digits(8)}", word().upper() + digits(3), f"CC BY-NC {rng.integers(1, 5)}.0", f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", digits(rng.integers(1, 8)), f"{digits(1)},{digits(3)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"page {digits(2)}", word() + digits(2), f"{digits(2)} {word()}", f"@{word()}", f"{digits(3)}-{digits(4)}"])

    makers = [email, ip, card, phone]
    xs, ys = np.empty((n, length), np.int64), np.zeros((n, length), np.int64)
    for i in range(n):
        text, tags = "", []
        while len(text) < length + 24:
            u = rng.random()
            if u < 0.07:
                head, s, end = secret()
                tags += [0] * len(head) + [1 + 2 * SECRET] + [2 + 2 * SECRET] * (len(s) - 1) + [0] * len(end)
                s = head + s + end
            elif u < 0.28:
                k = int(rng.integers(len(makers)))
                s = makers[k]()
                tags += [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1)
            else:
                s = other() if u < 0.42 else word().upper() if u < 0.47 else word()
                tags += [0] * len(s)
            gap = pick([" ", " ", " ", " ", " ", ", ", ". ", "\n", "*** ", "!! ", " | "])
            text, tags = text + s + gap, tags + [0] * len(gap)
        cut = int(rng.integers(0, 24))
        xs[i] = _CLASS[np.frombuffer(text.encode(), np.uint8)[cut : cut + length]]
        ys[i] = tags[cut : cut + length]
        if ys[i, 0] and ys[i, 0] % 2 == 0:  # a span that the cut went through is no span of its own
            j = 0
            while j < length and ys[i, j] and ys[i, j] % 2 == 0:
                ys[i, j] = 0
                j += 1
    return xs, ys


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool = False):
    """Hidden states of a batch of class sequences (length, batch), and what the gradient needs."""
    n, h = x.shape[1], wh.shape[0]
    gates = wx[x]
    out = np.empty((len(x), n, h), np.float32)
    hidden, cell, past = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
    for t in range(len(x)):
        z = gates[t] + hidden @ wh
        s = _sigmoid(z[:, : 3 * h])
        g = np.tanh(z[:, 3 * h :])
        i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
        before = cell
        cell = f * before + i * g
        c = np.tanh(cell)
        hidden = o * c
        out[t] = hidden
        if keep:
            past.append((i, f, o, g, before, c))
    return out, past


def lstm_gradient(x: np.ndarray, wh: np.ndarray, out: np.ndarray, past: list, d_out: np.ndarray):
    h = wh.shape[0]
    d_gates = np.empty((*x.shape, 4 * h), np.float32)
    d_hidden = np.zeros_like(out[0])
    d_cell = np.zeros_like(out[0])
    d_wh = np.zeros_like(wh)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, c = past[t]
        d = d_out[t] + d_hidden
        d_cell = d_cell + d * o * (1 - c * c)
        dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d * c * o * (1 - o), d_cell * i * (1 - g * g)], axis=1)
        d_gates[t] = dz
        if t:
            d_wh += out[t - 1].T @ dz
        d_hidden = dz @ wh.T
        d_cell = d_cell * f
    d_wx = np.zeros((CLASSES, 4 * h), np.float32)
    np.add.at(d_wx, x.reshape(-1), d_gates.reshape(-1, 4 * h))
    return d_wx, d_wh


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray):
    """The mean negative log likelihood of tags (length, batch), and its gradients in scores and moves."""
    length, n, k = scores.shape
    a = np.empty_like(scores)
    b = np.zeros_like(scores)
    a[0] = scores[0]
    for t in range(1, length):
        a[t] = scores[t] + _logsum(a[t - 1][:, :, None] + moves, 1)
    for t in range(length - 2, -1, -1):
        b[t] = _logsum(moves + (scores[t + 1] + b[t + 1])[:, None, :], 2)
    total = _logsum(a[-1], 1)
    d_scores = np.exp(a + b - total[:, None])
    pairs = np.exp(a[:-1, :, :, None] + moves + (scores[1:] + b[1:])[:, :, None, :] - total[:, None, None]).sum((0, 1))
    rows = np.arange(n)
    gold = sum(scores[t, rows, tags[t]].sum() for t in range(length)) + moves[tags[:-1], tags[1:]].sum()
    for t in range(length):
        d_scores[t, rows, tags[t]] -= 1
    np.add.at(pairs, (tags[:-1].reshape(-1), tags[1:].reshape(-1)), -1)
    return float((total.sum() - gold) / n), d_scores / n, pairs / n


@dataclass(frozen=True)
class Model:
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores of class sequences (length, batch)."""
        w = self.weights
        ahead, _ = lstm(x, w["fx"], w["fh"])
        back, _ = lstm(x[::-1], w["bx"], w["bh"])
        return np.concatenate([ahead, back[::-1]], axis=2) @ w["out"] + w["bias"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (length, batch), and how much each character's score gains over outside."""
        scores, moves = self.scores(x), self.weights["moves"]
        best, from_ = scores[0].copy(), np.empty(scores.shape, np.int8)
        for t in range(1, len(x)):
            every = best[:, :, None] + moves
            from_[t] = every.argmax(1)
            best = np.take_along_axis(every, from_[t][:, None, :].astype(np.int64), 1)[:, 0] + scores[t]
        tags = np.empty(x.shape, np.int64)
        tags[-1] = best.argmax(1)
        for t in range(len(x) - 1, 0, -1):
            tags[t - 1] = from_[t][np.arange(x.shape[1]), tags[t]]
        gain = np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0] - scores[:, :, 0]
        return tags, gain


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model, trained on the driver by Adam on seeded batches; always the same."""
    rng = np.random.default_rng(SEED)
    h = HIDDEN
    draw = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
    w = {"fx": draw(CLASSES, 4 * h), "fh": draw(h, 4 * h), "bx": draw(CLASSES, 4 * h), "bh": draw(h, 4 * h), "out": draw(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32)}
    for name in ("fx", "bx"):
        w[name][:, h : 2 * h] += 1  # remember at first
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, UPDATES + 1):
        xs, ys = labelled(rng, BATCH, LENGTH)
        x, y = xs.T, ys.T
        ahead, past = lstm(x, w["fx"], w["fh"], True)
        back, past_b = lstm(x[::-1], w["bx"], w["bh"], True)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        _, d_scores, d_moves = crf_gradient(both @ w["out"] + w["bias"], w["moves"], y)
        d_both = d_scores @ w["out"].T
        g = {"out": both.reshape(-1, 2 * h).T @ d_scores.reshape(-1, TAGS), "bias": d_scores.sum((0, 1)), "moves": d_moves}
        g["fx"], g["fh"] = lstm_gradient(x, w["fh"], ahead, past, d_both[:, :, :h])
        g["bx"], g["bh"] = lstm_gradient(x[::-1], w["bh"], back, past_b, d_both[::-1, :, h:])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (UPDATES + 1)))
        for k in w:
            d = g[k] * min(1.0, 5 / (norm + 1e-6))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    moves = w["moves"].copy()
    for tag in range(2, TAGS, 2):  # inside follows begin or inside of its kind only
        moves[[t for t in range(TAGS) if t not in (tag, tag - 1)], tag] = -1e4
    return Model(w | {"moves": moves})


def plausible(kind: int, text: str) -> bool:
    """What a span of the model must be besides: the check of its kind on its digits, or an address with a host."""
    digits = re.sub("[^0-9]", "", text)
    if kind == SECRET:
        return bool(re.fullmatch(r"[A-Za-z0-9_+/=-]{12,}", text)) and len(set(text)) >= 7 and bool(digits) and bool(re.search("[A-Za-z]", text))
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text))
    if kind == 1:
        parts = re.split(r"\[?\.\]?", text)
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", text)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9(][0-9 ().-]*[0-9]", text)) and bool(re.search(r"[ ().-]", text))


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans (kind, start, end, weight) that windows propose, the set without overlaps of the largest total weight."""
    spans = sorted(set(spans), key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best: list[float] = [0.0]
    take = []
    for kind, start, _, weight in spans:
        before = min(bisect_right(ends, start), len(best) - 1)
        with_it = best[before] + weight
        take.append((with_it > best[-1], before))
        best.append(max(best[-1], with_it))
    out, i = [], len(spans)
    while i:
        if take[i - 1][0]:
            out.append(spans[i - 1][:3])
            i = take[i - 1][1]
        else:
            i -= 1
    return out[::-1]


def windows_of(data: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold evidence; windows lie a step apart over the whole text."""
    last = max(0, -(-(len(data) - WINDOW) // STEP))
    at = np.unique(np.concatenate([evidence // STEP - k for k in range(WINDOW // STEP)]))
    return at[(at >= 0) & (at <= last)] * STEP


def model_spans(model: Model, datas: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans (kind, start, end in bytes) of each text."""
    proposed: list[list] = [[] for _ in datas]
    wanted = [(i, int(at)) for i, data in enumerate(datas) for at in windows_of(data, np.flatnonzero(_EVIDENCE[data]))]
    width, reached = WINDOW, [0] * len(datas)
    while wanted:
        cut = []
        many = max(1, 2048 * WINDOW // width)
        for a in range(0, len(wanted), many):
            some = wanted[a : a + many]
            rows = np.full((len(some), width), _CLASS[0x20], np.int64)
            for row, (i, at) in zip(rows, some, strict=True):
                part = datas[i][at : at + width]
                row[: len(part)] = _CLASS[part]
            tags, gain = model.decode(rows.T)
            for j, t in zip(*np.nonzero((tags % 2 == 1).T), strict=True):
                kind, e = (tags[t, j] - 1) // 2, t + 1
                while e < width and tags[e, j] == tags[t, j] + 1:
                    e += 1
                i, at = some[j]
                if e - t < 2 or (t == 0 and at > 0):
                    continue
                if e < width or at + e >= len(datas[i]):
                    proposed[i].append((int(kind), at + int(t), min(at + int(e), len(datas[i])), round(float(gain[t:e, j].sum()), 3)))
                elif width > WINDOW or t <= STEP:  # the span goes on, and the next window does not see its begin
                    cut.append((i, at + int(t)))
        width, wanted = 2 * width, []
        for i, start in sorted(set(cut)) if width <= WIDEST else []:
            at = max(0, start - BEFORE)
            if not wanted or wanted[-1][0] != i or start >= reached[i]:
                wanted.append((i, at))
                reached[i] = at + width - BEFORE
        reached = [0] * len(datas)
    return [reconciled(s) for s in proposed]


def spans_of(model: Model, texts: Texts) -> list[tuple[list, list, list]]:
    """Of each text: base spans, all spans of KINDS, and secrets, (kind, start, end) in code points, by kind and start."""
    out: list[tuple[list, list, list]] = [([], [], [])] * len(texts)
    sums = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_EVIDENCE[texts.data], out=sums[1:])
    some = np.flatnonzero(sums[texts.ends] > sums[texts.starts])
    datas = [texts.data[texts.starts[i] : texts.ends[i]] for i in some]
    for i, data, more in zip(some, datas, model_spans(model, datas), strict=True):
        base = base_spans(data)
        points = code_points(data)
        inside = np.zeros(len(data) + 1, np.int64)
        for _, a, b in base:
            inside[a + 1 : b + 1] = 1
        np.cumsum(inside, out=inside)
        extra = [(k, a, b) for k, a, b in more if inside[b] == inside[a] and plausible(k, data[a:b].tobytes().decode("utf-8", "replace"))]
        place = lambda spans, points=points: sorted((k, int(points[a]), int(points[b])) for k, a, b in spans)
        out[i] = (place(base), place(base + [s for s in extra if s[0] < SECRET]), place(s for s in extra if s[0] == SECRET))
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{[*KINDS, 'secret'][k]}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep`, n_ of each kind (base spans), `base`, `spans` and `secrets` (kind:start:end, comma-joined), n_secret, and n_all (spans and secrets).

    A null or empty text has no spans. Very long texts are read whole, in windows, in time that
    grows with their length. Repeated rows are read each; an empty table gives an empty table.
    Overlapping spans of different kinds in the base all stay; the model adds only spans that
    overlap none, and of its own the heaviest set; of equal weights, that with the later end.
    """
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [x for _, _, part in slices(texts_of(batch.column(0))) for x in spans_of(model, part)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _, _ in found], pa.int64()) for k in range(len(KINDS))]
            texts = [pa.array([told(f[k]) for f in found], pa.string()) for k in range(3)]
            sizes = [pa.array([len(s) for _, _, s in found], pa.int64()), pa.array([len(a) + len(s) for _, a, s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), *counts, *texts, *sizes], [*batch.schema.names[1:], *[f"n_{k}" for k in KINDS], "base", "spans", "secrets", "n_secret", "n_all"])

    rows = df.select(F.col(text).alias("text__"), *[named(c) for c in keep])
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(emit, kinds + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, secrets string, n_secret long, n_all long")


def op1_pii(documents: DataFrame) -> DataFrame:
    """Personal data of every document, and secrets in columns of their own."""
    out = find(documents, keep=("doc_id",))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "secrets", "n_secret", "n_all")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
