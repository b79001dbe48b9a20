"""A hidden Markov language model, trained by Baum-Welch over partitions.

The commonest words are symbols of the model; every other word is one of a fixed number of classes
by its last letters, and has a probability within its class from its exact count. So the model is
bounded, while counts of all words of the corpus matter: those of the commonest go to every task,
all others are met by a shuffle join. A text's score is the exact likelihood of its whole sequence
by the scaled forward recursion, times the words' probabilities within their classes.

Texts are read twice: to count words, and to write each text's symbols, 2 bytes a token. Every
training step and the scores read these. Sequences are whole texts, in training as in scoring.
Expected counts are summed as integers, so that reruns agree whatever the order of tasks.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.kit import LONG_BYTES, LOWER, Texts, marked, mix, named, record, settled, signed, slices, texts_of, word_bounds, word_hashes, written

LOG = logging.getLogger(__name__)

STATES = 8
#: Words with symbols of their own, words whose exact counts go to every task, classes of the others.
SYMBOLS, HEAD, CLASSES = 8192, 1 << 16, 256
#: Baum-Welch steps at most, each over all training texts, and the gain in nats a token below which they end.
BAUM_WELCH_STEPS, LEAST_GAIN = 5, 1e-3
#: Tokens that are worked on together. A longer text is worked through in pieces of so many, exactly.
BLOCK = 150_000
#: Tokens of a sequence between two scalings.
SCALED = 16
#: Words that a task counts before it passes them on.
COUNTED = 1 << 20
#: Expected counts are summed in steps of 1 / UNIT.
UNIT = 1 << 16
END = np.uint64(0x5E1F_DA7A_0000_0E0D)


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each word and of an end after each text, and where each text's tokens begin."""
    starts, ends, first = word_bounds(texts)
    hashes = word_hashes(texts.data, starts, ends)
    suffix = np.zeros(len(starts), np.uint64)
    for k in range(1, 4):
        at = ends - k
        suffix = suffix * np.uint64(257) + np.where(at >= starts, LOWER[texts.data[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    classes = (mix(suffix) % np.uint64(CLASSES)).astype(np.int32)
    at_end = first[1:]
    first = first + np.arange(len(first))
    return np.insert(hashes, at_end, END), np.insert(classes, at_end, 0), first


@dataclass
class Vocabulary:
    """Counts of the head (sorted by hash; symbol -1: by class) and sums over all words."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int

    @property
    def size(self) -> int:
        return int(self.symbols.max(initial=-1)) + 1 + CLASSES

    def find(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its symbol, its count (0 outside the head), whether it is in the head."""
        if not len(self.hashes):
            return classes.astype(np.int32), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        own = np.where(known, self.symbols[at], -1)
        return np.where(own >= 0, own + CLASSES, classes).astype(np.int32), np.where(known, self.counts[at], 0), known


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(hash, class, count) of every token of all texts; a null text is empty and still ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def merged() -> tuple:
            words, index, inverse = np.unique(np.concatenate([k[0] for k in kept]), return_index=True, return_inverse=True)
            return words, np.concatenate([k[1] for k in kept])[index], np.bincount(inverse, np.concatenate([k[2] for k in kept]), len(words)).astype(np.int64)

        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                hashes, classes, _ = tokens_of(part)
                words, index, n = np.unique(hashes, return_index=True, return_counts=True)
                kept.append((words, classes[index], n))
            if sum(len(k[0]) for k in kept) > COUNTED:
                kept = [merged()]
                if len(kept[0][0]) > COUNTED // 2:
                    yield record(hash=signed(kept[0][0]), cls=kept[0][1], n=kept[0][2])
                    kept = []
        if kept:
            words, classes, n = merged()
            yield record(hash=signed(words), cls=classes, n=n)

    return df.select(text).mapInArrow(count, "hash long, cls int, n long").groupBy("hash").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))


def frequent(counted: DataFrame, most: int) -> int:
    """A count that at most `most` words reach, as many as can be. First by rough steps of the counts (some hundred rows come to the driver), then by the counts within one step."""
    rough = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(((r.step, r.words) for r in counted.groupBy(rough.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    held = 0
    for step, words in steps:
        if held + words > most:
            break
        held += words
    else:
        return 1
    within = sorted(((r.n, r.words) for r in counted.filter(rough == step).groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least = within[0][0] + 1
    for n, words in within:
        if held + words > most:
            break
        held, least = held + words, n
    return least


def vocabulary_of(counted: DataFrame) -> Vocabulary:
    """The words that are as frequent as the HEAD allows, but never a part of those that tie, and a row for each class come to the driver."""
    end = int(signed(np.array([END]))[0])
    top = counted.filter((F.col("n") >= frequent(counted, HEAD)) | (F.col("hash") == end)).collect()
    top.sort(key=lambda r: (r.hash != end, -r.n, r.hash))
    hashes = np.array([r.hash for r in top], np.int64).view(np.uint64)
    counts = np.array([r.n for r in top], np.int64)
    symbols = np.where(np.arange(len(top)) < SYMBOLS, np.arange(len(top)), -1)
    own = top[:SYMBOLS]
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    total = types = 0
    for r in counted.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r.cls], words[r.cls] = r.n, r.v
        total, types = total + r.n, types + r.v
    for r in own:
        tokens[r.cls] -= r.n
        words[r.cls] -= 1
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], counts[order], symbols[order].astype(np.int32), tokens, words, total, types)


def encoded(df: DataFrame, v: Vocabulary, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` and, of each text: n_tokens, the tokens in the head (known), the sum of their log counts (plain), the log probability of words within their classes as far as the head tells (inner), its symbols (2 bytes each) and the hashes of words outside the head (rare)."""
    shared = df.sparkSession.sparkContext.broadcast(v)
    within = np.log10(v.class_tokens + v.class_words + 1.0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for i, j, part in slices(texts_of(batch.column(0)), LONG_BYTES):
                hashes, classes, first = tokens_of(part)
                symbols, counts, known = v.find(hashes, classes)
                texts = len(first) - 1
                owner = np.repeat(np.arange(texts), np.diff(first))
                logs = np.log10(counts + 1.0)
                rare = np.flatnonzero(~known)
                cuts = np.searchsorted(rare, first).astype(np.int32)
                codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), texts, [None, pa.py_buffer(2 * first.astype(np.int64)), pa.py_buffer(symbols.astype("<u2"))])
                out = record(n_tokens=np.diff(first), known=np.bincount(owner, known, texts).astype(np.int64), plain=np.bincount(owner, logs, texts), inner=np.bincount(owner, np.where(symbols < CLASSES, logs - within[classes], 0.0), texts), symbols=codes.cast(pa.binary()), rare=pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(hashes[rare]))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(1, batch.num_columns)), *out.columns], [*batch.schema.names[1:], *out.schema.names])

    if v.size > 1 << 16:
        raise ValueError("SYMBOLS and CLASSES must fit 16 bits")
    rows = df.select(F.col(text).alias("text__"), *[named(c) for c in keep])
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(emit, f"{kinds}n_tokens long, known long, plain double, inner double, symbols binary, rare array<long>")


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts one after the other, and where each text's begin."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view("<u2"), (bounds - bounds[0]) // 2


@dataclass
class Model:
    """First-state, between-state and symbol probabilities, and the states' shares over all tokens."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    share: np.ndarray


def first_model(v: Vocabulary, seed: int = 7) -> Model:
    """Sticky states whose symbols deviate at random from the unigram shares."""
    rng = np.random.default_rng(seed)
    unigram = np.zeros(v.size)
    unigram[:CLASSES] = v.class_tokens
    own = v.symbols >= 0
    unigram[CLASSES + v.symbols[own]] = v.counts[own]
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()
    emit = unigram[:, None] * rng.gamma(1.0, 1.0, (v.size, STATES))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0), np.full(STATES, 1 / STATES))


class Steps:
    """Sequences side by side: token t of all sequences that have one stands together, longest sequences first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(longest), "left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(len(self.owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.offset[time] + rank[self.owner]
        self.longest = longest
        #: Where each sequence's last token stands, longest first.
        self.last = self.offset[sizes - 1] + np.arange(len(sizes)) if longest else np.zeros(0, np.int64)

    def laid(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.place] = values
        return out

    def at(self, t: int) -> slice:
        return slice(self.offset[t], self.offset[t + 1])


def ahead(move: np.ndarray, likely: np.ndarray, steps: Steps, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forward recursion, scaled every SCALED tokens: states' weights at each token, and by sequence, in the order of steps, the log likelihood and the states at its end."""
    alpha, logs = np.empty_like(likely), np.zeros(len(steps.order))
    offset, active = steps.offset.tolist(), steps.active.tolist()
    now = alpha[: active[0]]
    np.multiply(likely[: active[0]], begin, out=now)
    for t in range(1, steps.longest):
        n, at = active[t], offset[t]
        then = alpha[at : at + n]
        np.matmul(now[:n], move, out=then)
        then *= likely[at : at + n]
        if t % SCALED == 0:
            c = then.sum(1)
            logs[:n] += np.log(c)
            then /= c[:, None]
        now = then
    last = alpha[steps.last]
    c = last.sum(1)
    return alpha, logs + np.log(c), last / c[:, None]


def behind(move: np.ndarray, likely: np.ndarray, steps: Steps, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The backward recursion from `tail` at the ends: weights after each token, and these times the token's likelihood."""
    beta, both = np.empty_like(likely), np.empty_like(likely)
    beta[steps.last] = tail
    offset, active = steps.offset.tolist(), steps.active.tolist()
    back = np.ascontiguousarray(move.T)
    for t in range(steps.longest - 1, -1, -1):
        n, at = active[t], offset[t]
        here = both[at : at + n]
        np.multiply(likely[at : at + n], beta[at : at + n], out=here)
        if t:
            to = beta[offset[t - 1] : offset[t - 1] + n]
            np.matmul(here, back, out=to)
            if t % SCALED == 0:
                to /= to.sum(1)[:, None]
    return beta, both


def blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences in groups of about BLOCK tokens, longest first."""
    order = np.argsort(-lengths, kind="stable")
    upto = np.cumsum(lengths[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BLOCK, "right")))
        yield order[i:j]
        i = j


def _gathered(first: np.ndarray, lengths: np.ndarray, some: np.ndarray) -> np.ndarray:
    sizes = lengths[some]
    return np.arange(sizes.sum()) + np.repeat(first[some] - (np.cumsum(sizes) - sizes), sizes)


class Sums:
    """Expected counts of starts, moves and symbols by state, and the log likelihood of what was read."""

    def __init__(self, symbols: int):
        self.start, self.move, self.emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((symbols, STATES))
        self.log = 0.0

    def add(self, model: Model, laid: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> None:
        gamma = alpha * beta
        gamma /= gamma.sum(1)[:, None]
        for k in range(STATES):
            self.emit[:, k] += np.bincount(laid, gamma[:, k], len(self.emit))

    def moved(self, model: Model, before: np.ndarray, after: np.ndarray) -> None:
        z = ((before @ model.move) * after).sum(1)
        self.move += model.move * (before.T @ (after / z[:, None]))


def _scaled(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Emissions as multiples of their mean over states, so that they stay near 1, and the logarithms of the means."""
    mean = model.emit @ model.share
    return model.emit / mean[:, None], np.log(mean)


def expected_counts(model: Model, symbols: np.ndarray, first: np.ndarray) -> Sums:
    """Baum-Welch counts of whole texts."""
    sums, lengths = Sums(len(model.emit)), np.diff(first)
    emit, means = _scaled(model)
    sums.log = float(means[symbols].sum())
    for some in blocks(lengths):
        if lengths[some[0]] > BLOCK:
            _count_long(model, emit, symbols[first[some[0]] : first[some[0] + 1]], sums)
            continue
        steps = Steps(lengths[some])
        laid = steps.laid(symbols[_gathered(first, lengths, some)])
        likely = emit[laid]
        alpha, logs, _ = ahead(model.move, likely, steps, model.start)
        beta, both = behind(model.move, likely, steps, np.ones((len(some), STATES)))
        sums.log += float(logs.sum())
        sums.add(model, laid, alpha, beta)
        heads = alpha[: len(some)] * beta[: len(some)]
        sums.start += (heads / heads.sum(1)[:, None]).sum(0)
        if steps.longest > 1:
            later = np.arange(steps.offset[1], len(laid))
            sums.moved(model, alpha[later - np.repeat(steps.active[:-1], steps.active[1:])], both[later])
    return sums


def _count_long(model: Model, emit: np.ndarray, x: np.ndarray, sums: Sums) -> None:
    """The counts of one long text: forward over its pieces, of which only the states between them stay, then back from the last."""
    cuts = [*range(0, len(x), BLOCK), len(x)]
    begins = [model.start[None]]
    ends = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        _, log, end = ahead(model.move, emit[x[a:b]], Steps(np.array([b - a])), begins[-1])
        sums.log += float(log[0])
        ends.append(end)
        begins.append(end @ model.move)
    tail = np.ones((1, STATES))
    for k in range(len(ends) - 1, -1, -1):
        piece, steps = x[cuts[k] : cuts[k + 1]], Steps(np.array([cuts[k + 1] - cuts[k]]))
        likely = emit[piece]
        alpha, _, _ = ahead(model.move, likely, steps, begins[k])
        beta, both = behind(model.move, likely, steps, tail)
        sums.add(model, piece, alpha, beta)
        sums.moved(model, alpha[:-1], both[1:])
        if k:
            sums.moved(model, ends[k - 1], both[:1])
            tail = both[:1] @ model.move.T
            tail /= tail.sum()
        else:
            sums.start += (alpha[0] * beta[0]) / (alpha[0] * beta[0]).sum()


def likelihoods(model: Model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The natural log likelihood of each text's symbols."""
    lengths, emit, means = np.diff(first), *_scaled(model)
    out = np.bincount(np.repeat(np.arange(len(lengths)), lengths), means[symbols], len(lengths))
    for some in blocks(lengths):
        begin = model.start[None]
        if lengths[some[0]] > BLOCK:
            x = symbols[first[some[0]] : first[some[0] + 1]]
            for a in range(0, len(x), BLOCK):
                _, log, end = ahead(model.move, emit[x[a : a + BLOCK]], Steps(np.array([len(x[a : a + BLOCK])])), begin)
                out[some[0]] += log[0]
                begin = end @ model.move
            continue
        steps = Steps(lengths[some])
        _, logs, _ = ahead(model.move, emit[steps.laid(symbols[_gathered(first, lengths, some)])], steps, begin)
        out[some[steps.order]] += logs
    return out


def step(codes: DataFrame, model: Model) -> tuple[Model, float, int]:
    """One Baum-Welch step over all rows (symbols) of `codes`: the new model, and the log likelihood under the old one and tokens. Each partition gives its counts, Spark adds them up; as many rows as symbols come to the driver."""
    shared = codes.sparkSession.sparkContext.broadcast(model)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = shared.value, 0
        total = Sums(len(model.emit))
        for batch in batches:
            symbols, first = symbols_of(batch.column(0))
            cuts = np.searchsorted(first, np.arange(0, first[-1], LONG_BYTES // 2))
            for i, j in zip(cuts, [*cuts[1:], len(first) - 1], strict=True):
                if i < j:
                    more = expected_counts(model, symbols[first[i] : first[j]], first[i : j + 1] - first[i])
                    total.start, total.move, total.emit, total.log = total.start + more.start, total.move + more.move, total.emit + more.emit, total.log + more.log
            tokens += len(symbols)
        table = np.concatenate([total.start[None], total.move, total.emit, [[total.log, tokens] + [0] * (STATES - 2)]])
        table = np.rint(table * UNIT).astype(np.int64)
        some = np.flatnonzero(table.any(1))
        yield record(id=some, **{f"s{k}": np.ascontiguousarray(table[some, k]) for k in range(STATES)})

    states = [f"s{k}" for k in range(STATES)]
    added = codes.select("symbols").mapInArrow(counts, "id long, " + ", ".join(f"{s} long" for s in states)).groupBy("id").agg(*[F.sum(s).alias(s) for s in states]).collect()
    shared.unpersist()
    table = np.zeros((2 + STATES + len(model.emit), STATES))
    for r in added:
        table[r.id] = [r[s] / UNIT for s in states]
    start, move, emit = table[0] + 0.1, table[1 : 1 + STATES] + 0.1, table[1 + STATES : -1]
    # Every state keeps a little of what all states emit.
    share = emit.sum(0) + 1e-9
    everywhere = (emit.sum(1) + 0.5) / (emit.sum() + 0.5 * len(emit))
    emit = emit + everywhere[:, None] * (1 + 0.01 * share)
    new = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), share / share.sum())
    return new, float(table[-1, 0]), round(table[-1, 1])


def fit(codes: DataFrame, v: Vocabulary, steps: int = BAUM_WELCH_STEPS) -> Model:
    """The model after `steps` steps, each over all rows of `codes`, or fewer if the likelihood gains less than LEAST_GAIN a token. Likelihoods are logged."""
    model, before = first_model(v), None
    for k in range(steps):
        model, likelihood, tokens = step(codes, model)
        now = likelihood / max(tokens, 1)
        LOG.info("Baum-Welch step %d: %.4f nats a token over %d tokens", k + 1, now, tokens)
        if before is not None and now - before < LEAST_GAIN:
            break
        before = now
    return model


def based(codes: DataFrame, rows: DataFrame, counted: DataFrame, v: Vocabulary, keep: tuple[str, ...]) -> DataFrame:
    """`rows` (of the rows of `codes`, with key__, n_tokens, known and plain) with columns `keep`, n_tokens, n_known, base_score, and `gain`, what the counts of words outside the head add.

    The words of a row outside the head are looked up by a shuffle join on the word. None of them
    is frequent in training, as the head holds those; one that is frequent elsewhere makes a
    skewed partition, which adaptive execution splits.
    """
    width = float(np.log10(v.tokens + v.words + 1))
    rare = codes.select("key__", F.explode("rare").alias("hash"))
    met = rare.join(counted.select("hash", "n"), "hash").groupBy("key__").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("gain"))
    gain = F.coalesce(F.col("gain"), F.lit(0.0))
    known = F.col("known") + F.coalesce(F.col("more"), F.lit(0))
    base = F.col("plain") + gain - F.col("n_tokens") * F.lit(width)
    rest = [c for c in rows.columns if c not in (*keep, "key__", "n_tokens", "known", "plain")]
    return rows.join(met, "key__", "left").select(*[named(c) for c in keep], "n_tokens", known.alias("n_known"), base.alias("base_score"), gain.alias("gain"), *rest)


def score(codes: DataFrame, counted: DataFrame, v: Vocabulary, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` of the rows of `encoded`, n_tokens, n_known, base_score (see `based`) and score."""
    shared = codes.sparkSession.sparkContext.broadcast(model)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            symbols, first = symbols_of(batch.column(0))
            logs = np.zeros(len(first) - 1)
            cuts = np.searchsorted(first, np.arange(0, first[-1], LONG_BYTES // 2))
            for i, j in zip(cuts, [*cuts[1:], len(first) - 1], strict=True):
                if i < j:
                    logs[i:j] = likelihoods(model, symbols[first[i] : first[j]], first[i : j + 1] - first[i])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(logs / np.log(10))], [*batch.schema.names[1:], "chain"])

    rows = codes.select("symbols", *[named(c) for c in (*keep, "n_tokens", "known", "plain", "inner", "key__")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    out = based(codes, rows.mapInArrow(local, f"{kinds}, chain double"), counted, v, keep)
    return out.select(*[named(c) for c in keep], "n_tokens", "n_known", "base_score", (F.col("chain") + F.col("inner") + F.col("gain")).alias("score"))


def _counted(df: DataFrame, train: Column, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, Vocabulary, DataFrame]:
    """Written counts of training words, the vocabulary, and the rows of `encoded` with key__."""
    rows = df.withColumn("train__", F.coalesce(train, F.lit(False)))
    counted, _ = written(count_words(rows.filter("train__"), text))
    v = vocabulary_of(counted)
    return counted, v, encoded(rows, v, text, (*keep, "train__")).withColumn("key__", F.monotonically_increasing_id())


def scored(df: DataFrame, train: Column, text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, Vocabulary]:
    """All rows of df scored by a model of those for which `train` is true; see `score`.

    A null text is empty and has one token, its end. Very long texts are one sequence, worked
    through in pieces. Repeated rows are scored each, and train each; words whose counts tie are
    all in the head or none. An empty table, or none to train on, gives defined results: no rows,
    or the unigram floor. Columns `keep` may have any name that no output has.
    """
    counted, v, codes = _counted(df, train, text, keep)
    codes, _ = written(codes)
    model = fit(codes.filter("train__"), v)
    return score(codes, counted, v, model, keep), v


def base_scored(df: DataFrame, train: Column, text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, Vocabulary]:
    """`scored` without the score: all that needs counts of words only, for which no model is trained and no symbols are written."""
    counted, v, codes = _counted(df, train, text, keep)
    codes, _ = written(codes.drop("symbols", "inner"))
    return based(codes, codes.drop("rare", "train__"), counted, v, keep).drop("gain"), v


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op10_lm_score(documents: DataFrame) -> DataFrame:
    """Every document scored by a model of those that are not held out; a null doc_id trains. See `scored`."""
    mark = marked()
    documents = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    out, v = scored(documents, ~F.col("held_out"), keep=("doc_id", "held_out"))
    return settled(out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score"), mark)


def base_scores(documents: DataFrame) -> DataFrame:
    """The columns of `op10_lm_score` but for the score, by the same steps; see `base_scored`."""
    mark = marked()
    documents = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    out, v = base_scored(documents, ~F.col("held_out"), keep=("doc_id", "held_out"))
    return settled(out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score"), mark)
