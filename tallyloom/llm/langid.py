"""Language identification: scripts narrow the candidates, Viterbi over words labels spans.

Each word is scored by the languages that write its script, and no others, from byte trigrams,
counted over all training texts. A penalty for switching makes spans of mixed-language texts; the
text's language is the one that labels the most letters. The model holds a row for each trigram
that a language has, so that it takes any number of languages; scores are made for slices of
texts whose size falls with the number of languages, and a longer text is read piece by piece.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.hmm import Steps, blocks
from tallyloom.llm.kit import LONG_BYTES, SPACE, Texts, code_points, named, record, slices, texts_of, word_bounds, word_hashes

# Ranges of code points by script.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)],
}
NAMES = ["none", *SCRIPTS, "other"]
#: Buckets of hashed trigrams; the model holds as many rows, whatever the corpus.
BUCKETS = 1 << 15
#: Languages of which a task that learns holds tables at once; it hands on what it has when there are more.
TABLES = 64
#: Bytes that a slice of texts may take as scores; a text beyond its share is read piece by piece.
BUDGET = 200 << 20
#: Bytes of a word beyond which it is read as several.
LONG_WORD = 1 << 14
#: What an unseen trigram counts.
SMOOTH = 0.05
#: Log units that a change of language costs.
SWITCH = 6.0
#: A language is a candidate for a script that at least this share of its words has.
LEAST_SHARE = 0.005
#: Below the score of any part of a word.
_IMPOSSIBLE = -1e7


def _script_table() -> np.ndarray:
    """Script by the first two bytes of a character (the second counts only from 0x80)."""
    table = np.zeros(1 << 16, np.int8)
    of = lambda low, high: next((k for k, ranges in enumerate(SCRIPTS.values(), 1) if any(a <= low and high <= b for a, b in ranges)), 0)
    for lead in range(0x80):
        table[lead << 8 : (lead + 1) << 8] = of(lead, lead)
    for lead in range(0xC2, 0xF5):
        for second in range(0x80, 0xC0):
            two = second & 0x3F
            if lead < 0xE0:
                low = high = (lead & 0x1F) << 6 | two
            elif lead < 0xF0:
                low = (lead & 0x0F) << 12 | two << 6
                high = low + 63
            else:
                low = (lead & 0x07) << 18 | two << 12
                high = low + 4095
            found = of(low, high) if lead >= 0xE0 or unicodedata.category(chr(low))[0] == "L" else 0
            if not found and any(unicodedata.category(chr(c))[0] == "L" for c in range(low, min(high, 0x10FFFF) + 1)):
                found = len(NAMES) - 1
            table[lead << 8 | second] = found
    return table


_TABLE = _script_table()
_GAP = np.full(256, 0x20, np.uint8)
_GAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_GAP[0x41:0x5B] = np.arange(0x61, 0x7B)
_GAP[0x80:] = np.arange(0x80, 0x100)


def part_end(data: np.ndarray, start: int, end: int) -> int:
    """Where the first part of a word ends: LONG_WORD bytes on, or before the character that lies across."""
    at = start + LONG_WORD
    if at >= end:
        return end
    while (data[at] & 0xC0) == 0x80 and at > start + LONG_WORD - 4:
        at -= 1
    return at


def cut_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of words, long ones in parts, and the first one of each text."""
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if not len(long):
        return starts, ends, first
    cuts = []
    for i in long:
        at = part_end(data, starts[i], ends[i])
        while at < ends[i]:
            cuts.append(at)
            at = part_end(data, at, ends[i])
    cuts = np.array(cuts, np.int64)
    before = np.searchsorted(cuts, np.append(starts, len(data) + 1)[np.minimum(first, len(starts))])
    return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts])), first + before


def pieces(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of a text of about `most` bytes, which is LONG_WORD at least, such that no word or part of one lies across."""
    at, n = 0, len(data)
    while n - at > most:
        spaces = np.flatnonzero(SPACE[data[at : at + most]])
        to = at + int(spaces[-1]) + 1 if len(spaces) else part_end(data, at, n)
        yield at, to
        at = to
    yield at, n


@dataclass
class Words:
    """Words of texts: bounds, first word of each text, script (0: no letter), letter bytes, trigram buckets of all bytes, and how many characters before each byte are surely letters."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    buckets: np.ndarray
    sure: np.ndarray


def words_of(texts: Texts) -> Words:
    """Words, with ASCII letters lowered and everything else in ASCII as a gap."""
    data = texts.data
    starts, ends, first = cut_words(data, *word_bounds(texts))
    after = np.append(data[1:], np.uint8(0)) if len(data) else data
    script = _TABLE[data.astype(np.uint16) << np.uint16(8) | after]
    plain = _GAP[data].astype(np.uint32)
    left = np.concatenate([[np.uint32(0x20)], plain[:-1]]).astype(np.uint32) if len(data) else plain
    right = np.append(plain[1:], np.uint32(0x20)).astype(np.uint32) if len(data) else plain
    some = texts.starts < texts.ends  # a text's first and last byte have no neighbour beyond it
    left[texts.starts[some]] = right[texts.ends[some] - 1] = 0x20
    left[starts] = right[ends - 1] = 0x20  # nor have the parts of a long word
    three = (left << np.uint32(16) | plain << np.uint32(8) | right) * np.uint32(0x9E3779B1)
    letter = script > 0
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter | (data >= 0x80) & (data < 0xC0), out=sums[1:])
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=count[1:])
    sure = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter & (data < 0xE0), out=sure[1:])
    at = np.flatnonzero(letter)
    first_letter = at[np.minimum(np.searchsorted(at, starts), max(len(at) - 1, 0))] if len(at) else starts
    has = count[ends] > count[starts]
    return Words(starts, ends, first, np.where(has, script[first_letter], 0) if len(at) else np.zeros(len(starts), np.int8), np.where(has, sums[ends] - sums[starts], 0), (three >> np.uint32(17)).astype(np.int32), sure)


@dataclass
class Model:
    """Languages; for each trigram bucket the languages that have it, with how much more likely than an unseen one it is (log); the log probability of an unseen one in each language; and which languages each script may be."""

    langs: list[str]
    first: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    unseen: np.ndarray
    allowed: np.ndarray

    def table(self, buckets: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Log probabilities of some buckets in some languages."""
        column = np.full(len(self.langs), -1, np.int64)
        column[langs] = np.arange(len(langs))
        held = self.first[buckets + 1] - self.first[buckets]
        row = np.repeat(np.arange(len(buckets)), held)
        at = np.arange(held.sum()) + np.repeat(self.first[buckets] - (np.cumsum(held) - held), held)
        own = column[self.lang[at]]
        out = np.repeat(self.unseen[langs][None].astype(np.float32), len(buckets), 0)
        out[row[own >= 0], own[own >= 0]] += self.gain[at[own >= 0]]
        return out


def modelled(langs: list[str], code: np.ndarray, at: np.ndarray, n: np.ndarray) -> Model:
    """A model of counts: language by code, bucket (or BUCKETS and a script), times."""
    inside = at < BUCKETS
    totals = np.bincount(code[inside], n[inside], len(langs))
    order = np.argsort(at[inside], kind="stable")
    first = np.searchsorted(at[inside][order], np.arange(BUCKETS + 1))
    scripts = np.zeros((len(NAMES), len(langs)))
    scripts[at[~inside] - BUCKETS, code[~inside]] = n[~inside]
    allowed = scripts >= LEAST_SHARE * np.maximum(scripts[1:].sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(langs, first, code[inside][order].astype(np.int32), np.log((n[inside][order] + SMOOTH) / SMOOTH).astype(np.float32), np.log(SMOOTH / (totals + SMOOTH * BUCKETS)), allowed)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count trigrams and scripts of all texts by language (null languages or texts teach nothing).

    A task sends a row for each language and bucket that it has seen; added up, as many come to the
    driver as languages have different trigrams, 2**15 each at most. Repeated texts count each; a
    very long text is read whole, piece by piece. Without any text to learn from the model has no
    language.
    """
    lang_ = F.col(lang).cast("string")
    rows = df.filter(lang_.isNotNull() & F.col(text).isNotNull()).select(F.col(text), lang_.alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, total in sums.items():
                some = np.flatnonzero(total)
                yield record(lang=pa.array([name] * len(some), pa.string()), id=some, n=total[some])
            sums.clear()

        for batch in batches:
            names, codes = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for i, part in _parts(texts_of(batch.column(0)), LONG_BYTES):
                w = words_of(part)
                owner = np.repeat(np.arange(len(part)), part.ends - part.starts)
                inside = _GAP[part.data] != 0x20
                own = codes[i : i + len(part)]
                for k in np.unique(own):
                    if str(names[k]) not in sums and len(sums) >= TABLES:
                        yield from told()
                    total = sums.setdefault(str(names[k]), np.zeros(BUCKETS + len(NAMES), np.int64))
                    mine = own == k
                    total[:BUCKETS] += np.bincount(w.buckets[inside & mine[owner]], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(w.script[np.repeat(mine, np.diff(w.first))], minlength=len(NAMES))
        yield from told()

    found = rows.mapInArrow(count, "lang string, id long, n long").groupBy("lang", "id").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode() if len(found) else None
    langs = sorted(names.dictionary.to_pylist()) if names is not None else []
    rank = {x: k for k, x in enumerate(langs)}
    code = np.array([rank[x] for x in names.dictionary.to_pylist()], np.int64)[np.asarray(names.indices)] if langs else np.zeros(0, np.int64)
    return modelled(langs, code, np.asarray(found.column("id")), np.asarray(found.column("n")))


def _parts(texts: Texts, most: int) -> Iterator[tuple[int, Texts]]:
    """Slices of texts, and pieces of a longer one, with the number of the first text in each."""
    for i, _, part in slices(texts, most):
        if len(part) == 1 and len(part.data) > most:
            for a, b in pieces(part.data, most):
                yield i, Texts(part.data[a:b], np.zeros(1, np.int64), np.full(1, b - a, np.int64))
        else:
            yield i, part


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of scores in each sequence, when a change of label costs `switch`; ties go to staying, then to the first label."""
    out = np.zeros(len(scores), np.int32)
    lengths = np.diff(first)
    for some in blocks(lengths):
        if not lengths[some[0]]:
            break
        steps = Steps(lengths[some])
        at = np.arange(lengths[some].sum()) + np.repeat(first[some] - (np.cumsum(lengths[some]) - lengths[some]), lengths[some])
        laid = steps.laid(scores[at])
        source = np.empty(laid.shape[0], np.int32)
        stays = np.empty(laid.shape, bool)
        best = laid[steps.at(0)].copy()
        last = np.empty(len(some), np.int32)
        for t in range(1, steps.longest):
            n = steps.active[t]
            if n < len(best):
                last[n : len(best)] = best[n:].argmax(1)
                best = best[:n]
            top = best.argmax(1)
            change = best[np.arange(n), top] - switch
            s = steps.at(t)
            source[s] = top
            stay = best >= change[:, None]
            stays[s] = stay
            best = np.where(stay, best, change[:, None]) + laid[s]
        last[: len(best)] = best.argmax(1)
        label = np.empty(laid.shape[0], np.int32)
        now = last
        for t in range(steps.longest - 1, -1, -1):
            n, s = steps.active[t], steps.at(t)
            label[s] = now[:n]
            if t:
                here = now[:n]
                now[:n] = np.where(stays[s][np.arange(n), here], here, source[s])
        out[at] = label[steps.place]
    return out


def candidates(model: Model, w: Words) -> np.ndarray:
    """The languages that write a script of some word."""
    seen = np.unique(w.script)
    return np.flatnonzero(model.allowed[seen[seen > 0]].any(0))


def word_scores(model: Model, texts: Texts, w: Words, langs: np.ndarray) -> np.ndarray:
    """The log likelihood of each word by the languages of `langs` that write its script; others are impossible, and a word without letters tells nothing."""
    # Words that repeat are scored once.
    _, once, code = np.unique(word_hashes(texts.data, w.starts, w.ends), return_index=True, return_inverse=True)
    scores, scripts = np.full((len(once), len(langs)), _IMPOSSIBLE), w.script[once]
    scores[scripts == 0] = 0
    plain = _GAP[texts.data] != 0x20
    for script in np.unique(scripts[scripts > 0]):
        own = np.flatnonzero(model.allowed[script][langs])
        which = np.flatnonzero(scripts == script)
        at, owner = _spread(w.starts[once[which]], w.ends[once[which]])
        at, owner = at[plain[at]], owner[plain[at]]
        buckets, row = np.unique(w.buckets[at], return_inverse=True)
        table = model.table(buckets, langs[own])
        begins = np.searchsorted(owner, np.arange(len(which)))  # a word with letters has a byte that counts
        scores[np.ix_(which, own)] = np.add.reduceat(table[row], begins, axis=0, dtype=np.float64)
    return scores[code]


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of some ranges, and the range it is in."""
    held = ends - starts
    owner = np.repeat(np.arange(len(starts)), held)
    return np.arange(held.sum()) + np.repeat(starts - (np.cumsum(held) - held), held), owner


def piecewise(score: Callable[[int], np.ndarray], count: int, switch: float = SWITCH) -> Iterator[tuple[int, np.ndarray]]:
    """The labels of `viterbi` for one sequence whose scores come in pieces, last piece first: (piece, labels).

    The way there keeps the state before each piece only; on the way back each piece is scored
    again, and its choices are made and followed.
    """
    states, best = [], None
    for p in range(count):
        states.append(None if best is None else best.copy())
        for row in score(p):
            best = row.copy() if best is None else np.maximum(best, best.max() - switch) + row
    now = None if best is None else int(best.argmax())
    for p in range(count - 1, -1, -1):
        rows, best = score(p), states[p]
        stays, source = np.ones(rows.shape, bool), np.zeros(len(rows), np.int32)
        for t, row in enumerate(rows):
            if best is None:
                best = row.copy()
                continue
            top = int(best.argmax())
            change = best[top] - switch
            source[t] = top
            np.greater_equal(best, change, out=stays[t])
            best = np.maximum(best, change) + row
        labels = np.empty(len(rows), np.int32)
        for t in range(len(rows) - 1, -1, -1):
            labels[t] = now
            if not stays[t, now]:
                now = int(source[t])
        yield p, labels


def _runs(labels: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Runs of equal labels as [start, end, label]."""
    if not len(labels):
        return []
    cuts = np.concatenate([[0], 1 + np.flatnonzero(np.diff(labels)), [len(labels)]])
    return [[int(starts[x]), int(ends[y - 1]), int(labels[x])] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def long_text(model: Model, part: Texts, most: int) -> tuple[np.ndarray, list[list[int]], bool]:
    """Letters by language and runs (start, end in code points, language) of one text, read by pieces; and whether it surely has a letter."""
    bounds = list(pieces(part.data, most))
    piece = lambda p: Texts(part.data[slice(*bounds[p])], np.zeros(1, np.int64), np.full(1, bounds[p][1] - bounds[p][0], np.int64))
    scripts, sure = set(), False
    for p in range(len(bounds)):
        w = words_of(piece(p))
        scripts |= set(np.unique(w.script[w.script > 0]).tolist())
        sure = sure or bool(w.sure[-1] > 0)
    langs = np.flatnonzero(model.allowed[sorted(scripts)].any(0)) if scripts else np.zeros(0, np.int64)
    weight, found = np.zeros(len(model.langs)), []
    if not len(langs):
        return weight, found, sure
    points = np.concatenate([[0], np.cumsum([int(np.count_nonzero((piece(p).data & 0xC0) != 0x80)) for p in range(len(bounds))])])
    for p, labels in piecewise(lambda p: word_scores(model, piece(p), words_of(piece(p)), langs), len(bounds)):
        w, at = words_of(piece(p)), code_points(piece(p).data)
        weight += np.bincount(langs[labels], w.letters, len(weight))
        mine = _runs(langs[labels], points[p] + at[w.starts], points[p] + at[w.ends])
        if mine and found and found[0][2] == mine[-1][2]:
            found[0][0] = mine.pop()[0]
        found = mine + found
    return weight, found, sure


def _no_letter(texts: Texts, i: int) -> bool:
    return not any(c.isalpha() for c in texts.data[texts.starts[i] : texts.ends[i]].tobytes().decode())


def labelled(model: Model, texts: Texts, spans: bool = False) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and, if asked for, spans (start, end in code points, language) of each text."""
    most = max(LONG_WORD, min(LONG_BYTES, BUDGET // (12 * max(1, len(model.langs)))))
    for _, _, part in slices(texts, most):
        if len(part) == 1 and len(part.data) > most and model.langs:
            weights, runs, sure = long_text(model, part, most)
            weights, found, surely = weights[None], [runs if spans else []], np.array([sure])
        else:
            w = words_of(part)
            langs = candidates(model, w)
            labels = langs[viterbi(word_scores(model, part, w, langs), w.first)] if len(langs) else np.zeros(len(w.starts), np.int64)
            owner = np.repeat(np.arange(len(part)), np.diff(w.first))
            wide = max(1, len(model.langs))
            used, code = np.unique(owner * wide + labels, return_inverse=True)
            sums = np.bincount(code, w.letters, len(used)) if len(used) else np.zeros(0)
            weights, surely = (used, sums), w.sure[part.ends] > w.sure[part.starts]
            found = [[]] * len(part)
            if spans:
                points = code_points(part.data)
                found = [_runs(labels[a:b], points[w.starts[a:b]] - points[part.starts[i]], points[w.ends[a:b]] - points[part.starts[i]]) for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True))]
        for i in range(len(part)):
            if isinstance(weights, tuple):
                a, b = np.searchsorted(weights[0], [i * wide, (i + 1) * wide])
                which, held = weights[0][a:b] - i * wide, weights[1][a:b]
            else:
                which, held = np.arange(weights.shape[1]), weights[i]
            total = held.sum()
            # Blocks of characters of three and more bytes hold signs as well: look closely where there are no others.
            if not model.langs or total == 0 or (not surely[i] and _no_letter(part, i)):
                yield "und", 0.0, []
            else:
                best = int(held.argmax())  # the first language of those that tie
                yield model.langs[which[best]], float(held[best] / total), [(a, b, model.langs[k]) for a, b, k in found[i]]


def label(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = (), spans: bool = False) -> DataFrame:
    """Columns `keep`, lang_pred, score (the share of letters in its spans) and, if asked for, spans (start, end in code points, lang).

    Null texts and those without a letter are `und` with score 0 and no spans; so is everything
    if nothing was learned. Ties go to the first language by code. Very long texts are read whole,
    in pieces; a word of more than LONG_WORD bytes is read as several. Repeated rows each count; an
    empty table gives an empty table. Columns `keep` may have any name that no output has.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(labelled(shared.value, texts_of(batch.column(0)), spans))
            columns = [*(batch.column(i) for i in range(1, batch.num_columns)), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            runs = [pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x[2]] for x in found], kind)] if spans else []
            yield pa.RecordBatch.from_arrays(columns + runs, [*batch.schema.names[1:], "lang_pred", "score", *["spans"] * spans])

    rows = df.select(F.col(text).alias("text__"), *[named(c) for c in keep])
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(predict, f"{kinds}lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans)


def op4_language_id(documents: DataFrame) -> DataFrame:
    """Every document's language, learned from those that are not held out; a null doc_id is not."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    documents = documents.select("doc_id", "text", "lang", out.alias("held_out"))
    model = fit(documents.filter(~F.col("held_out")))
    return label(documents, model, keep=("doc_id", "held_out"))
