import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import hmm


def tokens(text):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low)), "\n"]


def check_base(docs):
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted(((repr(r.doc_id), held(r.doc_id), len(t := tokens(r.text)), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for r in rows))
    out = hmm.op10_lm_score(docs).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    return out


def test_base_and_gain(spark, data):
    out = check_base(spark.read.parquet(f"{data}/documents.parquet"))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_are_met_by_the_join(spark, data, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 200)
    monkeypatch.setattr(hmm, "SYMBOLS", 50)
    check_base(spark.read.parquet(f"{data}/documents.parquet"))


def test_odd_rows(odd_documents, no_documents):
    check_base(odd_documents)
    assert hmm.op10_lm_score(no_documents).count() == 0


def random_model(rng, symbols):
    even = lambda *s: (x := rng.random(s) + 0.1) / x.sum(-1, keepdims=True)
    k = hmm.STATES
    emit = rng.random((symbols, k)) + 0.1
    return hmm.Model(even(k), even(k, k), emit / emit.sum(0), even(k))


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    model = random_model(rng, 5)
    texts = [rng.integers(0, 5, n) for n in (3, 1, 4)]
    lengths = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(lengths)])
    got = hmm.likelihoods(model, np.concatenate(texts), first)
    for x, g in zip(texts, got, strict=True):
        p = model.start * model.emit[x[0]]
        for s in x[1:]:
            p = (p @ model.move) * model.emit[s]
        assert abs(np.log(p.sum()) - g) < 1e-9


def test_expected_counts_against_plain_forward_backward():
    rng = np.random.default_rng(1)
    model = random_model(rng, 6)
    texts = [rng.integers(0, 6, n) for n in (7, 2, 1, 5)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = hmm.expected_counts(model, np.concatenate(texts), first)
    s, m, e, log = np.zeros_like(got.start), np.zeros_like(got.move), np.zeros_like(got.emit), 0.0
    for x in texts:
        n = len(x)
        a, b = np.zeros((n, hmm.STATES)), np.ones((n, hmm.STATES))
        a[0] = model.start * model.emit[x[0]]
        for t in range(1, n):
            a[t] = (a[t - 1] @ model.move) * model.emit[x[t]]
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (model.emit[x[t + 1]] * b[t + 1])
        z = a[-1].sum()
        log += np.log(z)
        s += a[0] * b[0] / z
        for t in range(n):
            e[x[t]] += a[t] * b[t] / z
            if t:
                m += model.move * np.outer(a[t - 1], model.emit[x[t]] * b[t]) / z
    assert np.allclose(got.start, s) and np.allclose(got.move, m) and np.allclose(got.emit, e) and np.allclose(got.log, log)


def test_texts_longer_than_a_block_are_one_sequence(monkeypatch):
    rng = np.random.default_rng(2)
    model = random_model(rng, 6)
    x = rng.integers(0, 6, 700)
    first = np.array([0, 400, 403, 700])
    whole, alike = hmm.expected_counts(model, x, first), hmm.likelihoods(model, x, first)
    monkeypatch.setattr(hmm, "BLOCK", 37)
    got = hmm.expected_counts(model, x, first)
    for name in ("start", "move", "emit", "log"):
        assert np.allclose(getattr(got, name), getattr(whole, name))
    assert np.allclose(hmm.likelihoods(model, x, first), alike) and np.allclose(alike.sum(), whole.log)


def test_score_against_plain_python(spark, odd_documents, monkeypatch):
    """The score of every text from words and counts alone: the chain over symbols, and words within classes."""
    monkeypatch.setattr(hmm, "HEAD", 12)
    monkeypatch.setattr(hmm, "SYMBOLS", 6)
    out, v = hmm.scored(odd_documents, F.col("doc_id") % 2 == 1, keep=("doc_id",))
    rows = [(r.doc_id, tokens(r.text)) for r in odd_documents.collect()]
    c = Counter(w for i, t in rows if i is not None and i % 2 for w in t)
    assert (v.tokens, v.words) == (sum(c.values()), len(c))
    codes = hmm.encoded(odd_documents.filter("doc_id % 2 = 1"), v)
    model = hmm.fit(codes, v)
    own = {int(h): int(s) for h, s in zip(v.hashes, v.symbols, strict=True) if s >= 0}

    def token(w):
        if w == "\n":
            return hmm.END, 0
        data = np.frombuffer(w.encode(), np.uint8)
        h, k, _ = hmm.tokens_of(hmm.Texts(data, np.array([0]), np.array([len(data)])))
        return h[0], int(k[0])

    want = []
    for i, t in rows:
        p, total = model.start, 0.0
        for w in t:
            h, k = token(w)
            symbol = own[int(h)] + hmm.CLASSES if int(h) in own else k
            p = p * model.emit[symbol]
            total += math.log10(p.sum())
            if symbol < hmm.CLASSES:
                total += math.log10((c[w] + 1) / (v.class_tokens[k] + v.class_words[k] + 1))
            p = (p / p.sum()) @ model.move
        want.append((repr(i), len(t), round(total, 4)))
    assert sorted((repr(r.doc_id), r.n_tokens, round(r.score, 4)) for r in out.collect()) == sorted(want)


def test_head_by_count(spark):
    """As many of the most frequent words as fit, but all or none of those that tie."""
    counts = [9, 9, 7, 5, 5, 5, 2, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(counts)], "hash long, cls int, n long")
    assert [sum(n >= hmm.frequent(df, most) for n in counts) for most in (1, 2, 3, 5, 6, 7, 9, 11)] == [0, 2, 3, 3, 6, 7, 7, 11]


def test_reruns_agree(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    v = hmm.vocabulary_of(hmm.count_words(docs).cache())
    one, two = (hmm.step(hmm.encoded(d, v), hmm.first_model(v)) for d in (docs, docs.repartition(3)))
    assert np.abs(one[0].emit - two[0].emit).max() < 1e-6 and one[2] == two[2] == v.tokens


def test_every_step_reads_all_texts_and_gains(spark, monkeypatch):
    """A text that is a third of all rows is in every step, as often as it occurs."""
    texts = [f"w{i % 7} x{i % 5} y{i} z" for i in range(40)] + ["the same text again"] * 20
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    v = hmm.vocabulary_of(hmm.count_words(docs))
    seen, step = [], hmm.step
    monkeypatch.setattr(hmm, "step", lambda codes, m: (out := step(codes, m), seen.append(out[1:]))[0])
    hmm.fit(hmm.encoded(docs, v), v)
    assert 2 <= len(seen) <= 5 and all(n == v.tokens for _, n in seen)
    assert all(b[0] > a[0] for a, b in zip(seen, seen[1:], strict=False))


def test_base_scores_need_no_model(spark, odd_documents, monkeypatch):
    from tallyloom.llm.beside import lm_base_scores

    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score")]
    want = sorted(map(repr, hmm.op10_lm_score(odd_documents).select(*columns).collect()))
    monkeypatch.setattr(hmm, "fit", None)
    assert sorted(map(repr, lm_base_scores(odd_documents).collect())) == want and want
