import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import langid


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = langid.op4_language_id(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=6), st.integers(1, 3), st.integers(0, 10**6))
def test_viterbi_is_the_best_path(lengths, k, seed):
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = np.round(np.random.default_rng(seed).standard_normal((first[-1], k)) * 3, 1)
    got = langid.viterbi(scores, first, 1.5)
    import itertools

    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a > 6:
            continue
        value = lambda p, a=a: sum(scores[a + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(map(value, itertools.product(range(k), repeat=int(b - a))))
        assert abs(value(got[a:b]) - best) < 1e-9


def test_mixed_text_is_labelled_by_span(spark):
    en = "the cat and the dog went over to the other house with them "
    ru = "кошка и собака пошли вместе в другой дом со всеми "
    de = "der hund und die katze gehen zusammen in das andere haus "
    train = spark.createDataFrame([(en * 3, "en"), (ru * 3, "ru"), (de * 3, "de")] * 5, "text string, lang string")
    model = langid.fit(train)
    text = en + ru + de + "123 456"
    df = spark.createDataFrame([(1, text), (2, None), (3, "12 + 3 …"), (4, "été 中文 кошка"), (5, "привет"), (6, "… — ₂"), (7, "× ÷ ٣ ₂"), (8, "語")], "i int, text string")
    out = {r.i: r for r in langid.label(df, model, keep=("i",), spans=True).collect()}
    assert [s.lang for s in out[1].spans] == ["en", "ru", "de"]
    assert text[out[1].spans[1].start : out[1].spans[1].end].strip() == ru.strip()
    assert [(out[i].lang_pred, out[i].score, out[i].spans) for i in (2, 3, 6, 7)] == [("und", 0.0, [])] * 4
    assert out[5].lang_pred == "ru" and out[8].lang_pred != "und"


def test_odd_rows(odd_documents, no_documents, spark):
    assert langid.op4_language_id(odd_documents).count() == odd_documents.count()
    assert langid.op4_language_id(no_documents).count() == 0
    untaught = odd_documents.drop("lang").selectExpr("*", "cast(null as string) AS lang")
    assert {r.lang_pred for r in langid.op4_language_id(untaught).collect()} == {"und"}


def test_letters_late_in_a_block_of_four_byte_characters_count(spark):
    train = spark.createDataFrame([("the cat and the dog went over to the house", "en")] * 5, "text string, lang string")
    model = langid.fit(train)
    df = spark.createDataFrame([(1, "\U0001D400\U0001D401\U0001D402 \U0001D403"), (2, "\U00016F00\U00016F01"), (3, "\U0001D11E \U0001D122"), (4, "😀")], "i int, text string")
    out = {r.i: (r.lang_pred, r.score) for r in langid.label(df, model, keep=("i",)).collect()}
    assert out[1][0] != "und" and out[1][1] > 0 and out[2][0] != "und"
    assert out[3] == out[4] == ("und", 0.0)


def test_every_letter_counts(spark):
    """str.isalpha as the oracle, one text for each run of 64 code points of which some are letters, and one for those of which none is."""
    train = spark.createDataFrame([("the cat and the dog went over to the house", "en")] * 5, "text string, lang string")
    model = langid.fit(train)
    blocks = [[chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000] for low in range(0, 0x110000, 64)]
    letters = [next(c for c in b if c.isalpha()) for b in blocks if any(c.isalpha() for c in b)]
    others = [" ".join(c for c in b if not c.isalpha()) for b in blocks]
    rows = [(True, c) for c in letters] + [(False, t) for t in others if t.strip()]
    df = spark.createDataFrame(rows, "letter boolean, text string")
    wrong = langid.label(df, model, keep=("letter",)).filter((F.col("lang_pred") == "und") == F.col("letter")).count()
    assert wrong == 0


def test_words_do_not_depend_on_the_neighbours_of_a_text():
    texts = ["ab", "cd é", "", "ß", "xyz "]
    whole = langid.words_of(langid.texts_of(pa.array(texts)))
    at = 0
    for t in texts:
        alone = langid.words_of(langid.texts_of(pa.array([t])))
        n = len(t.encode())
        assert (whole.buckets[at : at + n] == alone.buckets).all(), t
        at += n


ALPHABET = {"Latin": "etaoinshrdlu", "Cyrillic": "оеаинтсрвлкм", "Greek": "αοιετσνηυρπκ"}


def made_up(rng, lang, n):
    """Words of a made-up language: an order of letters of its script, by its number."""
    letters = list(ALPHABET[list(ALPHABET)[lang % 3]])
    random.Random(lang).shuffle(letters)
    return " ".join("".join(letters[min(int(rng.expovariate(0.5)), 11)] for _ in range(rng.randrange(2, 9))) for _ in range(n))


def plain(train, texts):
    """Language and score of each text by dictionaries and a table of best paths, word by word."""
    import math
    import re

    def grams(word):
        raw = b" " + bytes(langid._GAP[list(word.encode())]) + b" "
        three = [(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) for i in range(len(raw) - 2) if raw[i + 1] != 0x20]
        return [((x * 0x9E3779B1) & 0xFFFFFFFF) >> 17 for x in three]

    def script(word):
        for c in word:
            if c.isalpha():
                return next((k for k, ranges in langid.SCRIPTS.items() if any(x <= ord(c) <= y for x, y in ranges)), "other")
        return None

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    langs = sorted({x for _, x in train})
    counts, scripts = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for t, x in train:
        for w in words(t):
            counts[x].update(grams(w))
            scripts[x][script(w)] += 1
    total = {x: sum(counts[x].values()) + langid.SMOOTH * langid.BUCKETS for x in langs}
    share = lambda x, s: scripts[x][s] >= langid.LEAST_SHARE * max(1, sum(n for k, n in scripts[x].items() if k))
    out = []
    for t in texts:
        own = words(t)
        best, back = None, []
        for w in own:
            s = script(w)
            may = [x for x in langs if share(x, s) and scripts[x][s]] or langs
            row = [0.0 if s is None else sum(math.log((counts[x][g] + langid.SMOOTH) / total[x]) for g in grams(w)) if x in may else -1e7 for x in langs]
            if best is None:
                best, step = row, None
            else:
                top = max(range(len(langs)), key=lambda k: best[k])
                step = [k if best[k] >= best[top] - langid.SWITCH else top for k in range(len(langs))]
                best = [max(best[k], best[top] - langid.SWITCH) + row[k] for k in range(len(langs))]
            back.append(step)
        labels = []
        if own:
            now = max(range(len(langs)), key=lambda k: best[k])
            for step in reversed(back):
                labels.append(now)
                now = step[now] if step else now
        letters = Counter()
        for w, k in zip(own, reversed(labels), strict=True):
            raw = w.encode()
            if script(w):
                letters[k] += sum(c.isalpha() and len(c.encode()) or 0 for c in w) if len(raw) == len(w) else sum(len(c.encode()) for c in w if c.isalpha())
        whole = sum(letters.values())
        out.append((langs[min(letters, key=lambda k: (-letters[k], k))], max(letters.values()) / whole) if whole else ("und", 0.0))
    return out


@pytest.mark.parametrize("count", [4, 40])
def test_predictions_and_scores_are_those_of_a_plain_account(spark, count):
    rng = random.Random(count)
    train = [(made_up(rng, k, 120), f"l{k:02}") for k in range(count) for _ in range(3)]
    texts = [made_up(rng, rng.randrange(count), rng.randrange(1, 30)) + " 12 " + made_up(rng, rng.randrange(count), rng.randrange(30)) for _ in range(120)] + ["123 ...", "", "7"]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string").repartition(5))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: (r.lang_pred, r.score) for r in langid.label(df, model, keep=("i",)).collect()}
    want = plain(train, texts)
    assert [(got[i][0], round(got[i][1], 9)) for i in range(len(texts))] == [(x, round(v, 9)) for x, v in want]


def test_pieces_of_a_long_text_give_what_the_whole_gives(spark, monkeypatch):
    rng = random.Random(7)
    train = [(made_up(rng, k, 200), f"l{k}") for k in range(6)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    texts = [" ".join(made_up(rng, rng.randrange(6), rng.randrange(1, 60)) for _ in range(40)), "x" * 40_000 + " " + made_up(rng, 1, 400), "語" * 20_000, "1 " * 30_000, "é" * 40_001]
    column = langid.texts_of(pa.array(texts))
    whole = list(langid.labelled(model, column, spans=True))
    monkeypatch.setattr(langid, "BUDGET", 1)
    monkeypatch.setattr(langid, "LONG_BYTES", 1)
    monkeypatch.setattr(langid, "LONG_WORD", langid.LONG_WORD)
    assert list(langid.labelled(model, column, spans=True)) == whole
    assert len(whole[0][2]) > 3 and whole[3][:2] == ("und", 0.0)


def test_every_language_of_a_column_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TABLES", 3)
    rng = random.Random(1)
    train = [(made_up(rng, k, 150), f"l{k:03}") for k in range(90)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string").coalesce(1))
    assert model.langs == [f"l{k:03}" for k in range(90)]
    got = [x[0] for x in langid.labelled(model, langid.texts_of(pa.array([t for t, _ in train])))]
    assert got == [x for _, x in train]


MEMORY = """
import random, resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, sys.argv[1])
from tallyloom.llm import langid
rng = np.random.default_rng(0)
k = 300
code = np.repeat(np.arange(k), 3001)
at = np.concatenate([np.append(rng.choice(langid.BUCKETS, 3000, False), langid.BUCKETS + 1) for _ in range(k)])
model = langid.modelled([f"l{i:03}" for i in range(k)], code, at, rng.integers(1, 50, len(code)))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
word = "".join(chr(97 + i % 26) for i in range(39)) + " "
text = word * (20_000_000 // len(word))
((lang, score, spans),) = langid.labelled(model, langid.texts_of(pa.array([text])), True)
assert score == 1.0 and spans == [(0, len(text) - 1, lang)], (lang, score, spans[:3])
print(before // 1024, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_three_hundred_languages_and_a_text_of_20_mb_fit_a_gigabyte():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", MEMORY, root], capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout.split()[1]) < 1000
