import math
import random

from tallyloom.llm import quality


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)]


def test_counts(spark):
    texts = ["a a a a b", "x\ny\nx\n\n\n x\nx", "é# *$ ü|<>\r\nb", None, "", "  ", "a b c d a b c", "one\x0btwo\x1cthree\x85four"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality.op3_quality_rules(df).collect():
        assert [r[c] for c in quality.COUNTS[:5]] == brute(texts[r.doc_id]), texts[r.doc_id]


def test_thresholds_follow_their_group(spark):
    """A share of symbols that is usual in one source is odd in another."""
    words = lambda i, gap: gap.join(f"w{i}x{j}" for j in range(60))
    rows = [(i, words(i, " "), "en", "a") for i in range(300)] + [(1000 + i, words(i, " | "), "en", "b") for i in range(300)] + [(5000, words(1, " | "), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.op3_quality_rules(df).collect()}
    assert got[5000] == (False, False)
    assert all(v == (False, True) for k, v in got.items() if k != 5000)


def test_fixture_junk_goes_and_clean_texts_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    rows = quality.judged(docs).filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.97


def test_odd_rows(odd_documents, no_documents):
    assert quality.op3_quality_rules(odd_documents).count() == odd_documents.count()
    assert quality.op3_quality_rules(no_documents).count() == 0
    assert quality.good(odd_documents).columns == odd_documents.columns


def corpus(rng, docs, size, *makers):
    """Documents of one source: words, and what each maker puts into some of them."""
    out = []
    for _ in range(docs):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(*size))]
        for share, make in makers:
            if rng.random() < share:
                words = make(rng, words)
        out.append(words)
    return out


def symbols(rate):
    return lambda rng, words: [w + ("#" if rng.random() < rate else "") for w in words]


def repeats(times):
    """A sentence of twelve words, several times, spread over the text."""

    def make(rng, words):
        own = [f"s{rng.randrange(10**6)}" for _ in range(12)]
        for _ in range(times):
            at = rng.randrange(len(words))
            words = words[:at] + own + words[at:]
        return words

    return make


def lines(words, of=10):
    return "\n".join(" ".join(words[i : i + of]) for i in range(0, len(words), of))


def limits(spark, sources):
    rows = [(lines(w), "en", s) for s, ws in sources.items() for w in ws]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    counted = df.select("lang", "source", quality.quality_counts("text").alias("counts"))
    return {r.source: {k: math.exp(r.limits[k].high) for k in list(quality.FEATURES)[1:]} for r in quality.limits_of(counted).collect()}


def test_limits_come_from_events_and_not_from_lengths(spark):
    """Texts cut in half have the same limits within a quarter, as rates of shorter texts scatter more; texts without events have lower ones."""
    rng = random.Random(5)
    whole = corpus(rng, 800, (600, 2000), (0.6, symbols(0.02)), (0.4, repeats(3)))
    half = [w[: len(w) // 2] for w in whole] + [w[len(w) // 2 :] for w in whole]
    clean = corpus(rng, 800, (600, 2000))
    short = corpus(rng, 800, (60, 120))
    got = {k: limits(spark, {k: ws})[k] for k, ws in {"whole": whole, "half": half, "clean": clean, "short": short}.items()}
    assert abs(math.log(got["half"]["symbols_per_word"] / got["whole"]["symbols_per_word"])) < 0.25
    assert got["whole"]["symbols_per_word"] > 4 * got["clean"]["symbols_per_word"]
    assert got["whole"]["repeat_word_share"] > 1.5 * got["clean"]["repeat_word_share"]
    assert all(abs(got["clean"][k] / got["short"][k] - 1) < 1e-9 for k in quality.USUAL)


def test_junk_lifts_no_limit_and_each_rule_rejects_its_own(spark):
    """A third of a source is junk of one kind; clean texts, some with a few events, stay in all sources."""
    rng = random.Random(3)
    few = ((0.1, symbols(0.01)), (0.15, repeats(2)))
    junk = {
        "symbols": [lines(w) for w in corpus(rng, 90, (200, 900), (1, symbols(0.4)))],
        "lines": ["\n".join(lines(w[:50]).split("\n") + ["same words in a line again"] * (len(w) // 5)) for w in corpus(rng, 90, (200, 400))],
        "words": [lines(w, 13) for w in corpus(rng, 90, (200, 400), (1, repeats(12)))],
        "long": [lines(["x" * 60 for _ in w]) for w in corpus(rng, 90, (200, 400))],
    }
    rows, kinds = [], {}
    for s in [*junk, "clean"]:
        for text in [*[lines(w) for w in corpus(rng, 200, (150, 1200), *few)], *junk.get(s, [])]:
            kinds[len(rows)] = s if len([1 for r in rows if r[3] == s]) >= 200 else "clean"
            rows.append((len(rows), text, "en", s))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = quality.op3_quality_rules(df).collect()
    kept = {k: [r.kept for r in out if kinds[r.doc_id] == k] for k in {*junk, "clean"}}
    assert sum(kept["clean"]) / len(kept["clean"]) > 0.99
    assert {k: sum(v) for k, v in kept.items() if k != "clean"} == dict.fromkeys(junk, 0)
