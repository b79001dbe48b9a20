import hashlib
import re
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import pii


def brute(text):
    out = []
    for k, p in enumerate(pii.PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {0: True, 1: k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 2: 16 <= len(digits) <= 19 and luhn(digits), 3: 8 <= len(digits) <= 15}[k]
            if good:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


CASES = ["a@b.c@d.e x@y", "é 1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111-1111 1111 4111111111111111 41111111111111111", "++1 (2) 34-56789 +1(23)45 ) 678 +12", "ü@x.de a.b+c%d@e-f.g-h.i.", "+1 2345678 12345678 1", "1.2.3", "@ . + 5"]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate([*CASES, None, ""])), "doc_id long, text string")
    for r in pii.op1_pii(df).collect():
        want = brute(dict(enumerate(CASES)).get(r.doc_id))
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), r.doc_id
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == i for w in want) for i in range(4)]
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def at_code_points(text):
    data = np.frombuffer(text.encode(), np.uint8)
    points = pii.code_points(data)
    return sorted((k, int(points[a]), int(points[b])) for k, a, b in pii.base_spans(data))


@settings(max_examples=400, deadline=None)
@given(st.text("a1 .-+@()95é%", max_size=60))
def test_base_spans_in_one_pass(text):
    assert at_code_points(text) == brute(text)


def test_megabytes_of_signs_take_linear_time():
    n = 1_000_000
    for text, want in [("1." + "5" * n, 0), ("@" + "a" * n, 0), ("a" * n + "@b.c", 1), ("5" * n, 0), ("a@" * (n // 2), 0), ("1.2.3." + "5" * n, 0), ("1.2.3.4 " * (n // 8), n // 8), ("+1 " * (n // 3), 0), ("+" + "1-" * (n // 2), 0)]:
        start = time.perf_counter()
        assert len(pii.base_spans(np.frombuffer(text.encode(), np.uint8))) == want
        assert time.perf_counter() - start < 20


def test_whole_fixture(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.op1_pii(docs).collect():
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(texts[r.doc_id]))
        assert r.base_sha256 == pii.digest(told)


def test_model_on_held_out_texts():
    xs, ys = pii.labelled(np.random.default_rng(1234), 300, 96)
    tags, _ = pii.trained().decode(xs.T)
    spans = lambda r: {(r[i], i, next((j for j in range(i + 1, len(r)) if r[j] != r[i] + 1), len(r))) for i in range(len(r)) if r[i] % 2}
    hit = found = gold = 0
    for a, b in zip(tags.T, ys, strict=True):
        hit, found, gold = hit + len(spans(a) & spans(b)), found + len(spans(a)), gold + len(spans(b))
    assert hit / found > 0.9 and hit / gold > 0.9


def test_model_adds_what_patterns_miss_and_leaves_clean_text():
    model = pii.trained()
    kinds = lambda t: [[*pii.KINDS, "secret"][k] for s in pii.model_spans(model, [np.frombuffer(t.encode(), np.uint8)]) for k, a, b in s if pii.plausible(k, t[a:b])]
    assert kinds("reach us on (499) 555-6503 today") == ["phone"]
    assert kinds("paid with 4111.1111.1111.1111 there") == ["card"]
    assert kinds('the token = "ce0cc631f6559e745b37cb8be6fc63ae2d235c5f" and') == kinds("set password=b7db7aa4a5fcc78305 there") == ["secret"]
    assert kinds("tracking 1Z 999 9999 9999 came") == kinds("the ISBN 978-3-161-48410-0 of it") == []
    assert kinds("in 2024-01-02 we sold 1,299.00 units of v1.2.3, page 12") == []


def test_spans_longer_than_a_window(data):
    model = pii.trained()
    for n in (90, 200, 700):
        text = "see the token = \"" + ("0a1b2c3d4e5f6789" * 50)[:n] + "\" and more of the text"
        spans = pii.model_spans(model, [np.frombuffer(text.encode(), np.uint8)])[0]
        assert any(k == pii.SECRET and b - a >= n - 2 for k, a, b in spans), (n, spans)


def test_precision_and_recall_on_planted_spans(spark, data):
    """Documents with one planted span, in a form that the patterns miss, and documents with none."""
    rng = np.random.default_rng(9)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    clean = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text and not re.search("[0-9@]", r.text)][:60]
    planted = [f"({digits(3)}) {digits(3)}-{digits(4)}" for _ in clean]
    texts = [t[:200] + " call " + p + " now " + t[200:] for t, p in zip(clean, planted, strict=True)]
    out = pii.spans_of(pii.trained(), pii.texts_of(pa.array(texts + clean)))
    hits = sum(any(k == 3 and t[a:b] == p for k, a, b in spans) for (_, spans, _), t, p in zip(out, texts, planted, strict=False))
    found = sum(len(s) + len(x) for _, s, x in out)
    assert hits / len(planted) > 0.9 and hits / max(found, 1) > 0.9


def test_gradient():
    rng = np.random.default_rng(0)
    scores, moves, tags = rng.standard_normal((5, 2, 3)), rng.standard_normal((3, 3)), rng.integers(0, 3, (5, 2))
    loss, d_scores, d_moves = pii.crf_gradient(scores, moves, tags)
    for at in [(0, 0, 0), (4, 1, 2), (2, 0, 1)]:
        more = scores.copy()
        more[at] += 1e-6
        assert abs((pii.crf_gradient(more, moves, tags)[0] - loss) / 1e-6 - d_scores[at]) < 1e-4
    more = moves.copy()
    more[1, 2] += 1e-6
    assert abs((pii.crf_gradient(scores, more, tags)[0] - loss) / 1e-6 - d_moves[1, 2]) < 1e-4


def test_reconciled_takes_the_heaviest_set():
    assert pii.reconciled([(0, 0, 5, 3.0), (1, 4, 9, 4.0), (2, 9, 12, 1.0), (0, 0, 5, 3.0)]) == [(1, 4, 9), (2, 9, 12)]
    assert pii.reconciled([]) == []


def test_odd_rows(odd_documents, no_documents):
    assert pii.op1_pii(odd_documents).count() == odd_documents.count()
    assert pii.op1_pii(no_documents).count() == 0
    mail = pii.op1_pii(odd_documents.filter("doc_id is null and source is null and lang = 'en'")).first()
    assert (mail.n_email, mail.n_phone) == (1, 1)
