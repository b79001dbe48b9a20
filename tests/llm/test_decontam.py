import random
import re

import pyarrow as pa

from tallyloom.llm import decontam

ITEM = "Maria Lopez has 12 apples and gives 5 apples to John each day until none are left for lunch. Then Maria buys 12 kg of rice at the market in town."


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.op5_decontaminate(docs, bench).collect()}


def test_reparameterised_items_are_caught_if_slots_agree(spark):
    other = "He said so. Anna Smith has 31 apples and gives 7 apples to Peter each day until none are left for lunch. Then Anna buys 31 lb of rice at the market in town. More follows."
    torn = other.replace("Then Anna buys 31", "Then Karen buys 99")
    got = found(spark, [ITEM, other, torn, "a clean text about other things that nobody asked", None, "", ITEM.upper().replace(" ", "### "), ITEM[:60]])
    assert sorted(got) == [(0, 0), (1, 0), (6, 0)]
    assert not got[0, 0].reparameterised and got[1, 0].reparameterised and got[0, 0].coverage == 1


def test_a_copy_with_one_altered_value_is_found_by_its_literal_windows(spark):
    """16 of the 24 windows stay word for word; the slots of the others do not agree."""
    got = found(spark, [ITEM.replace("buys 12 kg", "buys 13 kg")])
    assert sorted(got) == [(0, 0)]
    assert (got[0, 0].matched, got[0, 0].reparameterised) == (16, False)


LOW = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}


def tokens(text):
    """(literal, kind) of a text: kinds are 0 literal, 1 number, 2 name, 3 unit. Case is that of ASCII and Latin-1."""
    out, last, number = [], None, False
    for m in re.finditer("(?:[A-Za-z0-9]|[^\\x00-\\x7f\u2000-\u203f]|(?<=[0-9])[.,](?=[0-9]))+", text or ""):
        w = m[0]
        opens = last is None or bool(re.search(r'[.!?\n:;|"(]', text[last : m.start()]))
        last = m.end()
        if re.fullmatch("[0-9][0-9.,]*", w):
            kind = 1
        elif number and w.translate(LOW) in decontam.UNITS:
            kind = 3
        else:
            kind = 2 if not opens and len(w) > 1 and ord(w[0]) in LOW and not "A" <= w[1] <= "Z" else 0
        number = kind == 1
        out.append((w.translate(LOW), kind))
    return out


def windows(text, size):
    """(hash key, position, slots) of the windows of `size` tokens: as templates, and as they stand."""
    t = tokens(text)
    for i in range(len(t) - size + 1):
        part = t[i : i + size]
        slots = [w for w, k in part if k]
        if slots and size - len(slots) >= min(decontam.LITERALS, size):
            yield tuple(f"<{k}>" if k else w for w, k in part), i, slots
        yield tuple(w for w, _ in part), i, []


def brute(docs, items):
    """(doc, item) -> (windows that match, whether only under other values)."""
    out = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            size = min(decontam.WINDOW, len(tokens(item)))
            if not size:
                continue
            lines = {}
            mine = [*windows(text, size)]
            for key, pos, slots in windows(item, size):
                for other, at, found in mine:
                    if key == other and len(slots) == len(found):
                        lines.setdefault(at - pos, []).append((pos, slots, found))
            good, others = set(), []
            for met in lines.values():
                pairs = {p for _, s, f in met for p in zip(s, f, strict=True)}
                agree = len({s for s, _ in pairs}) == len(pairs)
                at = {pos for pos, slots, _ in met if agree or not slots}
                if at:
                    good |= at
                    others.append(agree and any(s != f for s, f in pairs))
            n = len(tokens(item)) - size + 1
            if good and len(good) >= decontam.COVERAGE * n:
                out[d, i] = (len(good), min(others))
    return out


def test_templates_and_slots_against_brute_force(spark):
    """Items and copies of them with other numbers, names and units, some of them torn, among texts of the same words."""
    rng = random.Random(11)
    words = ["the", "has", "gives", "and", "buys", "apples", "each", "day", "to", "at", "left", "rice", "of", "in"]
    names, units = ["Maria", "Anna", "John", "Karen", "Peter"], ["kg", "lb", "hours", "miles"]

    def item(n):
        out = []
        while len(out) < n:
            u = rng.random()
            out += [str(rng.randrange(2, 30))] + ([rng.choice(units)] if rng.random() < 0.5 else []) if u < 0.15 else [rng.choice(names)] if u < 0.27 else [rng.choice(words)]
        return " ".join(out[:n]) + rng.choice([".", "?", ""])

    items = [item(n) for n in (30, 18, 24, 9, 5, 12)]
    docs = [item(rng.randrange(5, 60)) for _ in range(30)] + ["", "12", "..."]
    for text in items:
        docs.append("before it. " + text + " and after")
        for _ in range(6):
            swap = {n: rng.choice(names) for n in names} | {u: rng.choice(units) for u in units} | {str(k): str(rng.randrange(2, 30)) for k in range(30)}
            copy = [re.sub(r"[A-Za-z0-9]+", lambda m, s=swap: s.get(m[0], m[0]), w) for w in text.split(" ")]
            docs.append(" ".join(copy))
            k = rng.randrange(len(copy))
            copy[k] = rng.choice([*names, "77", "word", "kg"])
            docs.append("So: " + " ".join(copy))
    want = brute(docs, items)
    got = {k: (r.matched, r.reparameterised) for k, r in found(spark, docs, items).items()}
    assert got == want and sum(o for _, o in want.values()) > 5 and len(want) > 20


def test_tokens_do_not_depend_on_the_neighbours_of_a_text():
    texts = ["ends with 14.", "5 in begins", "12", "in the middle", "", "3,", "7 kg", ".5", "x 9", "miles"]
    whole = decontam.tokens_of(decontam.texts_of(pa.array(texts)))
    for i, t in enumerate(texts):
        alone = decontam.tokens_of(decontam.texts_of(pa.array([t])))
        a, b = whole[2][i], whole[2][i + 1]
        assert (whole[0][a:b] == alone[0]).all() and (whole[1][a:b] == alone[1]).all(), t


def test_items_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six seven"), (3, "eight")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three"), (7, "five six seven"), (None, "eight"), (None, "four")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.op5_decontaminate(docs, bench).collect()}
    assert got == {(1, 7), (2, 7), (1, None), (3, None)}


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "one two", 5, 6, 7), (2, "free", 8, 9, 0)], "doc_id long, text string, key long, bad int, row int")
    out = decontam.clean(docs, spark.createDataFrame([(1, "one two")], "item_id long, text string"))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "free", 8, 9, 0)]


def test_short_items_and_repeated_texts(spark):
    got = found(spark, ["x y alpha beta gamma z", "x y alpha beta gamma z", "alpha beta"], ["Alpha, beta gamma!", "", None])
    assert sorted(got) == [(0, 0), (1, 0)]


def test_fixture_against_containment(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " " + " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())) + " "
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.op5_decontaminate(docs, bench).collect()}
    assert want and want <= got
    # More are found only where half of an item or more is there.
    assert len(got - want) <= 1 + len(want) // 5
    left = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_odd_rows(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string")
    assert {r.doc_id for r in decontam.op5_decontaminate(odd_documents, bench).collect()} == {8, 9}
    assert decontam.clean(odd_documents, bench).columns == odd_documents.columns
    assert decontam.clean(odd_documents, bench).count() == odd_documents.count() - 2
    assert decontam.clean(odd_documents, bench.limit(0)).count() == odd_documents.count()
    assert decontam.op5_decontaminate(no_documents, bench).count() == 0
