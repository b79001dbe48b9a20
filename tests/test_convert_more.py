"""Converters over a row of each dataset as it is published, and the registries as they are on import."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyloom import catalog, convert
from tallyloom.operators import records

TEXT = {"text": "some text"}
PAIR = {"sentence1": "first", "sentence2": "second"}
# name, a row as published, the label that it gives (None: a key of an own option)
ROWS = [
    *[(n, TEXT | {"label": 1}, x) for n, x in (("enron_spam", "spam"), ("phishing", "phishing"), ("prompt_injection", "injection"), ("safeguard_injection", "injection"), ("subjectivity", "subjective"), ("fin_tweets", "bullish"), ("tweet_emotion", "joy"), ("patents", "operations"), ("amazon_stars", "1"))],
    *[(n, {"review": "文字", "label": 0}, x) for n, x in (("weibo_senti", "消极"), ("zh_waimai", "差评"), ("zh_shopping", "差评"))],
    ("hate_offensive", {"tweet": "t", "class": 2}, "neither"),
    ("contract_nli", {"premise": "p", "hypothesis": "h", "label": 0}, "contradiction"),
    ("tabfact", {"table_text": "a|b", "statement": "s", "label": 0}, "refuted"),
    ("cold", {"TEXT": "文", "label": 1}, "冒犯"),
    ("toxicn", {"content": "文", "toxic": 0}, "无毒"),
    ("aegis2", {"prompt": "p", "prompt_label": "unsafe"}, "unsafe"),
    ("c_stance", {"Text": "文", "Target": "物", "Stance": "反对"}, "反对"),
    *[(n, {c: "words", k: "own"}, "own") for n, c, k in (("atis", "text", "intent"), ("bitext_support", "instruction", "intent"), ("massive_scenario", "text", "label_text"), ("minds14", "transcription", "intent_class"), ("slurp", "sentence", "intent"), ("newsgroups20", "text", "label_text"), ("fin_news_topic", "text", "label"), ("ledgar", "text", "label"), ("support_tickets", "body", "queue"), ("meld", "Utterance", "Emotion"), ("cail2018", "fact", "accusation"), ("thucnews", "content", "label"), ("kuake_qic", "query", "label"), ("csl_discipline", "abst", "discipline"))],
    ("beavertails", {"prompt": "p", "response": "r", "is_safe": False}, "no"),
    ("hyperpartisan", TEXT | {"hyperpartisan": True}, "yes"),
    ("multirc", {"paragraph": "p", "question": "q", "answer": "a", "label": 1}, "yes"),
    ("wiki_qa", {"question": "q", "answer": "a", "label": 0}, "no"),
    ("fake_jobs", TEXT | {"fraudulent": 1}, "yes"),
    ("cladder", {"prompt": "p", "answer": "no"}, "no"),
    ("legalbench_consumer_contracts", {"contract": "c", "question": "q", "answer": "Yes"}, "yes"),
    ("legalbench_cuad", TEXT | {"answer": "No"}, "no"),
    ("chip_sts", {"text1": "一", "text2": "二", "label": "1"}, "yes"),
    ("bq_corpus", PAIR | {"label": 0}, "no"),
    ("liar2", {"statement": "s", "label": 5}, "5"),
    ("kuake_qtr", {"query": "q", "title": "t", "label": "3"}, "3"),
    ("kuake_qqr", {"query1": "q", "query2": "t", "label": "2"}, "2"),
    ("gpqa_main", {"Question": "q", "Correct Answer": "right", "Incorrect Answer 1": "w1", "Incorrect Answer 2": "w2", "Incorrect Answer 3": "w3"}, "right"),
    ("reclor", {"context": "c", "question": "q", "answers": ["w", "right"], "label": 1}, "right"),
    ("musr", {"narrative": "n", "question": "q", "choices": ["right", "w"], "answer_index": 0}, "right"),
    ("case_hold", {"context": "c", "endings": ["w", "x", "right"], "label": 2}, "right"),
    ("cmmlu", {"Question": "问", "A": "w", "B": "right", "C": "x", "D": "y", "Answer": "B"}, "right"),
    ("ceval_val", {"question": "问", "A": "w", "B": "z", "C": "x", "D": "right", "answer": "D"}, "right"),
    ("halueval_summ", {"document": "d", "right_summary": "good", "hallucinated_summary": "bad"}, None),
    *[(n, {"prompt": "p", "chosen": "good", "rejected": "bad"}, None) for n in ("skywork_pref", "zhihu_rlhf")],
    ("cvalues_rlhf", {"prompt": "p", "pos_resp": "good", "neg_resp": "bad"}, None),
    *[(n, {"query": "q", "tools": ["one", "two"], "tool": "two"}, None) for n in ("glaive_tools", "hermes_tools")],
]
OPEN = {"atis", "bitext_support", "massive_scenario", "minds14", "slurp", "newsgroups20", "fin_news_topic", "ledgar", "support_tickets", "meld", "cail2018", "thucnews", "kuake_qic", "csl_discipline"}


@pytest.mark.parametrize("name, row, label", ROWS, ids=[r[0] for r in ROWS])
def test_a_published_row_becomes_a_record(spark, name, row, label):
    rows = [row]
    if name in OPEN:  # a label set has two labels at least
        rows.append({k: "other" if v == "own" else v for k, v in row.items()})
    made = convert.CONVERTERS.find(name)(spark.createDataFrame(rows))
    assert records.valid(made).count() == len(rows)
    found = records.decisions(made).collect()
    shown = made.select(F.explode(F.col("questions")[0]["options"]).alias("o")).select("o.key", "o.description").collect()
    if label == "right":
        (r,) = found
        assert next(o.description for o in shown if o.key == r.label) == "right"
    elif label is None:
        assert all(r.label is not None for r in found)
    else:
        assert label in {r.label for r in found}


def test_every_new_converter_has_a_row():
    import inspect

    from tallyloom import convert_more

    assert inspect.getsource(convert_more).count("(") > 0
    assert len({r[0] for r in ROWS}) == len(ROWS) and {r[0] for r in ROWS} <= set(convert.CONVERTERS)


def test_registries_are_full_on_import():
    code = "from tallyloom import catalog, convert; print(len(convert.CONVERTERS), len(catalog.DATASETS), len(catalog.BENCHMARKS), len(catalog.expanded(['legal'])))"
    n, data, bench, legal = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n == data > 150 and bench == 2 * n and legal >= 8


def test_defaults_are_read_from_the_folder_that_the_session_names(spark, tmp_path):
    catalog.DATASETS.clear()
    catalog.BENCHMARKS.clear()
    convert.register_defaults()
    try:
        with pytest.raises(ValueError, match="spark.tallyloom.data"):
            convert.evaluation_records(spark, ["enron_spam:test"]).count()
        spark.createDataFrame([("buy", 1), ("hi", 0)], "text string, label int").write.parquet(f"{tmp_path}/enron_spam/test")
        spark.conf.set(convert.DATA_SETTING, str(tmp_path))
        assert convert.evaluation_records(spark, ["enron_spam:test"]).count() == 2
        own = convert.registered("enron_spam", "/elsewhere", ("train", "test"))
        assert catalog.DATASETS.find("enron_spam") is own
        with pytest.raises(KeyError, match="registered already"):
            convert.registered("enron_spam", "/elsewhere")
    finally:
        spark.conf.unset(convert.DATA_SETTING)
        catalog.DATASETS.clear()
        catalog.BENCHMARKS.clear()
        convert.register_defaults()
