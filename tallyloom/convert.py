"""Converters: tables of public datasets, as they are published, to records.

A converter is a template and the columns that it reads. `CONVERTERS.find(name)(df)` gives records
of a table with the dataset's published columns; `registered(name, path)` makes it a dataset of
the catalog that is read from files under a path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.catalog import BENCHMARKS, DATASETS, Benchmark, Dataset, Registry, expanded
from tallyloom.functions import text as X
from tallyloom.functions.hashing import order_key, stable_id, uniform
from tallyloom.functions.tiers import tier_of
from tallyloom.operators import augment, filters, history, records, votes
from tallyloom.operators.sampling import take
from tallyloom.sources.readers import read_any

CONVERTERS = Registry("converter")
AREAS: dict[str, str] = {}


def _put(name: str, area: str, f: Callable[[DataFrame], DataFrame]) -> None:
    CONVERTERS.register(name, f)
    AREAS[name] = area


def fixed(name: str, area: str, state: dict[str, str] | str, label: str, labels: dict[str, tuple[str, str]], instructions: str) -> None:
    """A choice among fixed labels: raw label -> (key, description). The state is a column, or several under names."""

    def build(df: DataFrame) -> DataFrame:
        raw = F.col(label).cast("string")
        key = F.lit(None).cast("string")
        for old, (new, _) in labels.items():
            key = F.when(raw == old, new).otherwise(key)
        return records.choice_records(df, source=name, state=_state(state), instructions=instructions, choices=list(dict(labels.values()).items()), label=key, area=area)

    _put(name, area, build)


def open_set(name: str, area: str, state: dict[str, str] | str, label: str, instructions: str) -> None:
    """A choice among the labels that the table holds."""
    _put(name, area, lambda df: records.classification(df, source=name, state=_state(state), label=label, instructions=instructions, area=area))


def yes_no(name: str, area: str, state: dict[str, str] | str, label: str, instructions: Column | str) -> None:
    _put(name, area, lambda df: records.noul_records(df, source=name, state=_state(state), instructions=instructions() if callable(instructions) else instructions, label=F.col(label).cast("string"), area=area))


def scale(name: str, area: str, state: dict[str, str] | str, level: Callable[[], Column], levels: list[str], instructions: str) -> None:
    _put(name, area, lambda df: records.score_records(df, source=name, state=_state(state), instructions=instructions, levels=levels, level=level(), area=area))


def multiple(name: str, area: str, state: dict[str, str] | str, options: Callable[[], Column], gold: Callable[[], Column], instructions: str = "Which answer is right?") -> None:
    """A choice among each row's own options."""
    _put(name, area, lambda df: records.mcq_records(df, source=name, state=_state(state), instructions=instructions, choices=options(), gold=gold(), area=area))


def _state(state: dict[str, str] | str) -> Column:
    if isinstance(state, str):
        return F.col(state).cast("string")
    return F.to_json(F.struct(*[F.col(c).alias(k) for k, c in state.items()]))


def preference(name: str, area: str, prompt: str, good: str, bad: str, seed: int = 0) -> None:
    """Two answers in the order of a coin; equal ones go."""

    def build(df: DataFrame) -> DataFrame:
        coin = F.conv(F.substring(order_key(seed, F.col(prompt), F.col(good)), 1, 8), 16, 10).cast("long") % 2 == 1
        first, second = F.when(coin, F.col(bad)).otherwise(F.col(good)), F.when(coin, F.col(good)).otherwise(F.col(bad))
        rows = df.filter(F.col(good) != F.col(bad))
        state = F.to_json(F.struct(F.col(prompt).alias("prompt"), first.alias("answer_a"), second.alias("answer_b")))
        return records.choice_records(rows, source=name, state=state, instructions="Which answer is better?", choices=[("a", "The first answer"), ("b", "The second answer")], label=F.when(coin, "b").otherwise("a"), area=area)

    _put(name, area, build)


def tool_choice(name: str, area: str, request: str, tools: str, gold: str, most: int = 8, seed: int = 0) -> None:
    """Which tool of a catalog (an array of names) a request needs: the gold tool and others in hash order, under their names."""

    def build(df: DataFrame) -> DataFrame:
        rows = df.filter(F.array_contains(tools, F.col(gold)) & (F.size(F.array_distinct(tools)) >= 2))
        opts = F.transform(F.array_distinct(tools), lambda t: F.struct(t.alias("key"), F.lit("").alias("description")))
        fitted = augment.fitted(augment.shuffled(opts, seed, F.col(request)), F.col(gold), most, seed, F.col(request))
        return records.record(rows, source=name, state=F.col(request), questions=[records.question("tool", "choice", "Which tool does the request need?", fitted)], targets=[records.target("tool", F.col(gold))], area=area)

    _put(name, area, build)


def next_step(name: str, area: str, episode: str, step: str, action: str, seen: int = 4, others: int = 3, seed: int = 0) -> None:
    """What an agent does next, after the last steps of an episode: its action and the different ones that come later. Steps with none are dropped."""

    def build(df: DataFrame) -> DataFrame:
        rows = history.last_items(df, episode, [step], F.col(action), seen)
        rows = history.later_steps(rows, episode, step, action, 4 * others)
        wrong = F.slice(F.array_except("later", F.array(action)), 1, others)
        rows = rows.withColumn("wrong__", wrong).filter(F.size("wrong__") > 0)
        every = F.concat(F.array(action), F.col("wrong__"))
        dealt = F.transform(F.array_sort(F.transform(every, lambda x: F.struct(order_key(seed, F.col(episode), F.col(step), x).alias("h"), x.alias("x")))), lambda s: s["x"])
        rows = rows.withColumn("options__", dealt)
        state = F.to_json(F.struct(F.col("history").alias("done")))
        id_ = stable_id(F.lit(name), F.col(episode), F.col(step))
        return records.mcq_records(rows, source=name, state=state, instructions="What is the next step?", choices=F.col("options__"), gold=(F.array_position("options__", F.col(action)) - 1).cast("int"), area=area, id_=id_)

    _put(name, area, build)


def gap(name: str, area: str, text: str, mark: str, answers: str, candidates: str, instructions: str, seed: int = 0) -> None:
    """Which candidate fits one of the gaps of a text (chosen by hash), when the others are filled."""

    def build(df: DataFrame) -> DataFrame:
        at = F.floor(uniform(seed, F.col(text)) * F.size(answers)).cast("int")
        rows = df.filter(F.size(answers) > 0).withColumn("at__", at).withColumn("cloze__", X.cloze(F.col(text), mark, F.col(answers), F.col("at__")))
        gold = (F.array_position(F.col(candidates), F.get(F.col(answers), F.col("at__"))) - 1).cast("int")
        return records.mcq_records(rows, source=name, state=F.col("cloze__"), instructions=instructions, choices=F.col(candidates), gold=gold, area=area)

    _put(name, area, build)


def long_document(name: str, area: str, document: str, question: str, options: Callable[[], Column], gold: Callable[[], Column], most_chars: int = 24_000) -> None:
    """A choice about a document within a budget of characters; longer ones are dropped, not cut."""

    def build(df: DataFrame) -> DataFrame:
        rows = filters.within_budget(df, F.col(document), most_chars)
        return records.mcq_records(rows, source=name, state=_state({"document": document, "question": question}), instructions="Which answer does the document support?", choices=options(), gold=gold(), area=area)

    _put(name, area, build)


def routing(name: str, area: str, prompt: str, model: str, score: str, least: float = 0.8) -> None:
    """Which tier of models a prompt needs: the cheapest with a score that is good enough, by a row for each prompt and model."""

    def build(df: DataFrame) -> DataFrame:
        tiers = ["fast", "mid", "strong"]
        tier = F.array_position(F.array(*map(F.lit, tiers)), tier_of(F.col(model))) - 1
        found = votes.cheapest(df.withColumn("tier__", tier).filter("tier__ >= 0"), prompt, F.col("tier__"), F.col(score) >= least, tiers)
        return records.choice_records(found, source=name, state=F.col(prompt), instructions="Which model does the request need?", choices=[("fast", "A small, cheap one"), ("mid", "One of medium size"), ("strong", "The strongest")], label=F.col("tier"), area=area)

    _put(name, area, build)


def extraction(name: str, area: str, text: str, values: dict[str, str], instructions: str = "Is this what the text says?") -> None:
    """A yes/no question for each of several columns with a truth value, on one state."""

    def build(df: DataFrame) -> DataFrame:
        ask = [records.question(k, "noul", f"{instructions} {d}", records.options(records.YES_NO)) for k, d in values.items()]
        said = [records.target(k, records.canonical_label(F.lit("noul"), F.col(k).cast("string"))) for k in values]
        known = F.col(text).isNotNull()
        for k in values:
            known = known & F.col(k).isNotNull()
        return records.record(df.filter(known), source=name, state=F.col(text), questions=ask, targets=said, area=area)

    _put(name, area, build)


_letters = lambda c: (F.ascii(F.upper(F.col(c))) - 65)
_after = lambda labels, c: (F.array_position(F.col(labels), F.col(c)) - 1).cast("int")
_NLI = {"0": ("entailment", "The hypothesis follows"), "1": ("neutral", "It may be true or not"), "2": ("contradiction", "It is false")}
_PAIR = {"premise": "premise", "hypothesis": "hypothesis"}

# Published columns of public datasets.
for _n in ("mnli", "snli", "anli"):
    fixed(_n, "nli", _PAIR, "label", _NLI, "Does the hypothesis follow from the premise?")
fixed("rte", "nli", {"premise": "sentence1", "hypothesis": "sentence2"}, "label", {"0": ("entailment", "The hypothesis follows"), "1": ("not_entailment", "It does not")}, "Does the hypothesis follow?")
fixed("sst2", "sentiment", "sentence", "label", {"0": ("negative", ""), "1": ("positive", "")}, "What is the sentiment?")
fixed("imdb", "sentiment", "text", "label", {"0": ("negative", ""), "1": ("positive", "")}, "What does the reviewer think of the film?")
fixed("ag_news", "topic", "text", "label", {"0": ("world", "World"), "1": ("sports", "Sports"), "2": ("business", "Business"), "3": ("science", "Science and technology")}, "What is the article about?")
scale("sst5", "sentiment", "text", lambda: F.col("label"), ["very negative", "negative", "neutral", "positive", "very positive"], "How positive is the sentence?")
scale("stsb", "similarity", {"first": "sentence1", "second": "sentence2"}, lambda: F.bround(F.col("score") * 5).cast("int"), ["unrelated", "same topic", "some details", "roughly equal", "mostly equal", "equal"], "How similar are the sentences?")
open_set("banking77", "intent", "text", "label_text", "What does the customer want?")
open_set("clinc150", "intent", "text", "intent", "What does the user want?")
yes_no("boolq", "reading", {"passage": "passage", "question": "question"}, "answer", "Is the answer to the question yes?")
yes_no("qqp", "pairs", {"first": "question1", "second": "question2"}, "label", "Do both questions ask the same?")
yes_no("mrpc", "pairs", {"first": "sentence1", "second": "sentence2"}, "label", "Do both sentences say the same?")
yes_no("toxic_chat", "safety", "user_input", "toxicity", "Is the message toxic?")
multiple("mmlu", "knowledge", "question", lambda: F.col("choices"), lambda: F.col("answer").cast("int"))
multiple("arc", "knowledge", "question", lambda: F.col("choices.text"), lambda: _after("choices.label", "answerKey"))
multiple("openbookqa", "knowledge", "question_stem", lambda: F.col("choices.text"), lambda: _after("choices.label", "answerKey"))
multiple("csqa", "commonsense", "question", lambda: F.col("choices.text"), lambda: _after("choices.label", "answerKey"))
multiple("hellaswag", "commonsense", "ctx", lambda: F.col("endings"), lambda: F.col("label").try_cast("int"), "Which ending fits?")
multiple("winogrande", "commonsense", "sentence", lambda: F.array("option1", "option2"), lambda: F.col("answer").try_cast("int") - 1, "What does the gap stand for?")
multiple("piqa", "commonsense", "goal", lambda: F.array("sol1", "sol2"), lambda: F.col("label").cast("int"), "Which way works?")
multiple("race", "reading", {"article": "article", "question": "question"}, lambda: F.col("options"), lambda: _letters("answer"))
multiple("sciq", "knowledge", {"support": "support", "question": "question"}, lambda: F.transform(F.array_sort(F.transform(F.array("correct_answer", "distractor1", "distractor2", "distractor3"), lambda x: F.struct(order_key(0, F.col("question"), x).alias("h"), x.alias("x")))), lambda s: s["x"]), lambda: (F.array_position(F.transform(F.array_sort(F.transform(F.array("correct_answer", "distractor1", "distractor2", "distractor3"), lambda x: F.struct(order_key(0, F.col("question"), x).alias("h"), x.alias("x")))), lambda s: s["x"]), F.col("correct_answer")) - 1).cast("int"))
preference("pairwise", "preference", "prompt", "chosen", "rejected")

# Labels by number, in the order that the datasets publish.
_numbered = lambda *keys: {str(i): (k, "") for i, k in enumerate(keys)}
for _n, _area, _state_, _labels, _ask in (
    ("emotion", "sentiment", "text", ("sadness", "joy", "love", "anger", "fear", "surprise"), "Which feeling does the text express?"),
    ("rotten_tomatoes", "sentiment", "text", ("negative", "positive"), "Does the critic like the film?"),
    ("yelp_polarity", "sentiment", "text", ("negative", "positive"), "Was the customer satisfied?"),
    ("amazon_polarity", "sentiment", {"title": "title", "review": "content"}, ("negative", "positive"), "Does the buyer like the product?"),
    ("financial_phrasebank", "sentiment", "sentence", ("negative", "neutral", "positive"), "What does the sentence mean for an investor?"),
    ("tweet_sentiment", "sentiment", "text", ("negative", "neutral", "positive"), "What is the tone of the post?"),
    ("tweet_irony", "sentiment", "text", ("literal", "ironic"), "Is the post meant literally?"),
    ("tweet_hate", "safety", "text", ("harmless", "hateful"), "Does the post attack a group?"),
    ("tweet_offensive", "safety", "text", ("inoffensive", "offensive"), "Is the post offensive?"),
    ("sms_spam", "safety", "sms", ("ham", "spam"), "Is the message wanted?"),
    ("trec", "topic", "text", ("abbreviation", "entity", "description", "human", "location", "number"), "What kind of answer does the question want?"),
    ("dbpedia14", "topic", {"title": "title", "text": "content"}, ("company", "school", "artist", "athlete", "office_holder", "transport", "building", "nature", "village", "animal", "plant", "album", "film", "writing"), "What is the article about?"),
    ("yahoo_topics", "topic", {"title": "question_title", "text": "question_content"}, ("society", "science", "health", "education", "computers", "sports", "business", "entertainment", "family", "politics"), "Where does the question belong?"),
    ("cola", "language", "sentence", ("wrong", "right"), "Is the sentence grammatical?"),
    ("qnli", "nli", {"question": "question", "sentence": "sentence"}, ("answers", "does_not"), "Does the sentence answer the question?"),
    ("wnli", "nli", {"first": "sentence1", "second": "sentence2"}, ("does_not", "follows"), "Does the second sentence follow from the first?"),
    ("paws", "pairs", {"first": "sentence1", "second": "sentence2"}, ("other", "same"), "Do both sentences mean the same?"),
    ("pawsx", "pairs", {"first": "sentence1", "second": "sentence2"}, ("other", "same"), "Do both sentences mean the same, whatever their language?"),
    ("xnli", "nli", _PAIR, ("entailment", "neutral", "contradiction"), "Does the hypothesis follow, in its language?"),
    ("cb", "nli", _PAIR, ("entailment", "contradiction", "neutral"), "What does the passage say of the hypothesis?"),
    ("docnli", "longdoc", {"document": "premise", "claim": "hypothesis"}, ("entailment", "not_entailment"), "Does the document support the claim?"),
    ("wic", "language", {"word": "word", "first": "sentence1", "second": "sentence2"}, ("other", "same"), "Does the word mean the same in both sentences?"),
    ("ocnli", "zh", {"前提": "sentence1", "假设": "sentence2"}, ("entailment", "neutral", "contradiction"), "假设能否由前提推出？"),
    ("cmnli", "zh", {"前提": "sentence1", "假设": "sentence2"}, ("neutral", "entailment", "contradiction"), "假设与前提是什么关系？"),
    ("afqmc", "zh", {"甲": "sentence1", "乙": "sentence2"}, ("不同", "相同"), "两个问句意思相同吗？"),
    ("lcqmc", "zh", {"甲": "sentence1", "乙": "sentence2"}, ("不同", "相同"), "两句话问的是同一件事吗？"),
    ("chnsenticorp", "zh", "text", ("消极", "积极"), "这条评论是什么态度？"),
):
    fixed(_n, _area, _state_, "label", _numbered(*_labels), _ask)
fixed("wanli", "nli", _PAIR, "gold", {k: (k, "") for k in ("entailment", "neutral", "contradiction")}, "Does the hypothesis follow?")
fixed("scitail", "nli", _PAIR, "label", {"entails": ("entails", ""), "neutral": ("neutral", "")}, "Does the fact support the hypothesis?")
fixed("fever", "reading", {"claim": "claim", "evidence": "evidence"}, "label", {"SUPPORTS": ("supported", ""), "REFUTES": ("refuted", ""), "NOT ENOUGH INFO": ("unknown", "")}, "What does the evidence say of the claim?")
fixed("pubmedqa", "medical", {"context": "context", "question": "question"}, "final_decision", {k: (k, "") for k in ("yes", "no", "maybe")}, "What does the study find?")
fixed("esci", "retrieval", {"query": "query", "product": "product_title"}, "esci_label", {"E": ("exact", "What was asked for"), "S": ("substitute", "Something like it"), "C": ("complement", "It goes with it"), "I": ("irrelevant", "Something else")}, "How does the product fit the query?")
for _n, _label in (("massive", "intent"), ("snips", "label_text"), ("hwu64", "label_text"), ("iflytek", "label_des"), ("tnews", "label_desc"), ("case_topics", "issue_area"), ("arxiv_fields", "field"), ("goemotions_single", "emotion")):
    open_set(_n, "zh" if _n in ("iflytek", "tnews") else "intent" if _n in ("massive", "snips", "hwu64") else "topic", "sentence" if _n in ("iflytek", "tnews") else "text", _label, "Which class does the text belong to?")
yes_no("jailbreak_classification", "safety", "prompt", "jailbreak", "Does the prompt try to get around rules?")
yes_no("strategyqa", "commonsense", "question", "answer", "Is the answer yes?")
yes_no("hover", "retrieval", {"claim": "claim", "evidence": "evidence"}, "supported", "Does the evidence support the claim?")
yes_no("sharc_relevant", "longdoc", {"rule": "snippet", "question": "question"}, "answer", "Does the rule allow it?")
yes_no("retrieval_relevance", "retrieval", {"query": "query", "passage": "passage"}, "relevant", "Does the passage answer the query?")
for _n, _c in (("helpsteer2", "helpfulness"), ("helpsteer2_correctness", "correctness"), ("helpsteer2_coherence", "coherence")):
    scale(_n, "preference", {"prompt": "prompt", "response": "response"}, lambda c=_c: F.col(c), ["very bad", "bad", "fair", "good", "very good"], f"How good is the response in {_c}?")
scale("ultrafeedback", "preference", {"prompt": "instruction", "response": "response"}, lambda: (F.bround("overall_score") - 1).cast("int"), [str(i) for i in range(1, 11)], "How good is the response, from 1 to 10?")
scale("yelp_full", "sentiment", "text", lambda: F.col("label"), ["one star", "two stars", "three stars", "four stars", "five stars"], "How many stars does the review give?")
multiple("mmlu_pro", "knowledge", "question", lambda: F.col("options"), lambda: F.col("answer_index").cast("int"))
multiple("medmcqa", "medical", "question", lambda: F.array("opa", "opb", "opc", "opd"), lambda: F.col("cop").cast("int"))
multiple("medqa", "medical", "question", lambda: F.col("options.value"), lambda: _after("options.key", "answer_idx"))
multiple("logiqa", "reasoning", {"context": "context", "question": "query"}, lambda: F.col("options"), lambda: F.col("correct_option").cast("int"))
multiple("cosmosqa", "commonsense", {"context": "context", "question": "question"}, lambda: F.array("answer0", "answer1", "answer2", "answer3"), lambda: F.col("label").cast("int"))
multiple("social_iqa", "commonsense", {"context": "context", "question": "question"}, lambda: F.array("answerA", "answerB", "answerC"), lambda: F.col("label").try_cast("int") - 1)
multiple("copa", "commonsense", {"premise": "premise", "question": "question"}, lambda: F.array("choice1", "choice2"), lambda: F.col("label").cast("int"))
multiple("qasc", "knowledge", {"fact": "combinedfact", "question": "question"}, lambda: F.col("choices.text"), lambda: _after("choices.label", "answerKey"))
multiple("dream", "reading", {"dialogue": "dialogue", "question": "question"}, lambda: F.col("choice"), lambda: _after("choice", "answer"))
multiple("truthfulqa", "knowledge", "question", lambda: F.col("mc1_targets.choices"), lambda: (F.array_position("mc1_targets.labels", 1) - 1).cast("int"))
multiple("bbh_choice", "reasoning", "input", lambda: X.listed_options(F.col("input")), lambda: F.ascii(F.regexp_extract("target", r"\(([A-Z])\)", 1)) - 65)
multiple("c3", "zh", {"材料": "context", "问题": "question"}, lambda: F.col("choice"), lambda: _after("choice", "answer"), "根据材料，哪个选项正确？")
gap("chid", "zh", "content", "#idiom#", "answers", "candidates", "哪个成语适合填入空白处？")
long_document("quality", "longdoc", "article", "question", lambda: F.col("options"), lambda: F.col("gold_label").cast("int") - 1)
long_document("timeqa", "longdoc", "context", "question", lambda: F.col("options"), lambda: _after("options", "answer"))
tool_choice("toolace", "tools", "query", "tools", "tool")
tool_choice("bfcl", "tools", "question", "functions", "function")
next_step("mind2web", "agents", "task", "step", "action")
next_step("weblinx", "agents", "demo", "turn", "action")
routing("router", "control", "prompt", "model", "score")
extraction("contract_terms", "legal", "clause", {"assignment": "It forbids assignment.", "exclusivity": "It grants exclusive rights.", "renewal": "It renews by itself."})
preference("hh_rlhf", "preference", "prompt", "chosen", "rejected")
preference("reward_bench", "preference", "prompt", "chosen", "rejected")


#: Splits that are held out: each is a benchmark.
HELD_OUT = ("validation", "test")


def registered(name: str, path: str | None, splits: tuple[str, ...] = ("train",), ending: str = "parquet", **more) -> Dataset:
    """Make a converter a dataset whose splits are files or folders `path/split`. Each held-out split is a benchmark `name:split` in the suite of its area."""
    convert = CONVERTERS.find(name)

    def build(spark: SparkSession, split: str, cap: int | None) -> DataFrame:
        made = convert(read_any(spark, f"{path or f'{data_root(spark)}/{name}'}/{split}", ending)).withColumn("split", F.lit(split))
        return take(made, cap, f"{name}:{split}", F.col("id")) if cap else made

    made = DATASETS.register(name, Dataset(name, build, splits, area=AREAS[name], **more))
    for split in splits:
        if split in HELD_OUT or made.eval_only:
            BENCHMARKS.register(f"{name}:{split}", Benchmark(f"{name}:{split}", name, split, "macro_f1" if AREAS[name] == "intent" else "accuracy", AREAS[name], AREAS[name]))
    return made


def register_folder(root: str, splits: tuple[str, ...] = ("train", *HELD_OUT), **more) -> list[Dataset]:
    """All converters as datasets of `root/name/split`."""
    return [registered(name, f"{root}/{name}", splits, **more) for name in CONVERTERS]


#: The session's setting that tells where the tables of datasets are that are registered without a folder.
DATA_SETTING = "spark.tallyloom.data"


def data_root(spark: SparkSession) -> str:
    """Where the session says that tables are; an error if it says nothing."""
    root = spark.conf.get(DATA_SETTING, None)
    if not root:
        raise ValueError(f"set {DATA_SETTING} to the folder that holds the datasets' tables, or register them with a folder")
    return root.rstrip("/")


def register_defaults() -> None:
    """All converters as datasets, and their held-out splits as benchmarks, of the folder that the session names. A dataset that is registered with a folder of its own takes the place of the default."""
    with DATASETS.defaults(), BENCHMARKS.defaults():
        for name in CONVERTERS:
            registered(name, None, ("train", *HELD_OUT))


def evaluation_records(spark: SparkSession, names: list[str], cap: int | None = None) -> DataFrame:
    """The records of benchmarks or suites, to evaluate on and to keep out of a mixture."""
    parts = [DATASETS.find(b.dataset).build(spark, b.split, cap or b.max_samples) for b in expanded(names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


from tallyloom import convert_more  # noqa: E402, F401  registers its converters

register_defaults()
