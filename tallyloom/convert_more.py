"""More converters of public datasets, by the templates of `convert`: the published columns, and questions worded here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.convert import fixed, multiple, open_set, preference, scale, tool_choice, yes_no
from tallyloom.functions.hashing import order_key


def _letter(column: str) -> Column:
    """A, B, C … as 0, 1, 2 …"""
    return F.ascii(F.upper(F.trim(column))) - 65


def _with_wrong(right: str, wrong: list[str]) -> Column:
    """The right answer and wrong ones in hash order of the right one."""
    keyed = F.transform(F.array(right, *wrong), lambda x: F.struct(order_key(0, F.col(right), x).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def _place(options: Column, right: str) -> Column:
    return (F.array_position(options, F.col(right)) - 1).cast("int")


# Labels by number, in the order that the datasets publish.
for _n, _area, _state, _label, _labels, _ask in (
    ("enron_spam", "safety", "text", "label", ("ham", "spam"), "Is the mail wanted?"),
    ("phishing", "safety", "text", "label", ("legitimate", "phishing"), "Is the message a phishing attempt?"),
    ("prompt_injection", "security", "text", "label", ("harmless", "injection"), "Does the text try to take over a model?"),
    ("safeguard_injection", "security", "text", "label", ("harmless", "injection"), "Does the prompt hide other instructions?"),
    ("hate_offensive", "safety", "tweet", "class", ("hate", "offensive", "neither"), "How does the post treat others?"),
    ("subjectivity", "language", "text", "label", ("objective", "subjective"), "Does the sentence tell a fact or a view?"),
    ("fin_tweets", "finance", "text", "label", ("bearish", "bullish", "neutral"), "What does the post expect of the market?"),
    ("tweet_emotion", "sentiment", "text", "label", ("anger", "joy", "optimism", "sadness"), "Which feeling does the post show?"),
    ("contract_nli", "legal", {"contract": "premise", "statement": "hypothesis"}, "label", ("contradiction", "entailment", "neutral"), "What does the contract say of the statement?"),
    ("tabfact", "tables", {"table": "table_text", "statement": "statement"}, "label", ("refuted", "entailed"), "Does the table bear out the statement?"),
    ("patents", "topic", "text", "label", ("human_necessities", "operations", "chemistry", "textiles", "constructions", "mechanics", "physics", "electricity", "general"), "In which section is the patent?"),
    ("cold", "zh", "TEXT", "label", ("正常", "冒犯"), "这段话有冒犯性吗？"),
    ("weibo_senti", "zh", "review", "label", ("消极", "积极"), "这条微博是什么情绪？"),
    ("zh_waimai", "zh", "review", "label", ("差评", "好评"), "顾客对外卖满意吗？"),
    ("zh_shopping", "zh", "review", "label", ("差评", "好评"), "买家对商品满意吗？"),
    ("toxicn", "zh", "content", "toxic", ("无毒", "有毒"), "这条评论有毒吗？"),
):
    fixed(_n, _area, _state, _label, {str(i): (k, "") for i, k in enumerate(_labels)}, _ask)
fixed("aegis2", "safety", "prompt", "prompt_label", {k: (k, "") for k in ("safe", "unsafe")}, "Is it safe to answer the prompt?")
fixed("c_stance", "zh", {"文本": "Text", "对象": "Target"}, "Stance", {k: (k, "") for k in ("支持", "反对", "中立")}, "作者对该对象持什么立场？")

# Labels that the table holds.
for _n, _area, _state, _label in (
    ("atis", "intent", "text", "intent"),
    ("bitext_support", "intent", "instruction", "intent"),
    ("massive_scenario", "intent", "text", "label_text"),
    ("minds14", "intent", "transcription", "intent_class"),
    ("slurp", "intent", "sentence", "intent"),
    ("newsgroups20", "topic", "text", "label_text"),
    ("fin_news_topic", "finance", "text", "label"),
    ("ledgar", "legal", "text", "label"),
    ("support_tickets", "support", "body", "queue"),
    ("meld", "dialogue", "Utterance", "Emotion"),
    ("cail2018", "zh", "fact", "accusation"),
    ("thucnews", "zh", "content", "label"),
    ("kuake_qic", "zh", "query", "label"),
    ("csl_discipline", "zh", "abst", "discipline"),
):
    open_set(_n, _area, _state, _label, "属于哪一类？" if _area == "zh" else "Which class is it?")

# Yes or no.
for _n, _area, _state, _label, _ask in (
    ("beavertails", "safety", {"prompt": "prompt", "response": "response"}, "is_safe", "Is the response safe?"),
    ("hyperpartisan", "media", "text", "hyperpartisan", "Does the article follow one party blindly?"),
    ("multirc", "reading", {"paragraph": "paragraph", "question": "question", "answer": "answer"}, "label", "Is the answer right?"),
    ("wiki_qa", "retrieval", {"question": "question", "sentence": "answer"}, "label", "Does the sentence answer the question?"),
    ("fake_jobs", "security", "text", "fraudulent", "Is the job offer a fraud?"),
    ("cladder", "reasoning", "prompt", "answer", "Is the answer yes?"),
    ("legalbench_consumer_contracts", "legal", {"contract": "contract", "question": "question"}, "answer", "Is the answer yes?"),
    ("legalbench_cuad", "legal", "text", "answer", "Does the clause say so?"),
    ("chip_sts", "zh", {"甲": "text1", "乙": "text2"}, "label", "两句话意思相同吗？"),
    ("bq_corpus", "zh", {"甲": "sentence1", "乙": "sentence2"}, "label", "两个问题意思相同吗？"),
):
    yes_no(_n, _area, _state, _label, _ask)

# Scales.
scale("amazon_stars", "sentiment", "text", lambda: F.col("label"), ["one star", "two stars", "three stars", "four stars", "five stars"], "How many stars did the buyer give?")
scale("liar2", "media", "statement", lambda: F.col("label"), ["a gross lie", "false", "mostly false", "half true", "mostly true", "true"], "How true is the statement?")
scale("kuake_qtr", "zh", {"查询": "query", "标题": "title"}, lambda: F.col("label").try_cast("int"), ["不相关", "略相关", "较相关", "完全相关"], "标题与查询有多相关？")
scale("kuake_qqr", "zh", {"甲": "query1", "乙": "query2"}, lambda: F.col("label").try_cast("int"), ["不同", "部分相同", "相同"], "两个查询的意思有多接近？")

# Each row's own options.
_GPQA = ["Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"]
multiple("gpqa_main", "knowledge", "Question", lambda: _with_wrong("Correct Answer", _GPQA), lambda: _place(_with_wrong("Correct Answer", _GPQA), "Correct Answer"))
multiple("reclor", "reasoning", {"context": "context", "question": "question"}, lambda: F.col("answers"), lambda: F.col("label").cast("int"))
multiple("musr", "reasoning", {"story": "narrative", "question": "question"}, lambda: F.col("choices"), lambda: F.col("answer_index").cast("int"))
multiple("case_hold", "legal", "context", lambda: F.col("endings"), lambda: F.col("label").cast("int"), "Which holding does the citation stand for?")
multiple("cmmlu", "zh", "Question", lambda: F.array("A", "B", "C", "D"), lambda: _letter("Answer"), "哪个选项正确？")
multiple("ceval_val", "zh", "question", lambda: F.array("A", "B", "C", "D"), lambda: _letter("answer"), "哪个选项正确？")

# Two answers, and tools.
preference("halueval_summ", "reading", "document", "right_summary", "hallucinated_summary")
preference("skywork_pref", "preference", "prompt", "chosen", "rejected")
preference("zhihu_rlhf", "zh", "prompt", "chosen", "rejected")
preference("cvalues_rlhf", "zh", "prompt", "pos_resp", "neg_resp")
tool_choice("glaive_tools", "tools", "query", "tools", "tool")
tool_choice("hermes_tools", "tools", "query", "tools", "tool")
