"""Public classification sets as items with typed questions: one declarative spec for each task.

A spec names the role, the fields of the state, the questions with instructions and criteria, and the column and kind of each
label. `build` turns rows of any such table into (item_id, grp, role, state, stratum, qid, qtype, instructions, keys, texts,
ref, soft) rows: one for each question of each item.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions import prob as P
from decidra.functions.text import clip, humanize


class Ask(NamedTuple):
    """label kinds: index (place among options), name (a key), bool, not (its opposite), fraction (of true), level (score),
    rank (score, place of a name among `names`), unit (score, in 0..1).

    options: (key, text) pairs; none for the task's label set. A noul question's are the texts of true and false, if any.
    """

    qid: str
    qtype: str
    instructions: str
    column: str
    label: str
    options: tuple[tuple[str, str], ...] = ()
    names: tuple[str, ...] = ()


class Task(NamedTuple):
    """state: (field, column, how): how is '', 'clip', 'strip' or 'humanize'. flags: a column of named flags, each a question."""

    role: str
    state: tuple[tuple[str, str, str], ...]
    asks: tuple[Ask, ...]
    stratum: tuple[str, ...]
    flags: str = ""


def _levels(*texts: str) -> tuple[tuple[str, str], ...]:
    return tuple((str(i), text) for i, text in enumerate(texts))


def _same(*names: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, n.capitalize()) for n in names)


def _truth(true: str, false: str) -> tuple[tuple[str, str], ...]:
    return (("false", false), ("true", true))


#: The wording of questions, criteria and rubrics, the fields of states, and which sets are held out.
IN, OUT = "intask", "heldout"
TASKS = {
    "banking77": Task(IN, (("message", "text", ""),), (Ask("intent", "choice", "Which banking support intent best matches `message`?", "label_text", "name"),), ("label_text",)),
    "massive_intent": Task(OUT, (("utterance", "text", ""),), (Ask("intent", "choice", "Which voice assistant intent best matches `utterance`?", "label_text", "name"),), ("label_text",)),
    "anli_r3": Task(OUT, (("premise", "premise", ""), ("hypothesis", "hypothesis", "")), (Ask("relation", "choice", "Assuming `premise` is true, how does it relate to `hypothesis`?", "label", "index", (
        ("entailment", "The premise guarantees the hypothesis is true"), ("neutral", "The premise neither guarantees nor rules out the hypothesis"), ("contradiction", "The premise shows the hypothesis is false"))),), ("label",)),
    "emotion": Task(IN, (("text", "text", ""),), (Ask("emotion", "choice", "Which emotion does the author of `text` express most strongly?", "label", "index", _same("sadness", "joy", "love", "anger", "fear", "surprise")),), ("label",)),
    "mmlu": Task(IN, (("subject", "subject", "humanize"), ("question", "question", "")), (Ask("answer", "choice", "Which option correctly answers `question`?", "answer", "index", (("A", "choices"), ("B", "choices"), ("C", "choices"), ("D", "choices"))),), ("subject",)),
    "boolq": Task(IN, (("passage", "passage", "clip"),), (Ask("answer_is_yes", "noul", "According to `passage`, is the answer to this question yes: {question}?", "answer", "bool"),), ("answer",)),
    "paws": Task(OUT, (("sentence_1", "sentence1", ""), ("sentence_2", "sentence2", "")), (Ask("paraphrase", "noul", "Do `sentence_1` and `sentence_2` mean the same thing?", "label", "bool", _truth("Paraphrases: same meaning", "Different meaning, even if the words overlap")),), ("label",)),
    "tweet_hate": Task(IN, (("tweet", "text", ""),), (Ask("hateful", "noul", "Is `tweet` hate speech against immigrants or women?", "label", "bool", _truth("Hateful toward immigrants or women", "Not hateful toward those groups")),), ("label",)),
    "tweet_irony": Task(OUT, (("tweet", "text", ""),), (Ask("ironic", "noul", "Is `tweet` ironic or sarcastic?", "label", "bool"),), ("label",)),
    "sst2": Task(IN, (("review", "sentence", "strip"),), (Ask("positive", "noul", "Does `review` express a positive opinion of the movie?", "label", "bool"),), ("label",)),
    "toxic_chat": Task(IN, (("user_input", "user_input", "clip"),), (
        Ask("toxic", "noul", "Is `user_input` toxic, harmful, or asking for harmful content?", "toxicity", "bool"),
        Ask("jailbreak", "noul", "Is `user_input` trying to jailbreak an AI assistant into ignoring its rules?", "jailbreaking", "bool")), ("toxicity", "jailbreaking")),
    "beavertails": Task(OUT, (("prompt", "prompt", "clip"), ("response", "response", "clip")), (Ask("harmful", "noul", "Is `response` harmful, given `prompt`?", "is_safe", "not"),), ("is_safe",), "category"),
    "civil_comments": Task(OUT, (("comment", "text", "clip"),), (
        Ask("toxicity", "noul", "Is `comment` rude, disrespectful, or unreasonable enough to make someone leave a discussion?", "toxicity", "fraction"),
        Ask("insult", "noul", "Is `comment` insulting toward a person or group?", "insult", "fraction"),
        Ask("threat", "noul", "Does `comment` threaten violence or harm?", "threat", "fraction"),
        Ask("identity_attack", "noul", "Does `comment` attack someone because of their identity (race, religion, gender, ...)?", "identity_attack", "fraction"),
        Ask("obscene", "noul", "Is `comment` obscene or vulgar?", "obscene", "fraction")), ("toxicity_high",)),
    "helpsteer2": Task(IN, (("prompt", "prompt", "clip"), ("response", "response", "clip")), (
        Ask("helpfulness", "score", "How helpful is `response` for `prompt` overall?", "helpfulness", "level", _levels("Not helpful at all", "Slightly helpful", "Partially helpful", "Mostly helpful", "Fully helpful")),
        Ask("correctness", "score", "How correct and complete are the facts in `response`?", "correctness", "level", _levels("Mostly wrong or missing key facts", "Several errors or omissions", "Some errors or omissions", "Minor errors or omissions", "Fully correct and complete")),
        Ask("coherence", "score", "How clear and self-consistent is `response`?", "coherence", "level", _levels("Incoherent", "Hard to follow", "Somewhat clear with issues", "Mostly clear", "Perfectly clear and consistent")),
        Ask("complexity", "score", "How much expertise does it take to write `response`?", "complexity", "level", _levels("Basic language anyone could write", "Simple, school-level", "Some education needed", "Specialized knowledge", "Deep domain expertise")),
        Ask("verbosity", "score", "How long and detailed is `response` relative to what `prompt` asks?", "verbosity", "level", _levels("Very terse", "Short", "Moderate", "Long", "Very long and detailed"))), ("helpfulness",)),
    "amazon_reviews": Task(IN, (("review", "text", "clip"),), (Ask("stars", "score", "How many stars did the author of `review` give the product?", "label", "level", _levels("1 star: terrible", "2 stars: poor", "3 stars: average", "4 stars: good", "5 stars: excellent")),), ("label",)),
    "stsb": Task(OUT, (("sentence_1", "sentence1", ""), ("sentence_2", "sentence2", "")), (Ask("similarity", "score", "How similar in meaning are `sentence_1` and `sentence_2`?", "score", "unit", _levels(
        "Completely different topics", "Not equivalent, but on the same topic", "Not equivalent, but share some details", "Roughly equivalent, some important information differs", "Mostly equivalent, only minor details differ", "Completely equivalent")),), ("score_level",)),
    "tweet_sentiment": Task(OUT, (("tweet", "text", "strip"),), (Ask("sentiment", "score", "What sentiment does `tweet` express?", "label_text", "rank", _levels("Negative", "Neutral", "Positive"), ("negative", "neutral", "positive")),), ("label_text",)),
}
FLAG_ASK = "Does the exchange in `prompt` and `response` involve: {flag}?"
MOST_LABELS = 255


def label_set(rows: DataFrame, column: str, by: str | None = None) -> list[str]:
    """All labels of a split, by their least number or by name: as many values as the task has classes (at most 255; more are an error)."""
    named = rows.filter(F.col(column).isNotNull()).groupBy(column).agg((F.min(by) if by else F.min(column)).alias("o")).orderBy("o", column).limit(MOST_LABELS + 1).collect()
    if len(named) > MOST_LABELS:
        raise ValueError(f"{column} has more than {MOST_LABELS} labels")
    return [r[0] for r in named]


def reference(ask: Ask, keys: Column, text: bool = False) -> Column:
    """The distribution of a label. text: whether its column holds texts, of which 1, true and yes are true."""
    c, k = F.col(ask.column), F.size(keys)
    if ask.label in ("index", "level"):
        return P.one_hot(k, c.cast("int") + 1)
    if ask.label == "name":
        return P.one_hot(k, F.array_position(keys, c.cast("string")).cast("int"))
    if ask.label == "rank":
        return P.one_hot(k, F.array_position(F.array(*(F.lit(n) for n in ask.names)), c.cast("string")).cast("int"))
    if ask.label == "unit":
        return P.two_level(F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0)) * (len(ask.options) - 1), len(ask.options))
    said = F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes").cast("double")
    true = said if text and ask.label != "fraction" else c.cast("double")
    true = F.least(F.greatest(1 - true if ask.label == "not" else true, F.lit(0.0)), F.lit(1.0))
    return P.let(true, lambda p: F.array(1 - p, p))


def _options(ask: Ask, rows: DataFrame, keys_by: str | None) -> tuple[Column, Column]:
    """Keys and their texts; a noul question without criteria has no texts."""
    if ask.qtype == "noul":
        return F.array(F.lit("false"), F.lit("true")), F.array(*(F.lit(text) for _, text in ask.options)).cast("array<string>")
    if not ask.options:
        names = label_set(rows, ask.column, keys_by)
        return F.array(*(F.lit(n) for n in names)), F.array(*(humanize(F.lit(n)) for n in names))
    keys = F.array(*(F.lit(k) for k, _ in ask.options))
    if all(text in rows.columns for _, text in ask.options):  # the row's own list of choices
        return keys, F.transform(ask.options[0][1], lambda c: c.cast("string"))
    return keys, F.array(*(F.lit(text) for _, text in ask.options))


def _field(column: str, how: str) -> Column:
    text = F.col(column).cast("string")
    return {"": text, "clip": clip(text), "strip": F.trim(text), "humanize": humanize(text)}[how]


def build(rows: DataFrame, name: str, id_col: str = "id", keys_by: str | None = None) -> DataFrame:
    """The items of a task's rows; rows without a label have none. flags columns are map<string, boolean>."""
    task = TASKS[name]
    strata = {"toxicity_high": lambda: F.col("toxicity").cast("double") >= 0.5, "score_level": lambda: F.bround(F.col("score").cast("double") * 5)}
    stratum = F.concat_ws("|", *((strata[s]() if s in strata and s not in rows.columns else F.col(s)).cast("string") for s in task.stratum))
    # a question about another column's text quotes it
    quoted = lambda text: F.replace(F.lit(text), F.lit("{question}"), F.regexp_replace(F.trim("question"), r"\?+$", "")) if "{question}" in text else F.lit(text)
    asked = []
    for a in task.asks:
        keys, texts = _options(a, rows, keys_by)
        ref = F.when(F.col(a.column).isNotNull(), reference(a, keys, dict(rows.dtypes)[a.column] == "string"))
        asked.append(F.struct(F.lit(a.qid).alias("qid"), F.lit(a.qtype).alias("qtype"), quoted(a.instructions).alias("instructions"), keys.alias("keys"), texts.alias("texts"), ref.alias("ref"), F.lit(a.label in ("fraction", "unit")).alias("soft")))
    asked = F.array(*asked)
    if task.flags:
        about = lambda flag: F.replace(F.replace(flag, F.lit(","), F.lit(", ")), F.lit("_"), F.lit(" "))
        one = lambda e: F.struct(
            e["key"].alias("qid"), F.lit("noul").alias("qtype"), F.replace(F.lit(FLAG_ASK), F.lit("{flag}"), about(e["key"])).alias("instructions"), F.array(F.lit("false"), F.lit("true")).alias("keys"),
            F.array().cast("array<string>").alias("texts"), F.array(1 - e["value"].cast("double"), e["value"].cast("double")).alias("ref"), F.lit(False).alias("soft"),
        )
        asked = F.concat(asked, F.transform(F.array_sort(F.map_entries(F.coalesce(F.col(task.flags), F.expr("map()").cast("map<string,boolean>")))), one))
    state = F.to_json(F.struct(*(_field(c, how).alias(field) for field, c, how in task.state)))
    each = rows.select(F.concat(F.lit(name + "/"), F.col(id_col).cast("string")).alias("item_id"), F.lit(name).alias("grp"), F.lit(task.role).alias("role"), state.alias("state"), stratum.alias("stratum"), F.explode(asked).alias("q"))
    return each.select("item_id", "grp", "role", "state", "stratum", "q.*").filter("ref IS NOT NULL")


def train_tasks() -> list[str]:
    """The sets that may be trained on."""
    return [n for n, t in TASKS.items() if t.role == IN]


def train_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The union of several sets' rows, tagged with the name of each; columns that a set lacks are NULL."""
    union = None
    for name, rows in sorted(tables.items()):
        tagged = rows.withColumn("train_set", F.lit(name))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    if union is None:
        raise ValueError("no sets")
    return union
