"""Recorded steps as typed columns: a state of elements and texts, questions with their options in order, labels.

Everything that changes or judges a step is an expression over these columns. Fields of the JSON that aren't named here aren't kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions.text import let

ELEMENT = "struct<index:string,id:string,role:string,label:string,current_value:string,operations:array<string>>"
ACTION = "struct<action:string,kind:string,text:string,ok:boolean,page_changed:boolean>"
WINDOW = "struct<window:string,text:string>"
STATE = f"struct<elements:array<{ELEMENT}>,page:struct<title:string,text:string>,recent_actions:array<{ACTION}>,effects_so_far:array<string>,read_in_other_windows:array<{WINDOW}>>"
OPTION = "struct<text:string,element:string,value:string,role:string,current_value:string>"
QUESTION = f"struct<type:string,goal:string,criteria:map<string,{OPTION}>>"
QUESTIONS = f"map<string,{QUESTION}>"
LABEL = "map<string,struct<choice:string,probabilities:map<string,double>>>"
MASS = "map<string,map<string,double>>"


def once(rows: DataFrame) -> DataFrame:
    """rows whose columns are worked out once for each row, however often lambdas of later expressions name them."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def replaced(value: Column, kind: str, **fields: Column) -> Column:
    """A struct of that type with some fields changed."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(kind).names
    return F.struct(*((fields[n] if n in fields else value[n]).alias(n) for n in names))


def option(**fields: Column) -> Column:
    """An option's struct; what isn't given is NULL."""
    return F.struct(*(fields.get(n, F.lit(None).cast("string")).alias(n) for n in ("text", "element", "value", "role", "current_value")))


def state_of(text: Column) -> Column:
    """A state from JSON; lists that are lacking are empty."""

    def whole(s: Column) -> Column:
        held = {"elements": ELEMENT, "recent_actions": ACTION, "effects_so_far": "string", "read_in_other_windows": WINDOW}
        return replaced(s, STATE, **{name: F.coalesce(s[name], none_of(kind)) for name, kind in held.items()})

    return let(F.from_json(text, STATE), whole)


def questions_of(text: Column) -> Column:
    """Questions from JSON. A goal is that of the instructions, or their text; an option that is no object is its text."""
    raw = F.from_json(text, "map<string,struct<type:string,instructions:string,criteria:map<string,string>>>")
    goal = lambda q: F.when(F.startswith(q["instructions"], F.lit("{")), F.get_json_object(q["instructions"], "$.goal")).otherwise(q["instructions"])
    fields = "struct<element:string,value:string,role:string,current_value:string>"

    def one(_: Column, v: Column) -> Column:
        parsed = let(F.from_json(v, fields), lambda o: option(element=o["element"], value=o["value"], role=o["role"], current_value=o["current_value"]))
        return F.when(F.startswith(v, F.lit("{")), parsed).otherwise(option(text=v))

    return F.transform_values(raw, lambda _, q: F.struct(q["type"].alias("type"), goal(q).alias("goal"), F.transform_values(q["criteria"], one).alias("criteria")))


def typed(rows: DataFrame, **more: str) -> DataFrame:
    """rows with their JSON columns state and questions typed, and others as `more` says (column=type)."""
    return once(rows.withColumns({"state": state_of(F.col("state")), "questions": questions_of(F.col("questions"))} | {c: F.from_json(c, kind) for c, kind in more.items()}))


def criteria(questions: Column, qid: Column | str) -> Column:
    """The options of a question: an empty map where it isn't asked."""
    return F.coalesce(F.try_element_at(questions, F.lit(qid) if isinstance(qid, str) else qid)["criteria"], F.create_map().cast(f"map<string,{OPTION}>"))


def put(mapping: Column, key: Column | str, value: Column) -> Column:
    """A map with a key's value changed in its place, or added at its end."""
    key = F.lit(key) if isinstance(key, str) else key
    added = F.map_from_entries(F.concat(F.map_entries(mapping), F.array(F.struct(key.alias("key"), value.alias("value")))))
    return F.when(F.map_contains_key(mapping, key), F.transform_values(mapping, lambda k, v: F.when(k == key, value).otherwise(v))).otherwise(added)


def with_criteria(questions: Column, qid: str, change: Column) -> Column:
    """questions with the options of one changed, if it is asked."""
    return F.transform_values(questions, lambda k, q: F.when(k == qid, replaced(q, QUESTION, criteria=change)).otherwise(q))


def best(mass: Column) -> Column:
    """The first key with the most mass of a map."""
    most = F.array_max(F.map_values(mass))
    return F.get(F.map_keys(F.map_filter(mass, lambda _, v: v == most)), F.lit(0))


def one_hot(options: Column, gold: Column) -> Column:
    return F.map_from_arrays(options, F.transform(options, lambda o: (o == gold).cast("double")))


def pick(values: Column, *seed: Column | str) -> Column:
    """One of an array's values, as the seed says; NULL of none."""
    text = F.concat_ws("\x1f", *(F.lit(s) if isinstance(s, str) else s.cast("string") for s in seed))
    return let(values, lambda v: F.get(v, F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.greatest(F.size(v), F.lit(1))).cast("int")))


def text_area(state: Column) -> Column:
    """The first text area with text, or NULL."""
    return F.get(F.filter(state["elements"], lambda e: (e["role"] == "textArea") & (F.trim(F.regexp_replace(e["current_value"], r"\s", "")) != "")), F.lit(0))


def order_digest(questions: Column) -> Column:
    """A digest of the order of questions and of their options, which a map of equal entries in another order doesn't share."""
    return F.sha2(F.to_json(F.transform(F.map_entries(questions), lambda e: F.struct(e["key"].alias("q"), F.map_keys(e["value"]["criteria"]).alias("o")))), 256)
