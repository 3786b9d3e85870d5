"""Candidate values that a goal text offers for a field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decidra.functions.text import let

#: The shapes of values in a goal, in order: dates, quotations, addresses, names, CJK runs, numbers. Letters,
#: digits, spaces and word ends are those of Unicode, so each is read under the flag UNICODE.
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
PATTERNS = (
    (MONTH + r"\s+\d{1,2}(?:,\s*\d{4})?", 0),
    (r"\d{4}-\d{2}-\d{2}", 0),
    (r"\d{1,2}/\d{1,2}(?:/\d{2,4})?", 0),
    (r"\"([^\"]{1,60})\"", 1),
    (r"“([^”]{1,60})”", 1),
    (r"「([^」]{1,60})」", 1),
    (r"[\w.+-]+@[\w-]+\.[\w.]+", 0),
    (r"\b[A-Z][\w'’-]*(?:\s+(?:of|de|del|van|von|the)\s+[A-Z][\w'’-]*|\s+[A-Z][\w'’-]*)*\b", 0),
    (r"[一-鿿]{2,12}", 0),
    (r"\b\d+\b", 0),
)
#: Words that begin a sentence and are no values.
STOP = (
    "find", "search", "open", "go", "show", "set", "select", "click", "stop", "do", "the", "a", "an", "and",
    "for", "from", "to", "on", "in", "with", "then", "when", "if", "not", "book", "please",
)
#: Words in a field's label that ask for a date or for a number.
DATE_LABELS = ("date", "depart", "return", "check", "日期", "出发", "返回")
NUMBER_LABELS = ("passenger", "adult", "guest", "room", "qty", "quantity", "人数")
LONGEST = 80
UNICODE = "(?U)"


def _once(values: Column) -> Column:
    """The first of each value up to case, in order."""
    return let(values, lambda vs: let(F.transform(vs, F.lower), lambda low: F.filter(vs, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)))


def spans(text: Column, limit: int = 40) -> Column:
    """Values by length, the longest first, then in order of patterns; one of each up to case."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNICODE + p), F.lit(g)) for p, g in PATTERNS))
    stripped = F.transform(found, lambda v: F.regexp_replace(v, r"^[ ,.;:'\"]+|[ ,.;:'\"]+$", ""))
    fit = F.filter(stripped, lambda v: (v != "") & (F.length(v) <= LONGEST) & ~F.lower(v).isin(*STOP))
    ordered = F.transform(F.array_sort(F.transform(fit, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))), lambda s: s["v"])
    return F.slice(_once(ordered), 1, limit)


def candidates(goal: Column, label: Column, page_values: Column, limit: int = 26) -> Column:
    """Spans of the goal ranked for the field, then values of the page that aren't among them."""
    name = F.lower(F.coalesce(label, F.lit("")))
    wants = lambda words: name.rlike("|".join(words))
    dated = lambda v: v.rlike(rf"{UNICODE}^(?:{MONTH}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}})")
    number = lambda v: v.rlike(rf"{UNICODE}^\d+$")
    last = lambda v: F.when(wants(DATE_LABELS), ~dated(v)).when(wants(NUMBER_LABELS), ~number(v)).otherwise(dated(v) | number(v)).cast("int")
    ordered = F.transform(F.array_sort(F.transform(spans(goal), lambda v, i: F.struct(last(v).alias("r"), (-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))), lambda s: s["v"])
    given = F.filter(F.transform(F.coalesce(page_values, F.array().cast("array<string>")), F.trim), lambda v: (v != "") & (F.length(v) <= LONGEST))
    return F.slice(_once(F.concat(ordered, given)), 1, limit)
