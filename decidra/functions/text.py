"""Column functions over ids, option lists and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is one CJK character, or a run of letters and digits with inner quotes and dots.
TOKEN = r"[㐀-鿿]|[a-z0-9]+(?:['’.][a-z0-9]+)*"
#: Fixed value: what a clipped text ends with.
TRUNCATED = " …[truncated]"
TEXT_OPS = ("TYPE_TEXT", "REPLACE_TEXT", "APPEND_TEXT", "RENAME", "TYPE_FOCUSED")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, though `then` uses it often or inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def session_of(item_id: Column) -> Column:
    """An id without its trailing /liveN parts and its last part; a single part stays."""
    return F.regexp_replace(F.regexp_replace(item_id, r"(/live[0-9]+)+$", ""), r"/[^/]*$", "")


def unit_hash(text: Column) -> Column:
    """The first 32 bits of SHA-256 as a number in [0, 1]."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def split_of(session: Column, share: float = 0.3, salt: str = "replay-v1") -> Column:
    return F.when(unit_hash(F.concat(F.lit(salt + ":"), session)) < share, "holdout").otherwise("dev")


def step_key(item_id: Column) -> Column:
    """Sort key of an id: its parts, numbers as numbers and before text."""
    part = lambda p: F.struct(F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("t"), F.when(p.rlike("^[0-9]+$"), p.cast("decimal(38,0)")).alias("n"), p.alias("s"))
    return F.transform(F.split(item_id, "/"), part)


def k_bucket(k: Column) -> Column:
    return F.when(k <= 2, "K=2").when(k <= 5, "K=3-5").when(k <= 10, "K=6-10").when(k <= 50, "K=11-50").otherwise("K>50")


def calibration_kind(qtype: Column, k: Column) -> Column:
    return F.when((qtype == "choice") & (k > 10), "choice>10").otherwise(qtype)


def heads_for(op: Column, qids: Column) -> Column:
    """The questions that an operation uses, in the order of the request."""
    own = F.filter(qids, lambda q: F.startswith(q, F.concat(F.lower(op), F.lit("_"))))
    extra = lambda name, when: F.when(when & F.array_contains(qids, name), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, extra("type_text_value", op.isin(*TEXT_OPS)), extra("replace_from", op == "REPLACE_TEXT")))


def clip(text: Column, n: int = 8000, mark: str = TRUNCATED) -> Column:
    """Texts of more than n characters end after n of them, with a mark."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def squeeze(text: Column, n: int) -> Column:
    """White space collapsed, cut to n characters with an ellipsis as the last."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n - 1), F.lit("…")))


def humanize(name: Column) -> Column:
    plain = F.trim(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1_000_000)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, n: int = 13) -> Column:
    """Distinct n-grams of tokens; none if there are fewer."""

    def made(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return let(words, made)


def option_set(keys: Column) -> Column:
    return F.array_sort(F.array_distinct(keys))


def options_left(keys: Column, used: Column) -> Column:
    """The options that aren't used, as a set."""
    return F.array_sort(F.array_except(keys, F.coalesce(used, F.array().cast("array<string>"))))


def shared_prefix(rows: Column) -> Column:
    """Length of the longest common prefix of arrays, leaving each at least one element."""
    shortest = F.array_min(F.transform(rows, F.size)) - 1
    first = F.element_at(rows, 1)
    differs = lambda i: F.exists(rows, lambda r: F.element_at(r, i) != F.element_at(first, i))
    places = F.when(shortest >= 1, F.sequence(F.lit(1), shortest)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.filter(places, differs)) - 1, F.greatest(shortest, F.lit(0)))
