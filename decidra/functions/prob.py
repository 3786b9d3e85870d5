"""Column functions over distributions: `ps` is array<double> in the question's option order, `keys` array<string>.

All are built-in expressions that run in the JVM; missing values are NULL throughout. What a lambda needs for every
option, such as a sum or a maximum, is bound by `let` outside it, so each function is linear in the number of options.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decidra.functions.text import let

FLOOR, EPS, TIE = 1e-12, 1e-6, 1e-12


def total(ps: Column) -> Column:
    return F.aggregate(ps, F.lit(0.0), lambda s, p: s + p)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def normalize(ps: Column) -> Column:
    """Missing options count as 0, negative mass is clamped, the rest is rescaled; without mass it is uniform."""
    clamped = F.transform(ps, lambda p: F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)))
    share = lambda c, s: F.when(s > 0, F.transform(c, lambda p: p / s)).otherwise(let(F.size(c), lambda k: F.transform(c, lambda p: F.lit(1.0) / k)))
    return let(clamped, lambda c: let(total(c), lambda s: share(c, s)))


def restrict(dist: Column, keys: Column) -> Column:
    """A map<string,double> as a distribution over keys."""
    return normalize(F.transform(keys, lambda k: F.try_element_at(dist, k)))


def valid(ps: Column) -> Column:
    """False for a NULL distribution or one with NaN: such an answer counts as not given."""
    return F.coalesce(~F.exists(ps, lambda p: F.isnan(F.coalesce(p, F.lit(0.0)))), F.lit(False))


def top(ps: Column) -> Column:
    return F.array_max(ps)


def argmax(ps: Column) -> Column:
    """1-based place of the largest value; the first wins a tie."""
    return F.array_position(ps, F.array_max(ps)).cast("int")


def choice_confidence(ps: Column) -> Column:
    """How far the top probability stands above chance: 0 when uniform, 1 when certain or with a single option."""
    k = F.size(ps)
    return F.when(k <= 1, F.lit(1.0)).otherwise((k * top(ps) - 1) / (k - 1))


def score_value(ps: Column) -> Column:
    return total(F.transform(ps, lambda p, i: p * i))


def score_confidence(ps: Column) -> Column:
    """1 less twice the mean absolute deviation from the expected level, over the range; never below 0."""
    mad = let(score_value(ps), lambda mean: total(F.transform(ps, lambda p, i: p * F.abs(i - mean))))
    return F.when(F.size(ps) <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - 2 * mad / (F.size(ps) - 1)))


def tie_credit(ps: Column, label: Column) -> Column:
    """Expected accuracy of the top option under random tie-breaking; label is a 1-based place."""
    among = lambda least: F.when(F.element_at(ps, label) >= least, F.lit(1.0) / F.size(F.filter(ps, lambda p: p >= least))).otherwise(F.lit(0.0))
    return let(top(ps) - TIE, among)


def clipped(ps: Column) -> Column:
    return F.transform(ps, lambda p: F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0)))


def nll(ps: Column, label: Column) -> Column:
    return -F.ln(F.element_at(clipped(ps), label))


def brier(ps: Column, label: Column) -> Column:
    return total(F.transform(ps, lambda p, i: F.pow(p - F.when(i + 1 == label, 1.0).otherwise(0.0), 2)))


def cross_entropy(ref: Column, ps: Column) -> Column:
    return -total(F.zip_with(ref, clipped(ps), lambda r, p: r * F.ln(p)))


def entropy(ref: Column) -> Column:
    return -total(F.transform(ref, lambda r: F.when(r > 0, r * F.ln(r)).otherwise(0.0)))


def kl(ref: Column, ps: Column) -> Column:
    return F.greatest(cross_entropy(ref, ps) - entropy(ref), F.lit(0.0))


def total_variation(ref: Column, ps: Column) -> Column:
    return 0.5 * total(F.zip_with(ref, ps, lambda r, p: F.abs(p - r)))


def score_error(ref: Column, ps: Column) -> Column:
    return F.abs(score_value(ps) - score_value(ref)) / (F.size(ref) - 1)


def softmax(logits: Column) -> Column:
    raised = lambda xs: let(F.array_max(xs), lambda most: F.transform(xs, lambda x: F.exp(x.cast("double") - most)))
    return let(let(logits, raised), lambda es: let(total(es), lambda s: F.transform(es, lambda e: e / s)))


def rescale(ps: Column, t: Column) -> Column:
    """Temperature scaling: softmax of the log probabilities over t."""
    return F.when(t == 1.0, ps).otherwise(softmax(F.transform(ps, lambda p: F.ln(F.greatest(p, F.lit(FLOOR))) / t)))


def soft_nll(ref: Column, ps: Column) -> Column:
    return -total(F.zip_with(ref, ps, lambda r, p: F.when(r > 0, r * F.ln(F.greatest(p, F.lit(FLOOR)))).otherwise(0.0)))


def one_hot(k: Column, label: Column) -> Column:
    """label: 1-based place."""
    return F.transform(F.sequence(F.lit(1), k), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def gold_fill(k: Column, label: Column, mass: float) -> Column:
    """The label gets `mass`; the others share the rest."""
    return F.transform(F.sequence(F.lit(1), k), lambda i: F.when(i == label, F.lit(mass)).otherwise(F.lit(1 - mass) / F.greatest(k - 1, F.lit(1))))


def smooth(ps: Column, keep: float = 0.95) -> Column:
    return let(F.size(ps), lambda k: F.transform(ps, lambda p: keep * p + F.lit(1 - keep) / k))


def two_level(x: Column, k: int) -> Column:
    """A real-valued level in [0, k-1] as mass on its two neighbours."""
    spread = lambda x, lo: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == lo, 1 - (x - lo)).when(i == lo + 1, x - lo).otherwise(0.0))
    return let(x, lambda x: let(F.least(F.floor(x), F.lit(k - 2)), lambda lo: spread(x, lo)))


def merged_golds(golds: Column, keys: Column) -> Column:
    """Several acceptable answers (an array of keys) as equal mass on those among the options, each counted once; NULL if none is."""
    inside = F.filter(F.array_distinct(golds), lambda g: F.array_contains(keys, g))
    return let(inside, lambda gs: F.when(F.size(gs) > 0, F.transform(keys, lambda k: F.when(F.array_contains(gs, k), F.lit(1.0) / F.size(gs)).otherwise(0.0))))


def to_answer(qtype: Column, keys: Column, ps: Column) -> Column:
    """The typed answer of a distribution; fields that a type lacks are NULL."""
    is_noul, is_choice, is_score = qtype == "noul", qtype == "choice", qtype == "score"
    return F.struct(
        qtype.alias("type"),
        F.when(is_noul, F.element_at(ps, 2)).alias("noul"),
        F.when(is_choice, F.element_at(keys, argmax(ps))).alias("choice"),
        F.when(is_score, score_value(ps)).alias("score"),
        F.when(~is_noul, F.arrays_zip(keys.alias("key"), ps.alias("p"))).alias("probabilities"),
        F.when(is_choice, choice_confidence(ps)).when(is_score, score_confidence(ps)).alias("confidence"),
    )


def from_answer(qtype: Column, keys: Column, noul: Column, choice: Column, score: Column, probabilities: Column) -> Column:
    """The distribution of a typed answer, NULL if it has none. `probabilities` is map<string,double>."""
    p = F.least(F.greatest(noul, F.lit(0.0)), F.lit(1.0))
    level = F.bround(score).cast("int") + 1
    hard = F.when(F.array_contains(keys, choice), one_hot(F.size(keys), F.array_position(keys, choice).cast("int")))
    return (
        F.when((qtype == "noul") & noul.isNotNull() & ~F.isnan(noul), F.array(1 - p, p))
        .when((qtype != "noul") & probabilities.isNotNull(), restrict(probabilities, keys))
        .when(qtype == "choice", hard)
        .when((qtype == "score") & score.isNotNull() & level.between(1, F.size(keys)), one_hot(F.size(keys), level))
    )


def top_prob(probabilities: Column, noul: Column) -> Column:
    return F.coalesce(F.array_max(probabilities), F.greatest(noul, 1 - noul), F.lit(0.0))
