"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and full-width forms to Latin ones, undoes
digit and sign substitutions, drops zero-width characters and turns punctuation into spaces. The lexicon holds the
beginnings of words that toxic texts have significantly more often, and twice as often at least, each with its log-odds as weight. Exception phrases are
learned too: a lexicon word with the word before or behind it, where clean texts have the two significantly more often; matches
inside such a phrase don't count, nor inside phrases that are given. A text's sum of weights is normalised by its length in words to a fitted power, and a
logistic curve makes the score.

The lexicon and the curve are fitted on a bounded sample of labelled rows (`max_toxic` and `max_clean` rows with the
smallest hashes); scoring reads every whole text. Near copies count once in the fit.

Defined results: a null or empty text scores as one without matches; rows that repeat are scored alike; contradictory
labels of one doc_id count as toxic; without labels of both kinds the lexicon is empty and every score is the prior;
an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.llm._common import lean

#: Look-alike letters and the Latin letters they stand for.
HOMOGLYPHS = {
    "a": "аαάⓐ", "b": "Ььⓑ", "c": "сϲⓒ", "d": "ԁⓓ", "e": "еєεέⓔ", "f": "ғ", "g": "ɡ", "h": "һ", "i": "іιίıϊ", "j": "јϳ", "k": "кκ", "l": "ӏɩ",
    "m": "м", "n": "пη", "o": "оοόθ", "p": "рρ", "q": "ԛ", "r": "гř", "s": "ѕšş", "t": "тτ", "u": "υμ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγүý", "z": "ʐžż",
}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
#: Letters with accents, by what is under them.
ACCENTS = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "u": "ùúûü", "y": "ÿ"}
SHORTEST, LONGEST = 4, 8  # letters of a word's beginning
LEAST_G2, LEAST_DOCS, LEAST_ODDS = 22.0, 3, math.log(2)  # an entry is in toxic texts twice as often, at least
MOST_ENTRIES = 1000
SIEVE_BITS = 22
POWERS = (0.1, 0.25, 0.5, 1.0)


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: " " for c in [*range(33), *range(127, 161)] + [ord(x) for x in "\"#%&'()*+,-./:;<=>?[\\]^_`{}~«»„“”‘’…–—"]}
    for c in range(26):
        table[65 + c] = table[0xFF21 + c] = table[0xFF41 + c] = chr(97 + c)
    for letter, alike in [*HOMOGLYPHS.items(), *ACCENTS.items()]:
        for x in alike:
            table[ord(x)] = letter
            if len(x.upper()) == 1 and not x.upper().isascii():
                table[ord(x.upper())] = letter
    table |= {ord(a): b for a, b in SUBSTITUTES.items()}
    table |= dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
    return table


FOLD = _fold_table()


def fold(text: str) -> str:
    return text.translate(FOLD)


class Model(NamedTuple):
    """entries: (beginning of a word, weight); score = logistic(bias + slope * log1p(sum / words ** power))."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    power: float
    bias: float
    slope: float


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for word, weight in model.entries:
            self.automaton.add_word(" " + word, (len(word), weight))
        if model.entries:
            self.automaton.make_automaton()
        self.exceptions = tuple(" " + " ".join(fold(x).split()) for x in model.exceptions)
        self.longest = max((x.count(" ") for x in self.exceptions), default=0)  # in words

    def matches(self, text: str) -> tuple[float, int, int]:
        """(sum of weights, matches, words) of a text."""
        folded = " " + fold(text)
        words = len(folded.split())
        total, n = 0.0, 0
        if self.model.entries:
            for end, (length, weight) in self.automaton.iter(folded):
                at = end - length  # the space before the word
                if self.exceptions and self._excepted(folded, at):
                    continue
                total += weight
                n += 1
        return total, n, words

    def _excepted(self, folded: str, at: int) -> bool:
        """Whether the word that begins behind the space at `at` is inside an exception phrase, as its first word or a later one."""
        for back in range(self.longest):
            if at < 0:
                return False
            found = folded.startswith(self.exceptions, at) and any(folded.startswith(x, at) and x.count(" ") > back for x in self.exceptions)
            if found:
                return True
            at = folded.rfind(" ", 0, at)
        return False

    def score(self, total: float, words: int) -> float:
        z = self.model.bias + self.model.slope * math.log1p(total / max(words, 1) ** self.model.power)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _candidates(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w for w in words if len(w) > LONGEST}


def _g2(a: int, b: int, n_a: int, n_b: int) -> float:
    """The likelihood ratio of two proportions, 0 if the first isn't the greater."""
    if a * n_b <= b * n_a:
        return 0.0
    p = (a + b) / (n_a + n_b)
    part = lambda k, n: (k * math.log(k / (n * p)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - p))) if n > k else 0.0)
    return 2 * (part(a, n_a) + part(b, n_b))


def _logistic(xs: list[float], ys: list[int]) -> tuple[float, float, float]:
    """(bias, slope, mean loss) by Newton steps with a slight ridge."""
    bias = slope = 0.0
    for _ in range(30):
        g0 = g1 = 0.0
        h00 = h11 = 1e-3 * len(xs) + 1e-9
        h01 = 0.0
        for x, y in zip(xs, ys, strict=True):
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, bias + slope * x))))
            g0, g1, w = g0 + p - y, g1 + (p - y) * x, p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        g0, g1 = g0 + 1e-3 * len(xs) * bias, g1 + 1e-3 * len(xs) * slope
        det = h00 * h11 - h01 * h01
        bias, slope = bias - (h11 * g0 - h01 * g1) / det, slope - (h00 * g1 - h01 * g0) / det
    loss = 0.0
    for x, y in zip(xs, ys, strict=True):
        z = max(-40.0, min(40.0, bias + slope * x))
        loss += math.log1p(math.exp(-z if y else z))
    return bias, slope, loss / max(len(xs), 1)


def _sketch(words: list[str]) -> int:
    grams = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(zlib.crc32(g.encode()) for g in grams)


def learned_exceptions(toxic: list[str], clean: list[str], entries: Iterable[str]) -> tuple[str, ...]:
    """Two-word phrases around the lexicon's words by which clean texts are told from toxic ones that have the same entry. Texts are folded.

    A phrase's share among clean texts with its entry is significantly greater than among toxic ones, by the lexicon's own measure.
    """
    starts = tuple(sorted(entries))
    if not starts:
        return ()

    def phrases(words: list[str]) -> set[tuple[str, str]]:
        held = [(i, next(e for e in starts if w.startswith(e))) for i, w in enumerate(words) if w.startswith(starts)]
        return {(e, "") for _, e in held} | {(e, f"{words[a]} {words[a + 1]}") for i, e in held for a in (i - 1, i) if 0 <= a < len(words) - 1}

    good: Counter = Counter()
    bad: Counter = Counter()
    for folded in clean:
        good.update(phrases(folded.split()))
    for folded in toxic:
        bad.update(phrases(folded.split()) & good.keys())
    fine = lambda e, p, n: p and n >= LEAST_DOCS and _g2(n, bad[e, p], good[e, ""], max(bad[e, ""], 1)) >= LEAST_G2
    return tuple(sorted({p for (e, p), n in good.items() if fine(e, p, n)}))


def _frequent(docs: list[str]) -> Counter:
    """How many of the folded texts have each candidate, of those that LEAST_DOCS have.

    Candidates are counted by a hash first, as most are in one text only and would fill the driver's memory.
    """
    mask = (1 << SIEVE_BITS) - 1
    sieve = bytearray(1 << SIEVE_BITS)
    for folded in docs:
        for at in {hash(c) & mask for c in _candidates(set(folded.split()))}:
            sieve[at] = min(LEAST_DOCS, sieve[at] + 1)
    found: Counter = Counter()
    for folded in docs:
        found.update(c for c in _candidates(set(folded.split())) if sieve[hash(c) & mask] >= LEAST_DOCS)
    return Counter({c: n for c, n in found.items() if n >= LEAST_DOCS})


def fit(rows: list[tuple[str, int]], exceptions: tuple[str, ...] = ()) -> Model:
    """A model from (text, 1 for toxic or 0) rows; exceptions: phrases that are none in any case, besides the learned ones."""
    once: dict[tuple[int, int], tuple[str, str, int]] = {}
    for text, label in rows:
        folded = fold(text)
        once.setdefault((_sketch(folded.split()), label), (text, folded, label))
    docs = [once[key] for key in sorted(once)]
    toxic, clean = [f for _, f, y in docs if y], [f for _, f, y in docs if not y]
    bad = _frequent(toxic)
    good: Counter = Counter()
    for folded in clean:
        good.update(_candidates(set(folded.split())) & bad.keys())
    odds = lambda c: math.log((bad[c] + 0.5) / (len(toxic) + 1)) - math.log((good[c] + 0.5) / (len(clean) + 1))
    ranked = []
    for c in bad:
        g2 = _g2(bad[c], good[c], len(toxic), len(clean)) if clean else 0.0
        if g2 >= LEAST_G2 and odds(c) >= LEAST_ODDS:
            ranked.append((-g2, len(c), c))
    entries: dict[str, float] = {}
    for _, _, c in sorted(ranked):
        if len(entries) < MOST_ENTRIES and not any(c.startswith(e) for e in entries):
            entries[c] = odds(c)
    # a beginning that a longer, stronger entry only narrows down would count the same word twice
    entries = {e: w for e, w in entries.items() if not any(o != e and o.startswith(e) and entries[o] >= w for o in entries)}
    learned = learned_exceptions(toxic, clean, entries)
    model = Model(tuple(sorted(entries.items())), tuple(sorted({*exceptions, *learned})), 1.0, 0.0, 0.0)
    scorer = Scorer(model)
    found = [(*scorer.matches(text)[::2], y) for text, _, y in docs]
    best = None
    for power in POWERS:
        bias, slope, loss = _logistic([math.log1p(t / max(n, 1) ** power) for t, n, _ in found], [y for _, _, y in found])
        if best is None or loss < best[0]:
            best = (loss, power, bias, slope)
    return model._replace(power=best[1], bias=best[2], slope=best[3])


def training_rows(documents: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, label_col: str = "toxic") -> list[tuple[str, int]]:
    """A bounded sample: of each label, the rows with the smallest hashes of their ids."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    picked = None
    for value, most in ((1, max_toxic), (0, max_clean)):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most max_toxic + max_clean ids
    one = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))  # the least text of an id that repeats
    return sorted((r.text, int(r.label)) for r in one.collect())


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_matches, n_words of every text."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.matches(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([scorer.score(t, n) for t, _, n in found], pa.float64()), pa.array([k for _, k, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "score", "n_matches", "n_words"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(per_batch), "doc_id long, score double, n_matches long, n_words long")


def keep_clean(documents: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    at = documents.columns.index(text_col)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = (scorer.matches(t or "") for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([scorer.score(t, n) < threshold for t, _, n in found], pa.bool_()))

    return documents.mapInArrow(lean(per_batch), documents.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def fit_on(documents: DataFrame, labels: DataFrame, max_toxic: int = 2500, max_clean: int = 5000) -> Model:
    """A model from the labelled rows that aren't held out."""
    return fit(training_rows(documents, labels.filter(~held_out()), max_toxic, max_clean))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches, n_words."""
    scored = score_documents(documents, fit_on(documents, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches", "n_words")
