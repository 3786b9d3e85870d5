"""Quality by a generalised additive model with pairwise interactions, boosted cyclically.

A text is described by measures of its whole: kinds of characters, words, lines, repetition, how well it compresses. Each measure is
cut into quantile bins. The features take turns: a tree of three leaves at most is fitted on a feature's bins to the logistic
loss, shrunk, and added to the feature's lookup table. Then the pairs of features whose 2 x 2 cut improves the loss most take
turns with trees of four leaves on their grids of bins. A text's score is the logistic function of the intercept and one
value from each table, looked up by bin and added for a whole batch at once.

The model is fitted on a bounded sample, the `max_rows` labelled rows with the smallest hashes of their ids, of which a
part tells when to stop. Measures are computed where the texts are; only the sample's numbers come to the driver. Scoring reads every whole text.

Defined results: a null text counts as empty, and an empty one is scored by its measures, which are all 0; rows that repeat are scored alike;
contradictory labels of one doc_id count as 0; of a labelled id that repeats with other texts, the smallest measures are learned; without
labels of both kinds every score is the smoothed share of label 1, 0.5 without any; an empty table gives no rows; columns
other than those named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.llm._common import byte_texts, lean

NAMES = (
    "log_words", "log_bytes", "upper", "digits", "blanks", "beyond_ascii", "stops", "pauses", "calls", "other_signs", "sign_kinds", "byte_entropy", "top_byte",
    "word_length", "word_spread", "long_words", "short_words", "signed_words", "upper_words", "distinct_words", "top_word", "distinct_pairs", "distinct_fives", "adjacent",
    "log_lines", "distinct_lines", "line_length", "ended_lines", "short_lines", "compressed",
)
BINS, PAIR_BINS, PAIRS = 32, 12, 10
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAST_LEAF = 400, 200, 0.1, 1.0, 5.0
PATIENCE, CHECK_SHARE = 30, 5  # rounds without a better loss on the part held back, which is one in CHECK_SHARE


def _bytes_of(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER, _LOWER, _DIGIT = (_bytes_of(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_BLANK, _HIGH = _bytes_of(b" \t\n\v\f\r"), _bytes_of(bytes(range(128, 256)))
_STOP, _PAUSE, _CALL = _bytes_of(b"."), _bytes_of(b",;:"), _bytes_of(b"!?")
_SIGN = ~(_UPPER | _LOWER | _DIGIT | _BLANK | _HIGH | _STOP | _PAUSE | _CALL | _bytes_of(b"'\"-()"))
_END = _STOP | _CALL


def measures(text: bytes) -> list[float]:
    """The measures NAMES of a text in UTF-8."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text, np.uint8)
    n, counts = len(raw), np.bincount(raw, minlength=256)
    held = counts[counts > 0] / n
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    share = lambda table: float(counts[table].sum()) / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    each = np.unique(hashes, return_counts=True)[1] if words else np.ones(1, np.int64)

    def distinct(k: int) -> float:
        if len(words) < k:
            return 1.0
        grams = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(grams)]
        return len(np.unique(grams)) / len(grams)

    blank = _BLANK[raw]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True))  # the last byte of each word
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    return [
        math.log1p(len(words)), math.log1p(n), float(counts[_UPPER].sum()) / letters, share(_DIGIT), share(_BLANK), share(_HIGH), share(_STOP) * n / m, share(_PAUSE) * n / m, share(_CALL) * n / m, share(_SIGN),
        float((counts[_SIGN] > 0).sum()), float(-(held * np.log2(held)).sum()), float(held.max()),
        float(lengths.mean()) if words else 0.0, float(lengths.std()) if words else 0.0, float((lengths > 20).sum()) / m, float((lengths < 3).sum()) / m, float(_SIGN[raw[ends]].sum()) / m, float(_UPPER[raw[starts]].sum()) / m,
        math.log(len(each)) / math.log(m) if m > 1 else 1.0, float(each.max()) / m, distinct(2), distinct(5), float((hashes[1:] == hashes[:-1]).sum()) / m,
        math.log1p(len(lines)), len(set(lines)) / k, math.log1p(n / k), sum(_END[x.rstrip()[-1]] for x in lines) / k, sum(len(x) < 20 for x in lines) / k, min(2.0, len(zlib.compress(text, 1)) / n),
    ]


class Model(NamedTuple):
    """edges: of each feature's bins; tables: a value for each bin; pairs: (feature, feature, edges, edges, grid of values)."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray, np.ndarray, np.ndarray], ...]


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of quantile bins; equal values share a bin."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def binned(column: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, column, "right")


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h < LEAST_LEAF, -np.inf, g * g / (h + RIDGE))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut along the last axis; a gain of -inf if no side may be cut."""
    if len(g) < 2:
        return -math.inf, 0
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    all_g, all_h, all_n = g.sum(), h.sum(), n.sum()
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain = np.where((left_n >= LEAST_LEAF) & (all_n - left_n >= LEAST_LEAF), gain, -np.inf)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A step for each bin: a tree of three leaves at most on the bins' gradients, curvatures and rows."""
    leaves = [(0, len(g))]
    for _ in range(2):
        cuts = [(*best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in leaves]
        gain, at, a, b = max(cuts, key=lambda c: c[0])
        if gain <= 0:
            break
        leaves.remove((a, b))
        leaves += [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in leaves:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def shallow_grid(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, a step for each cell): a cut of either axis, then one of the other axis on each side."""
    best, out = -math.inf, np.zeros(g.shape)
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        gain, at = best_cut(a.sum(1), b.sum(1), c.sum(1))
        if not math.isfinite(gain):
            continue
        step = np.zeros(a.shape)
        for rows in (slice(0, at), slice(at, None)):
            x, y, z = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
            more, cut = best_cut(x, y, z)
            gain += max(more, 0.0)
            for cols in (slice(0, cut), slice(cut, None)) if more > 0 else (slice(None),):
                step[rows, cols] = x[cols].sum() / (y[cols].sum() + RIDGE)
        if gain > best:
            best, out = gain, step.T if turned else step
    return best, out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Boosting:
    """Cyclic boosting of lookup tables over cells: one cell number for each row and table."""

    def __init__(self, y: np.ndarray, check: np.ndarray, score: np.ndarray):
        self.y, self.check, self.score = y, check, score

    def loss(self) -> float:
        z = self.score[self.check] * np.where(self.y[self.check] > 0, -1, 1)
        return float(np.logaddexp(0, z).mean()) if len(z) else 0.0

    def sums(self, cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients, curvatures and rows of each cell, over the rows that aren't held back."""
        p = _logistic(self.score)
        used = ~self.check
        at, g, h = cells[used], (self.y - p)[used], (p * (1 - p))[used]
        return tuple(np.bincount(at, w, size) for w in (g, h, np.ones(len(at))))

    def run(self, cells: list[np.ndarray], shapes: list[tuple[int, ...]], rounds: int) -> list[np.ndarray]:
        tables = [np.zeros(s) for s in shapes]
        best, kept, waited = self.loss(), [t.copy() for t in tables], 0
        begun, at_best = self.score.copy(), self.score.copy()
        for _ in range(rounds):
            for j, (at, shape) in enumerate(zip(cells, shapes, strict=True)):
                sums = [s.reshape(shape) for s in self.sums(at, math.prod(shape))]
                step = RATE * (shallow_tree(*sums) if len(shape) == 1 else shallow_grid(*sums)[1])
                tables[j] += step
                self.score = self.score + step.ravel()[at]
            now, waited = self.loss(), waited + 1
            if now < best - 1e-6:
                best, kept, waited, at_best = now, [t.copy() for t in tables], 0, self.score.copy()
            elif waited >= PATIENCE:
                break
        self.score = at_best if best < math.inf else begun
        return kept


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Model:
    """A model of rows of measures and labels; check: the rows that only tell when to stop."""
    share = (float(y.sum()) + 1) / (len(y) + 2)
    intercept = math.log(share / (1 - share))
    features = x.shape[1]
    edges = tuple(bin_edges(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(features))
    flat = Model(intercept, edges, tuple(np.zeros(len(e) + 1) for e in edges), ())
    if len(set(y[~check].tolist())) < 2:
        return flat
    bins = [binned(x[:, j], edges[j]) for j in range(features)]
    boosting = _Boosting(y, check, np.full(len(y), intercept))
    tables = boosting.run(bins, [(len(e) + 1,) for e in edges], ROUNDS)
    coarse = [bin_edges(x[:, j], PAIR_BINS) for j in range(features)]
    small = [binned(x[:, j], coarse[j]) for j in range(features)]
    ranked = []
    for a, b in combinations(range(features), 2):
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        sums = [s.reshape(shape) for s in boosting.sums(small[a] * shape[1] + small[b], math.prod(shape))]
        ranked.append((-shallow_grid(*sums)[0], a, b))
    chosen = [(a, b) for gain, a, b in sorted(ranked)[:PAIRS] if gain < 0]
    shapes = [(len(coarse[a]) + 1, len(coarse[b]) + 1) for a, b in chosen]
    grids = boosting.run([small[a] * s[1] + small[b] for (a, b), s in zip(chosen, shapes, strict=True)], shapes, PAIR_ROUNDS)
    pairs = tuple((a, b, coarse[a], coarse[b], grid) for (a, b), grid in zip(chosen, grids, strict=True) if grid.any())
    return Model(intercept, edges, tuple(tables), pairs)


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    """Each row's score: one lookup for each table, added over the whole batch."""
    z = np.full(len(x), model.intercept)
    for j, (edges, values) in enumerate(zip(model.edges, model.tables, strict=True)):
        z += values[binned(x[:, j], edges)]
    for a, b, first, second, grid in model.pairs:
        z += grid[binned(x[:, a], first), binned(x[:, b], second)]
    return _logistic(z)


def measured(texts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named and `measures` of each text; texts: those columns and `text`."""
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t) for t in byte_texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "measures"])

    return texts.select(*keep, "text").mapInArrow(lean(per_batch), f"{schema}, measures array<double>")


def fit_on(documents: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of a bounded sample of the labelled rows: the max_rows ids with the smallest hashes, and those of their rows that have texts here."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = named.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")  # at most max_rows ids
    found = measured(texts, ("doc_id", "label")).groupBy("doc_id").agg(F.min("measures").alias("measures"), F.max("label").alias("label"))
    rows = sorted(found.collect())
    x = np.array([r.measures for r in rows], np.float64).reshape(len(rows), len(NAMES))
    return fit(x, np.array([r.label for r in rows], np.float64), np.array([zlib.crc32(b"%d|check" % r.doc_id) % CHECK_SHARE == 0 for r in rows], bool))


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every text."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measures(t) for t in byte_texts(batch.column(1))]).reshape(len(batch), len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, x))], names=["doc_id", "score"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(per_batch), "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels that aren't held out."""
    scored = score_documents(documents, fit_on(documents, labels.filter(~held_out()), max_rows=max_rows))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
