"""Quality of documents by co-training.

Two views of a document: its text (shapes of characters, words and lines of the whole text) and its page's metadata
(source, language, stated length). A logistic regression for each view is fitted on the labelled rows of the learning
folds; then, for some rounds, each view labels those unlabelled documents of the learning folds that it is surest of, in the
labelled rows' proportion of classes and by a likelihood ratio of 19 at least, and hands them to the other view, which is
fitted again with them. At last both views'
log-odds are calibrated together on labelled rows that neither view was fitted on, with weights that aren't negative (a view that
would count against itself has none), and every document gets the combined probability of being good.

All rows take part, in proportion to the input: both views' features are written once; each step of a fit is a sum over
them, and the surest rows are those beyond thresholds from histograms of the log-odds of all rows not yet handed over. Which
rows a round hands over follows from the views and thresholds of the rounds before, so no list of rows is kept.

Rows whose crc32(id as text) mod 4 is 2 are held out from everything that learns, unlabelled ones too; mod 4 equal to 3
calibrates (labelled) or is not used (unlabelled).

Null text is scored as empty, null metadata as a value of its own, null id isn't held out and nothing is learnt from it. Of
several labels of an id the smallest counts. Repeated rows get equal scores. Without labels of both classes every score is
0.5. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sums import Passes
from .bytewords import NOT_SPACE, blocks, byte_table, words
from .store import written
from .toxicity import held_out

ROUNDS = 5
#: Share of the unlabelled rows that a view labels in a round.
HANDED = 0.025
#: Least log-likelihood ratio for a label that is handed over: a view that knows nothing hands over nothing.
EVIDENCE = float(np.log(19))
#: Bins of the histograms of log-odds, which are cut at +-LIMIT.
BINS, LIMIT = 4_800, 12.0
#: Steps of a Newton fit at most.
NEWTON = 12
#: Cells that sources and languages are hashed to.
CELLS = 64

_LINES = byte_table(b for b in range(256) if b != 10)
_KIND = np.zeros(256, np.int64)  # 1 capital, 2 small, 3 digit, 4 usual mark, 5 other mark, 6 line end, 7 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
for _c in b"!\"#$%&*+/<=>@[\\]^_`{|}~":
    _KIND[_c] = 5
for _c in b".,;:'()-?":
    _KIND[_c] = 4
_KIND[10] = 6
TEXT_FEATURES = 17


def _repeats(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the share of distinct hashes and that of the most frequent one."""
    count = np.maximum(1, np.bincount(row, minlength=n))
    if not len(hashes):
        return np.ones(n), np.zeros(n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
    runs = np.diff(np.r_[first, len(h)])
    most = np.zeros(n)
    np.maximum.at(most, r[first], runs)
    return np.bincount(r[first], minlength=n) / count, most / count


def text_view(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, size = len(at) - 1, np.maximum(1, np.diff(at))
    kind = _KIND[data]
    share = [np.diff(np.r_[0, np.cumsum(kind == k)][at]) / size for k in range(1, 8)]
    w = words(data, at, NOT_SPACE)
    row = w.rows()
    per = np.maximum(1, np.bincount(row, minlength=n))
    length = (w.end - w.start).astype(float)
    mean = np.bincount(row, weights=length, minlength=n) / per
    spread = np.sqrt(np.maximum(0, np.bincount(row, weights=length**2, minlength=n) / per - mean**2))
    last = _KIND[data[w.end - 1]] if len(w.end) else np.zeros(0, np.int64)
    odd_end = np.bincount(row, weights=(last == 5).astype(float), minlength=n) / per
    single = np.bincount(row, weights=(length == 1).astype(float), minlength=n) / per
    distinct, most = _repeats(w.hash, row, n)
    lines = words(data, at, _LINES)
    line_distinct, line_most = _repeats(lines.hash, lines.rows(), n)
    line_words = np.log1p(per / np.maximum(1, np.bincount(lines.rows(), minlength=n)))
    return np.stack([*share, np.log1p(per), mean, spread, odd_end, single, distinct, most, line_distinct, line_most, line_words], axis=1)


def meta_codes(source: list, lang: list, length: list) -> np.ndarray:
    """Cells of source and language, whether the length is missing, and its logarithm."""
    cell = lambda x: zlib.crc32(repr(x).encode()) % CELLS
    return np.array([(cell(s), cell(g), c is None, np.log1p(max(0, c or 0))) for s, g, c in zip(source, lang, length, strict=True)], np.float32).reshape(-1, 4)


def meta_view(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), 2 * CELLS + 3))
    at = np.arange(len(codes))
    out[at, codes[:, 0].astype(np.int64)] = 1
    out[at, CELLS + codes[:, 1].astype(np.int64)] = 1
    out[:, -3], out[:, -2], out[:, -1] = codes[:, 2], codes[:, 3], codes[:, 3].astype(np.float64) ** 2
    return out


@dataclass
class View:
    """Standardising and a logistic regression, over the features and (of dense views) their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    squares: bool

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[z, z * z, np.ones(len(z))] if self.squares else np.c_[z, np.ones(len(z))]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -LIMIT, LIMIT)


@dataclass
class Model:
    text: View | None
    meta: View | None
    mix: np.ndarray
    #: Rows that the text view and the metadata view handed over in each round.
    handed: tuple[tuple[int, int], ...] = ()


#: A round: both views, and of each the log-odds up to which and from which it handed rows to the other.
Round = tuple[tuple[View, View], tuple[tuple[float, float], tuple[float, float]]]


def targets(y: np.ndarray, fold: np.ndarray, x: tuple[np.ndarray, np.ndarray], rounds: list[Round]) -> tuple[np.ndarray, np.ndarray]:
    """What each view learns for each row (0, 1, or -1 for nothing), and which rows are still free: labelled rows for both, handed rows for the one that got them."""
    known = (y >= 0) & (fold != 3)
    told = np.stack([np.where(known, y, -1)] * 2)
    free = (y < 0) & (fold != 3)
    for views, cuts in rounds:
        odds = [v.odds(z) for v, z in zip(views, x, strict=True)]
        label = [np.where(o <= lo, 0, np.where(o >= hi, 1, -1)) for o, (lo, hi) in zip(odds, cuts, strict=True)]
        handed = free & ((label[0] >= 0) | (label[1] >= 0)) & ~((label[0] >= 0) & (label[1] >= 0) & (label[0] != label[1]))
        for i in (0, 1):
            told[1 - i] = np.where(handed & (label[i] >= 0), label[i], told[1 - i])
        free &= ~handed
    return told, free


def _slopes(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return np.r_[z.T @ (y - p), ((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).reshape(-1)]


def newton(total, start: list[np.ndarray], l2: float) -> list[np.ndarray]:
    """Weights of logistic regressions that are fitted in the same passes. total: of weights the sums of slopes and curvatures of all."""
    w = [x.copy() for x in start]
    for _ in range(NEWTON):
        sums, moved = total(w), 0.0
        for i, x in enumerate(w):
            d = len(x)
            g, h, sums = sums[:d], sums[d : d + d * d].reshape(d, d), sums[d + d * d :]
            penalty = np.r_[np.full(d - 1, l2), 1e-6]
            step = np.clip(np.linalg.solve(h + np.diag(penalty), g - penalty * x), -5, 5)
            w[i] = x + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-3:
            break
    return w


def cuts_of(histogram: np.ndarray, n0: float, n1: float, prior: float = 0.0, evidence: float = 0.0) -> tuple[float, float]:
    """Log-odds up to which about n0 rows lie and from which n1 rows lie, each on its side of 0 and by the evidence away from the prior log-odds."""
    edges = np.linspace(-LIMIT, LIMIT, BINS + 1)
    low, high = np.cumsum(histogram), np.cumsum(histogram[::-1])
    i, j = int(np.searchsorted(low, max(1.0, n0))), int(np.searchsorted(high, max(1.0, n1)))
    return min(float(edges[min(i + 1, BINS)]), prior - evidence, -1e-9), max(float(edges[max(BINS - 1 - j, 0)]), prior + evidence, 1e-9)


def co_train(passes: Passes, context, width: tuple[int, int], rounds: int = ROUNDS, share: float = HANDED) -> Model:
    """The model learnt from a table of y, fold and both views' features (packed, t and m)."""

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        column = lambda i: b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
        t, m = (np.frombuffer(b"".join(b.column(2 + i).to_pylist()), np.float32).reshape(b.num_rows, -1) for i in (0, 1))
        return column(0), column(1), (t.astype(np.float64), meta_view(m))

    def over(f, state, size: int) -> np.ndarray:
        shared = context.broadcast(state)
        out = passes.total(lambda b: f(*read(b), *shared.value), size)
        shared.destroy()
        return out

    def moments(y, fold, x) -> np.ndarray:
        known = (y >= 0) & (fold != 3)
        return np.concatenate([[known.sum(), y[known].sum(), ((y < 0) & (fold != 3)).sum()], *(np.r_[z[known].sum(axis=0), (z[known] ** 2).sum(axis=0)] for z in x)])

    sums = over(moments, (), 3 + 2 * sum(width))
    n, good, pool = sums[:3]
    if not 0 < good < n:
        return Model(None, None, np.zeros(3))
    prior = float(np.log(good / (n - good)))
    views, at = [], 3
    for i, d in enumerate(width):
        mean, square = sums[at : at + d] / n, sums[at + d : at + 2 * d] / n
        at += 2 * d
        views.append(View(mean, np.maximum(np.sqrt(np.maximum(0, square - mean**2)), 1e-3), np.zeros((2 - i) * d + 1), i == 0))
    done: list[Round] = []
    handed: list[tuple[int, int]] = []

    def slopes(y, fold, x, views, done) -> np.ndarray:
        told, _ = targets(y, fold, x, done)
        return np.concatenate([_slopes(v.design(z[t >= 0]), t[t >= 0], v.weights) for v, z, t in zip(views, x, told, strict=True)])

    def free_odds(y, fold, x, views, done) -> np.ndarray:
        _, free = targets(y, fold, x, done)
        return np.concatenate([np.histogram(v.odds(z[free]), BINS, (-LIMIT, LIMIT))[0] for v, z in zip(views, x, strict=True)]).astype(float)

    weighted = lambda w: tuple(View(v.mean, v.scale, x, v.squares) for v, x in zip(views, w, strict=True))
    size = sum(len(v.weights) * (len(v.weights) + 1) for v in views)
    for r in range(rounds + 1):
        views = list(weighted(newton(lambda w: over(slopes, (weighted(w), done), size), [v.weights for v in views], 2.0)))
        if r == rounds or not pool:
            break
        found = over(free_odds, (tuple(views), done), 2 * BINS)
        many = share * pool
        each = [found[i * BINS : (i + 1) * BINS] for i in (0, 1)]
        cuts = tuple(cuts_of(x, many * (1 - good / n), many * good / n, prior, EVIDENCE) for x in each)
        edges = np.linspace(-LIMIT, LIMIT, BINS + 1)
        handed.append(tuple(int(x[edges[1:] <= lo + 1e-9].sum() + x[edges[:-1] >= hi - 1e-9].sum()) for x, (lo, hi) in zip(each, cuts, strict=True)))
        done.append((tuple(views), cuts))

    def calibrating(y, fold, x, views, w, used) -> np.ndarray:
        own = (y >= 0) & (fold == 3)
        z = np.c_[views[0].odds(x[0][own]), views[1].odds(x[1][own]), np.ones(own.sum())] * used
        return np.r_[own.sum(), y[own].sum(), _slopes(z, y[own], w)]

    calibrated = lambda w, used: over(calibrating, (tuple(views), w, used), 14)
    used = np.ones(3)
    many, positive = calibrated(np.zeros(3), used)[:2]
    if not 0 < positive < many:
        return Model(views[0], views[1], np.array([0.7, 0.3, 0.0]), tuple(handed))
    while True:
        mix = newton(lambda w: calibrated(w[0], used)[2:], [np.zeros(3)], 0.5)[0]
        if mix[:2].min() >= 0:
            return Model(views[0], views[1], mix, tuple(handed))
        used[int(np.argmin(mix[:2]))] = 0.0


def _both(keep: int):
    """mapInArrow function that adds the text view and the metadata's codes to the first columns; the last four are source, lang, length and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for lo, hi, data, at in blocks(b, "text"):
                part = b.slice(lo, hi - lo)
                yield part.columns[:keep], text_view(data, at), meta_codes(*(part.column(keep + i).to_pylist() for i in range(3)))

    return run


def _columns(docs: DataFrame, key: str, text: str, source: str, lang: str, length: str) -> DataFrame:
    return docs.select(F.col(key).alias("__id"), F.col(source).alias("__source"), F.col(lang).alias("__lang"), F.col(length).cast("double").alias("__length"), F.coalesce(text, F.lit("")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars", label_key: str = "doc_id", label: str = "quality") -> Model:
    gold = labels.select(F.col(label_key).alias("__id"), F.col(label).cast("int").alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out("__id")).groupBy("__id").agg(F.min("__y").alias("__y"))
    fold = F.crc32(F.col("__id").cast("string").cast("binary")) % 4
    kept = _columns(docs, key, text, source, lang, length).filter(F.col("__id").isNotNull() & ~held_out("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, t, m in _both(1)(batches):
            yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in t.astype(np.float32)], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], ["__id", "t", "m"])

    rows = kept.mapInArrow(run, f"__id {kept.schema['__id'].dataType.simpleString()}, t binary, m binary").join(gold, "__id", "left")
    table = written(rows.select(F.coalesce("__y", F.lit(-1)).alias("y"), fold.cast("int").alias("fold"), "t", "m"), "quality-features")
    return co_train(Passes(table), docs.sparkSession.sparkContext, (TEXT_FEATURES, 2 * CELLS + 3))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (probability of good quality), text_score, meta_score and predicted of every row."""
    kept = _columns(docs, key, text, source, lang, length)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for own, t, m in _both(1)(batches):
            a = model.text.odds(t) if model.text else np.zeros(len(t))
            b = model.meta.odds(meta_view(m)) if model.meta else np.zeros(len(t))
            both = np.c_[a, b, np.ones(len(a))] @ model.mix
            yield pa.RecordBatch.from_arrays([own[0], pa.array(chance(both)), pa.array(chance(a)), pa.array(chance(b))], ["doc_id", "score", "text_score", "meta_score"])

    scored = kept.mapInArrow(run, f"doc_id {kept.schema['__id'].dataType.simpleString()}, score double, text_score double, meta_score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= threshold).cast("int").alias("predicted"))
