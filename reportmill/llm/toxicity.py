"""Toxicity by weak supervision.

1. Voters. Lexicons and patterns vote on every text, and so do groups of words and word beginnings that are mined from
   the labelled rows outside the held-out fold. A voter says toxic or nothing.
2. Label model. Spark counts the vote patterns of all rows (a pattern is a bit set of voters, so there are at most
   2 ** voters of them, whatever the input). A generative model with a latent class and a rate for each voter and class
   is fitted to these counts by EM; labels of the learning fold are seen where there are any. Pairs of voters that agree
   more often within a class than the model says are correlated; the votes of correlated voters are weighed less, and
   the model is fitted once more.
3. Classifier. A logistic regression over words and word beginnings learns the label model's posteriors of all rows of
   the learning fold, labelled and unlabelled alike, and scores every whole text. Their features are written once; each step
   of the fit is a sum over them. Labels reach it through the label model and the choice of features only.

Rows whose crc32(id as text) mod 4 is 2 are held out: neither their labels nor their words are learnt from; only how often
their voters vote alike is counted with all rows' in the label model. Labels, language, source and id are no
inputs of a score. Null text is scored as empty, null id isn't held out. Labels are joined by id; of several labels of an
id the largest counts. Repeated rows get equal scores. Without labels the lexicons and patterns alone make the label model,
whose posteriors are learnt all the same. An empty table gives an empty result. Only the named columns are read.

Bounds (documented parameters): features are mined from at most SAMPLE labelled rows, chosen by a hash of the id; there are
at most FEATURES of them besides the lexicons' terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sums import Passes, minimise
from .bytewords import LETTERS, blocks, signed, words
from .store import fresh, small_batches, written

SAMPLE = 30_000
#: Steps of the fit at most.
STEPS = 40
FEATURES = 4_096
MINED = 512
MINED_GROUPS = 6
PREFIXES = (4, 5, 6)
#: How much more often a voter votes in toxic texts, at least, where no label tells.
BETTER = 3.0
THRESHOLD = 0.3

#: Terms of abuse by lexicon (one voter each).
LEXICONS = {
    "insult": "idiot idiots moron morons loser losers fool fools jerk imbecile clown clowns dumb stupid stupidity",
    "contempt": "scum trash garbage worthless pathetic disgusting filthy vermin pig pigs rat rats",
    "hate": "hate kill die shut hell damn bastard crap",
    "french": "idiote imbécile connard connasse salaud ordure crétin débile abruti minable",
    "german": "idiotin dummkopf arschloch trottel abschaum drecksack blödmann widerlich wertlos",
    "spanish": "estúpido estúpida imbécil basura asqueroso asquerosa payaso inútil patético idiotas",
}
PATTERNS = ("shouting", "exclaiming", "addressed")
_YOU = "you your youre du ihr dein tu toi vous tú usted eres".split()


def hashes(text: str) -> np.ndarray:
    data = text.encode()
    return words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), LETTERS).hash


class Members:
    """Finds which of a bounded set of 64-bit hashes each of many hashes is."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(np.asarray(values, np.uint64))
        self.order = np.argsort(np.asarray(values, np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, positions in the values given) of the members."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        hit = self.values[i] == h[at]
        return at[hit], self.order[i[hit]]


def feature_hits(w, members: Members) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, position) pairs of the features that stand in each text."""
    rows = w.rows()
    found = [(rows[at], f) for at, f in (members.find(h) for h in (w.hash, *w.prefix.values()))]
    r, f = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    pairs = np.unique(r.astype(np.int64) * max(1, len(members.values)) + f)
    return np.divmod(pairs, max(1, len(members.values)))


@dataclass
class Voters:
    """Bits of the voters: lexicons, patterns, then mined groups."""

    terms: np.ndarray
    bit: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, mined: list[int], lexicons: dict[str, str] = LEXICONS, groups: int = MINED_GROUPS) -> Voters:
        terms, bits = [], []
        names = [*lexicons, *PATTERNS, *(f"mined{i}" for i in range(groups if mined else 0))]
        seen: set[int] = set()
        for i, text in enumerate(lexicons.values()):
            for h in hashes(text).tolist():
                if h not in seen:
                    seen.add(h)
                    terms.append(h)
                    bits.append(1 << i)
        for i, h in enumerate(mined):
            if h not in seen:
                terms.append(h)
                bits.append(1 << (len(lexicons) + len(PATTERNS) + i % groups))
        return cls(np.array(terms, np.uint64), np.array(bits, np.int64), names)

    def vote(self, data: np.ndarray, at: np.ndarray, members: Members, you: Members) -> np.ndarray:
        w = words(data, at, LETTERS, PREFIXES)
        n = len(at) - 1
        out = np.zeros(n, np.int64)
        row, f = feature_hits(w, members)
        np.bitwise_or.at(out, row, self.bit[f])
        first = len(self.names) - len([x for x in self.names if x.startswith("mined")]) - len(PATTERNS)
        count = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][at])
        capitals, small = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
        size = np.diff(at)
        out |= np.where((capitals > 20) & (capitals > small), 1 << first, 0)
        out |= np.where(count(data == 33) * 100 > size, 1 << (first + 1), 0)
        addressed = np.zeros(n, bool)
        addressed[w.rows()[you.find(w.hash)[0]]] = True
        return out | np.where(addressed & (out & ((1 << first) - 1) > 0), 1 << (first + 2), 0)


def label_model(patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, voters: int, prior: float | None = None) -> dict:
    """A latent class with a vote rate for each voter and class, fitted to counts of (pattern, label or -1).

    Where no label is seen, votes are held to be at least BETTER times as frequent in toxic texts as in others, without which
    the two classes could change places. Gives rates, the correlation of each pair of voters within the classes beyond the model, weights, and the posterior
    of each pattern with and without its label.
    """
    votes = (patterns[:, None] >> np.arange(voters)) & 1
    known = labels >= 0
    total = counts.sum()
    if prior is None:
        seen = counts[known].sum()
        prior = (counts[labels == 1].sum() + 1) / (seen + 20) if seen else 0.1
    weight = np.ones(voters)
    p1 = np.where(votes.any(axis=1), 0.8, 0.02)
    correlation = np.zeros((voters, voters))
    for turn in range(3):
        for _ in range(60):
            q = np.where(known, labels, p1)
            m1, m0 = counts * q, counts * (1 - q)
            rate1 = (m1 @ votes + 0.5) / (m1.sum() + 1)
            rate0 = (m0 @ votes + 0.05) / (m0.sum() + 1)
            if not known.any():
                rate1 = np.clip(rate1, np.minimum(0.99, BETTER * rate0), 0.99)
            each = np.where(votes == 1, np.log(rate1 / rate0), np.log((1 - rate1) / (1 - rate0))) * weight
            odds = np.log(prior / (1 - prior)) + each.sum(axis=1)
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            moved = np.abs(new - p1).max() if len(new) else 0
            p1 = new
            if moved < 1e-6:
                break
        if turn < 2 and total:
            # What two voters have in common beyond the class, as all other voters (and labels) see it.
            extra = np.zeros((voters, voters))
            for i in range(voters):
                for j in range(i):
                    rest = np.where(known, labels, 1 / (1 + np.exp(-np.clip(odds - each[:, i] - each[:, j], -30, 30))))
                    extra[i, j] = extra[j, i] = _residual_correlation(votes[:, i], votes[:, j], rest, counts)
            usual = np.median(extra[np.triu_indices(voters, 1)]) if voters > 1 else 0.0
            correlation = np.clip(extra - max(usual, 0.0), 0, 1)
            np.fill_diagonal(correlation, 0)
            correlation[correlation < 0.1] = 0
            weight = 1 / (1 + correlation.sum(axis=1))
    return {"rates": (rate0, rate1), "correlation": correlation, "weight": weight, "prior": prior, "posterior": p1}


def _residual_correlation(a: np.ndarray, b: np.ndarray, q: np.ndarray, n: np.ndarray) -> float:
    """Correlation of two votes, with counts n, after a straight line in the class probability q is taken off each."""
    total = max(n.sum(), 1e-9)
    centre = lambda x: x - (n * x).sum() / total
    q = centre(q)
    left = [(lambda x: x - q * (n * x * q).sum() / max((n * q * q).sum(), 1e-9))(centre(v.astype(float))) for v in (a, b)]
    size = np.sqrt((n * left[0] ** 2).sum() * (n * left[1] ** 2).sum())
    return float((n * left[0] * left[1]).sum() / size) if size > 1e-9 else 0.0


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Ids and labels of the bounded sample of labelled rows of the learning fold."""
    ids = docs.select(F.col(key).alias("__id")).filter(F.col("__id").isNotNull() & ~held_out("__id")).distinct()
    return ids.join(labels, "__id").orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)


def mine(labelled: DataFrame) -> tuple[list[int], list[int]]:
    """Hashes of the features that tell toxic from other labelled rows, and of those that are toxic nearly always."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        toxic: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array(signed(np.array(keys, np.uint64))), pa.array([held[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["feature", "n", "n1"])

        for batch in batches:
            y = np.array(batch.column(batch.schema.get_field_index("y")).to_pylist())
            for lo, hi, data, at in blocks(batch, "text"):
                w = words(data, at, LETTERS, PREFIXES)
                rows = w.rows()
                for i in range(hi - lo):
                    a, b = w.row_start[i], w.row_start[i + 1]
                    own = np.unique(np.concatenate([w.hash[a:b], *(p[a:b] for p in w.prefix.values())])).tolist()
                    held.update(own)
                    if y[lo + i] == 1:
                        toxic.update(own)
                del rows
                if len(held) > 600_000:
                    yield out()
                    held, toxic = Counter(), Counter()
        if held:
            yield out()

    totals = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1")).first()
    n1, n0 = float(totals["n1"]), float(totals["n"] - totals["n1"])
    if not n1 or not n0:
        return [], []
    counts = labelled.select("text", "y").mapInArrow(run, "feature long, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    r1, r0 = F.col("n1") / n1, (F.col("n") - F.col("n1")) / n0
    pooled = F.col("n") / (n1 + n0)
    z = (r1 - r0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    strong = counts.filter(F.col("n1") >= 3).withColumn("z", z).withColumn("sure", F.col("n1") / F.col("n") >= 0.9).filter(F.col("z") >= 4)
    top = strong.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()  # at most FEATURES rows
    as_unsigned = lambda x: x & (1 << 64) - 1
    return [as_unsigned(r["feature"]) for r in top], [as_unsigned(r["feature"]) for r in top if r["sure"]][:MINED]


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    label_model: dict
    voters: list[str]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic") -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    gold = labels.select(F.col(label_key).alias("__id"), F.col(label).cast("int").alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out("__id")).groupBy("__id").agg(F.max("__y").alias("__y"))
    ids = written(_sample(docs, gold, key), "toxicity-sample")
    texts = docs.select(F.col(key).alias("__id"), F.coalesce(text, F.lit("")).alias("text"))
    features, sure = mine(texts.join(F.broadcast(ids), "__id").select("text", F.col("__y").alias("y")))  # ids: SAMPLE rows at most
    voters = Voters.of(sure)
    chosen = np.array(list(dict.fromkeys([*features, *(int(x) for x in voters.terms)])), np.uint64)
    shared = spark.sparkContext.broadcast((voters, Members(voters.terms), Members(hashes(" ".join(_YOU))), Members(chosen)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, members, you, wanted = shared.value
        for batch in batches:
            for lo, hi, data, at in blocks(batch, "text"):
                row, f = feature_hits(words(data, at, LETTERS, PREFIXES), wanted)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                packed = [f[a:b].astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(v.vote(data, at, members, you)), pa.array(packed, pa.binary())], ["__id", "pattern", "f"])

    table = written(texts.mapInArrow(extract, f"__id {texts.schema['__id'].dataType.simpleString()}, pattern long, f binary"), "toxicity-features")
    # At most 3 * 2 ** voters rows, whatever the input.
    counts = table.join(gold, "__id", "left").groupBy("pattern", F.coalesce("__y", F.lit(-1)).alias("y")).count().collect()
    p, y, n = (np.array([r[k] for r in counts], np.int64) for k in ("pattern", "y", "count"))
    model = label_model(p, y, n.astype(float), len(voters.names))
    known, first = np.unique(p, return_index=True)
    weights, bias = learn(table.filter(F.col("__id").isNotNull() & ~held_out("__id")).select("pattern", "f"), known, model["posterior"][first], len(chosen))
    return Model(chosen, weights, bias, model, voters.names)


def learn(rows: DataFrame, patterns: np.ndarray, posterior: np.ndarray, features: int, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2 logistic regression of the posteriors of rows' patterns (sorted) on their features (f, packed numbers)."""
    passes, context = Passes(rows), rows.sparkSession.sparkContext
    total = rows.groupBy("pattern").count().collect()  # at most 2 ** voters rows
    n = sum(r["count"] for r in total)
    if not n:
        return np.zeros(features), 0.0
    mass = sum(r["count"] * posterior[np.searchsorted(patterns, r["pattern"])] for r in total)
    start = np.zeros((1, features + 1))
    start[0, -1] = np.log((mass + 1) / (n - mass + 1))

    def losses(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = context.broadcast((points[0], patterns, posterior))

        def add(b: pa.RecordBatch) -> np.ndarray:
            w, known, q = shared.value
            packed = b.column(1).to_pylist()
            row = np.repeat(np.arange(len(packed)), [len(x) // 2 for x in packed])
            f = np.frombuffer(b"".join(packed), np.uint16).astype(np.int64)
            y = q[np.searchsorted(known, b.column(0).to_numpy(zero_copy_only=False))]
            z = np.bincount(row, weights=w[f], minlength=len(packed)) + w[-1]
            d = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            return np.r_[(np.logaddexp(0, z) - y * z).sum(), np.bincount(f, weights=d[row], minlength=features), d.sum()]

        sums = passes.total(add, features + 2)
        shared.destroy()
        ridge = l2 * np.r_[points[0, :-1], 0.0]
        return np.array([(sums[0] + (ridge @ points[0]) / 2) / n]), (sums[1:] + ridge)[None] / n

    w = minimise(losses, start, STEPS, tolerance=1e-6, gain=1e-6)[0]
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, and the columns of keep (but for the text)."""
    shared = docs.sparkSession.sparkContext.broadcast((Members(model.features), model.weights, model.bias))
    kept = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate((key, *keep))], F.coalesce(text, F.lit("")).alias("text"))
    n = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, weights, bias = shared.value
        for batch in batches:
            out = []
            for lo, hi, data, at in blocks(batch, "text"):
                row, f = feature_hits(words(data, at, LETTERS, PREFIXES), members)
                z = bias + np.bincount(row, weights=weights[f], minlength=hi - lo)
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.concatenate(out) if out else np.zeros(0))], [*(f"__{i}" for i in range(n)), "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    scored = kept.mapInArrow(run, StructType([*kept.schema.fields[:n], StructField("score", DoubleType())]))
    return scored.select(F.col("__0").alias("doc_id"), held_out("__0").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"__{i + 1}").alias(c) for i, c in enumerate(keep)])


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold; nothing is shuffled."""
    small_batches(docs.sparkSession)
    (plain,) = fresh(docs.columns, "plain_text")
    shared = docs.sparkSession.sparkContext.broadcast((Members(model.features), model.weights, model.bias))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, weights, bias = shared.value
        for batch in batches:
            for lo, hi, data, at in blocks(batch, plain):
                row, f = feature_hits(words(data, at, LETTERS, PREFIXES), members)
                z = bias + np.bincount(row, weights=weights[f], minlength=hi - lo)
                clean = 1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold
                if clean.any():
                    yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo).filter(pa.array(clean)) for c in batch.columns[:-1]], columns)

    return docs.withColumn(plain, F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(run, docs.schema)
