"""Benchmark decontamination: BM25 with block-max WAND over test items, queried with every passage of every text.

Index: the items' words with BM25 weights, each item's weights divided by its score against itself, so that one threshold
holds for all. Items are in blocks, and of each block every term's largest weight is kept. Of a block's terms the slightest,
whose block maxima together stay below half the threshold, are not essential. A passage is a window of words, twice as long
as the longest item and overlapping its neighbours by half, so each copy of an item lies within one. For all passages of a
block of texts at once, the block maxima of their essential terms are added up; a block of items is skipped, as block-max
WAND skips it, unless these and all that its other terms could add reach the threshold. Items of the blocks that are left
are scored exactly, and every item at or above the threshold is retrieved. A retrieved item counts if its question (all but the last sentence) and its answer (the last
sentence, or the last quarter where there is one sentence) both overlap with the passage: of the question's shingles and of
the answer's words the shares `question` and `answer` at least.

Items are indexed in shards of at most SHARD_ITEMS; a pass over the texts holds the indexes of several of them, HELD_BYTES
at most or else one, and words are hashed once for all. Document
frequencies and lengths are those of all items, whatever the shards. Items longer than LONGEST words are indexed in parts.

Case is folded in all scripts. Null text is empty and never contaminated; items without words are left out. A table without rows, or a benchmark without
items, gives no hits. Rows with equal ids are merged in the report of hits and filtered each for itself. Of the inputs
only the named columns are read; drop_contaminated() keeps all columns of its rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import WORD_CHARS, blocks, mix, signed, words
from .store import fresh, written
from .toxicity import Members

K1, B = 1.2, 0.75
#: Share of an item's score against itself that a passage needs.
THRESHOLD = 0.6
QUESTION, ANSWER = 0.5, 0.6
SHARD_ITEMS = 20_000
#: Shards whose indexes are broadcast together, and their bytes (some 15 MB each), at most.
HELD_SHARDS, HELD_BYTES = 16, 64 << 20
#: Items beyond so many words are indexed in parts of so many.
LONGEST = 256
#: Words of a question's shingles (of all its words, if it has fewer).
SHINGLE = 3
#: Items of a block.
BLOCK = 4


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, or of the whole if it is shorter."""
    k = max(1, min(k, len(h)))
    out = h.copy()
    for j in range(1, k):
        out = mix(out[: len(h) - j]) ^ h[j:]
    return out


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that is one text."""
    cuts = [m.end() for m in re.finditer(r"[.!?](?=\s)", text.rstrip())]
    if cuts and text[cuts[-1] :].strip():
        return text[: cuts[-1]], text[cuts[-1] :]
    parts = text.split()
    cut = len(parts) - max(1, len(parts) // 4)
    return " ".join(parts[:cut]) or text, " ".join(parts[cut:])


@dataclass
class Block:
    """Some neighbouring items: their terms (positions in the index) and each term's weight for each item."""

    first: int
    terms: np.ndarray
    weights: np.ndarray
    spare: float


@dataclass
class Index:
    """Blocks of a shard of items, and the postings of their essential terms; weights are shares of an item's score against itself."""

    items: list
    terms: Members
    blocks: list[Block]
    essential: Members
    start: np.ndarray
    block: np.ndarray
    most: np.ndarray
    need: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    shingle: list[int]
    stride: int
    threshold: float

    def candidates(self, w) -> Iterator[tuple[int, int, int]]:
        """(row, window, block) where the essential terms' block maxima, and all that the other terms of the block could add, reach the threshold."""
        place, term = self.essential.find(w.hash)
        if not len(place):
            return
        row = np.searchsorted(w.row_start, place, "right") - 1
        window = (place - w.row_start[row]) // self.stride
        # A word is in the window that begins with its stretch and in the one before.
        r, win, t = np.r_[row, row], np.r_[window, window - 1], np.r_[term, term]
        keep = win >= 0
        width, n = int(win.max(initial=0)) + 1, len(self.start) - 1
        code = np.unique((r[keep].astype(np.int64) * width + win[keep]) * n + t[keep])
        passage, t = np.divmod(code, n)
        many = self.start[t + 1] - self.start[t]
        at = np.repeat(self.start[t] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        pair = np.repeat(passage, many) * len(self.blocks) + self.block[at]
        order = np.argsort(pair, kind="stable")
        pair, bound = pair[order], self.most[at][order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        enough = np.add.reduceat(bound, first) >= self.need[pair[first] % len(self.blocks)] - 1e-9
        for x in pair[first][enough].tolist():
            p, b = divmod(x, len(self.blocks))
            yield *divmod(p, width), b

    def hits(self, w, threshold: float, question: float, answer: float) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(row, item, first word, score, question overlap, answer overlap) of the verified items of each text, by its words."""
        for r, win, b in self.candidates(w):
            lo = int(w.row_start[r]) + win * self.stride
            own = w.hash[lo : min(int(w.row_start[r + 1]), lo + 2 * self.stride)]
            block = self.blocks[b]
            query = np.unique(self.terms.find(own)[1])
            i = np.minimum(np.searchsorted(block.terms, query), len(block.terms) - 1)
            score = block.weights[i[block.terms[i] == query]].sum(axis=0)
            for j in np.flatnonzero(score >= threshold - 1e-9).tolist():
                item = block.first + j
                q = float(np.isin(self.question[item], _rolled(own, self.shingle[item])).mean())
                a = float(np.isin(self.answer[item], own).mean())
                if q >= question and a >= answer:
                    yield r, item, win * self.stride, min(float(score[j]), 1.0), q, a


def word_hashes(text: str) -> np.ndarray:
    data = text.encode()
    return words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), WORD_CHARS).hash


def item_parts(items: DataFrame, item_key: str, text: str, question: str | None, answer: str | None) -> DataFrame:
    """item_id, part, hashes of the words, question shingles and answer words of every part of an item."""
    kept = items.select(F.col(item_key).alias("item_id"), *([F.lower(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((question, "q"), (answer, "a"))] if question and answer else [F.lower(F.coalesce(text, F.lit(""))).alias("q"), F.lit(None).cast("string").alias("a")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, q, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a is None:
                    q, a = split_item(q)
                hq, ha = word_hashes(q), word_hashes(a)
                whole = np.r_[hq, ha]
                for part, lo in enumerate(range(0, len(whole), LONGEST)):
                    x, y = hq[lo : lo + LONGEST], ha[max(0, lo - len(hq)) : max(0, lo + LONGEST - len(hq))]
                    if len(x) and len(y):
                        asked, an = x, y
                    else:  # a part within the question or the answer, or an item without one of them
                        asked = an = whole[lo : lo + LONGEST]
                    out.append((i, part, signed(whole[lo : lo + LONGEST]).tolist(), min(SHINGLE, len(asked)), signed(np.unique(_rolled(asked, SHINGLE))).tolist(), signed(np.unique(an)).tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], longs), pa.array(cols[3], pa.int32()), *(pa.array(c, longs) for c in cols[4:])], ["item_id", "part", "words", "shingle", "question", "answer"])

    return kept.mapInArrow(run, f"item_id {kept.schema['item_id'].dataType.simpleString()}, part int, words array<long>, shingle int, question array<long>, answer array<long>")


def build_indexes(items: DataFrame, item_key: str = "item_id", text: str = "text", question: str | None = None, answer: str | None = None, threshold: float = THRESHOLD) -> Iterator[Index]:
    """Indexes of all items for a threshold, a shard at a time."""
    parts = written(item_parts(items, item_key, text, question, answer), "items")
    total = parts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words"), F.max(F.size("words")).alias("longest")).first()
    if not total["n"]:
        return
    n, mean, stride = total["n"], total["words"] / total["n"], max(16, total["longest"])
    shards = -(-n // SHARD_ITEMS)
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("item_id", "part"), F.lit(2 * shards if shards > 1 else 1)))
    frequency = parts.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if shards > 1:
        frequency = written(frequency, "frequencies")
    for s in range(2 * shards if shards > 1 else 1):
        own = parts.filter(F.col("shard") == s)
        rows = own.orderBy("item_id", "part").collect()  # about SHARD_ITEMS / 2 parts of at most LONGEST words
        if not rows:
            continue
        df = {r["term"]: r["df"] for r in frequency.join(own.select(F.explode("words").alias("term")).distinct(), "term").collect()}
        terms = sorted(df)
        number = {t: i for i, t in enumerate(terms)}
        weights = []
        for r in rows:
            tf: dict[int, int] = {}
            for t in r["words"]:
                tf[t] = tf.get(t, 0) + 1
            length = K1 * (1 - B + B * len(r["words"]) / mean)
            w = {number[t]: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + length) for t, f in tf.items()}
            whole = sum(w.values())
            weights.append({t: x / whole for t, x in w.items()})
        cut = [_block(weights, lo, threshold) for lo in range(0, len(rows), BLOCK)]
        postings: dict[int, list[tuple[int, float]]] = {}
        for b, (_, essential) in enumerate(cut):
            for t, x in essential:
                postings.setdefault(t, []).append((b, x))
        held = sorted(postings)
        flat = [x for t in held for x in postings[t]]
        yield Index(
            items=[r["item_id"] for r in rows],
            terms=Members(np.array(terms, np.int64).view(np.uint64)),
            blocks=[x for x, _ in cut],
            essential=Members(np.array([terms[t] for t in held], np.int64).view(np.uint64)),
            start=np.r_[0, np.cumsum([len(postings[t]) for t in held])].astype(np.int64),
            block=np.array([b for b, _ in flat], np.int64),
            most=np.array([x for _, x in flat]),
            need=np.array([threshold - x.spare for x, _ in cut]),
            question=[np.array(r["question"], np.int64).view(np.uint64) for r in rows],
            answer=[np.array(r["answer"], np.int64).view(np.uint64) for r in rows],
            shingle=[r["shingle"] for r in rows],
            stride=stride,
            threshold=threshold,
        )


def held_indexes(indexes: Iterator[Index]) -> Iterator[list[Index]]:
    """Up to HELD_SHARDS indexes at a time, of HELD_BYTES in all at most where there are several."""
    held: list[Index] = []
    size = 0
    for index in indexes:
        n = len(pickle.dumps(index, pickle.HIGHEST_PROTOCOL))
        if held and (len(held) == HELD_SHARDS or size + n > HELD_BYTES):
            yield held
            held, size = [], 0
        held.append(index)
        size += n
    if held:
        yield held


def _block(weights: list[dict[int, float]], lo: int, threshold: float) -> tuple[Block, list[tuple[int, float]]]:
    """A block of items, and its essential terms with their block maxima: all but the slightest, which together stay below half the threshold."""
    own = weights[lo : lo + BLOCK]
    terms = sorted(set().union(*own))
    table = np.array([[w.get(t, 0.0) for w in own] for t in terms])
    most = table.max(axis=1)
    order = np.argsort(most, kind="stable")
    total = np.cumsum(most[order])
    slight = int(np.searchsorted(total, threshold / 2, "right"))
    spare = float(total[slight - 1]) if slight else 0.0
    return Block(lo, np.array(terms, np.int64), table, spare), [(terms[i], float(most[i])) for i in order[slight:].tolist()]


def find_contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, **item_columns) -> DataFrame:
    """doc_id, item_id, first_word (of the passage), score, question_overlap and answer_overlap: the best passage of each text for each item that it holds."""
    kept = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    kinds = {n: f.schema[c].dataType.simpleString() for n, f, c in (("doc_id", docs, key), ("item_id", items, item_columns.get("item_key", "item_id")))}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, first_word long, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], schema)
    for indexes in held_indexes(build_indexes(items, threshold=threshold, **item_columns)):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for lo, _, data, at in blocks(batch, "text"):
                    w = words(data, at, WORD_CHARS)
                    rows = [(r, index.items[i], *rest) for index in shared.value for r, i, *rest in index.hits(w, threshold, question, answer)]
                    if rows:
                        r, i, p, s, q, a = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + x for x in r])), pa.array(i), pa.array(p, pa.int64()), pa.array(s), pa.array(q), pa.array(a)], ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"])

        found = found.unionByName(kept.mapInArrow(run, schema))
    best = F.max(F.struct("score", (-F.col("first_word")).alias("p"), "question_overlap", "answer_overlap")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.p")).alias("first_word"), "m.score", "m.question_overlap", "m.answer_overlap")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, **item_columns) -> DataFrame:
    """The rows of docs that hold no item; nothing is shuffled."""
    (plain,) = fresh(docs.columns, "plain_text")
    columns = docs.columns
    for indexes in held_indexes(build_indexes(items, threshold=threshold, **item_columns)):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, at in blocks(batch, plain):
                    clean, w = np.ones(hi - lo, bool), words(data, at, WORD_CHARS)
                    for index in shared.value:
                        for hit in index.hits(w, threshold, question, answer):
                            clean[hit[0]] = False
                    if clean.any():
                        yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo).filter(pa.array(clean)) for c in batch.columns[:-1]], columns)

        docs = docs.withColumn(plain, F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))).mapInArrow(run, docs.schema)
    return docs
