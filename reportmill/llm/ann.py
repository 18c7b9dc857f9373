"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Vectors x become (x, sqrt(M^2 - |x|^2)) with the largest norm M, queries (q, 0), so that the largest inner product is the
smallest angle. Each tree halves a bounded sample of SAMPLE vectors again and again at the median of a random projection
(the difference of two of the node's vectors); every row is then sent to its leaf in each tree. A query goes through all
trees with one priority queue of branches, ordered by how far the query is from the branch's half-space, until it has
opened `probes` leaves; all members of these leaves are ranked by the exact inner product in double precision.

probes is chosen by measured recall: for at most TUNED queries the true neighbours are found by brute force over all
rows, and probes is the least number of leaves that holds TARGET of them.

Identical vectors are one class; of a class only the k + 1 smallest ids can be among k neighbours, so no more are carried
into the ranking, and this loses nothing. Leaves with many members or queries are dealt in chunks to many tasks.

The sample and the planes, which are broadcast, have at most HELD_BYTES each, whatever the dimension.

Vectors that are null, zero, of another length than most (the longer, of equally frequent lengths), or hold null or non-finite components take no part, nor
do rows without id. A repeated row counts once. With no queries or no candidates the result is empty; a query with fewer
than k candidates has all of them, where the leaves opened hold them. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_hot
from .store import written

TREES = 4
#: Vectors of the sample that the trees are fitted on: the usual number, and four for each leaf in large tables.
SAMPLE = 16_384
#: Members that a leaf is to have: four times the square root of the table's vectors, LEAF at most. A leaf is ranked by one
#: matrix product; a query moves a row for each leaf that it opens, so large leaves move fewer rows for the same members.
LEAF = 1_024
#: Levels of a tree at most: beyond LEAF << DEEPEST vectors (16 million) leaves grow with the table.
DEEPEST = 14
HELD_BYTES = 64 << 20
TUNED = 64
TARGET = 0.95
#: Members or queries of a leaf that are worked on at once.
CHUNK = 2_048


@dataclass
class Forest:
    """Trees as arrays: inner node i of a tree has the children 2i + 1 and 2i + 2."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    norm: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each lifted vector in each tree, numbered over all trees."""
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.planes[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + right
            out[:, t] = (t << self.depth) + node - ((1 << self.depth) - 1)
        return out

    def probe(self, q: np.ndarray, probes: int) -> list[list[int]]:
        """For each query the first leaves in the order of the shared queue."""
        inner = (1 << self.depth) - 1
        q = np.c_[q / np.maximum(1e-300, np.sqrt((q * q).sum(axis=1)))[:, None], np.zeros(len(q))]
        out = []
        for lo in range(0, len(q), 256):
            margins = [q[lo : lo + 256] @ self.planes[t].T - self.cuts[t] for t in range(len(self.planes))]
            for i in range(len(q[lo : lo + 256])):
                margin = [m[i].tolist() for m in margins]
                queue = [(0.0, t, 0) for t in range(len(margin))]
                found: list[int] = []
                while queue and len(found) < probes:
                    far, t, node = heapq.heappop(queue)
                    while node < inner:
                        m = margin[t][node]
                        near = 2 * node + 1 + (m > 0)
                        heapq.heappush(queue, (max(far, abs(m)), t, 4 * node + 3 - near))
                        node = near
                    found.append((t << self.depth) + node - inner)
                out.append(found)
        return out


def grow(sample: np.ndarray, norm: float, depth: int, trees: int, seed: int) -> Forest:
    draw = np.random.default_rng(seed)
    inner, d = (1 << depth) - 1, sample.shape[1] + 1
    forest = Forest(np.zeros((trees, inner, d)), np.zeros((trees, inner)), depth, norm)
    x = forest.lifted(sample)
    for t in range(trees):
        rows = {0: np.arange(len(x))}
        for node in range(inner):
            own = rows.pop(node)
            if len(own) >= 2:
                a, b = draw.choice(own, 2, replace=False)
                plane = x[a] - x[b]
            else:
                plane = draw.standard_normal(d)
            plane /= max(1e-12, np.linalg.norm(plane))
            p = x[own] @ plane
            cut = float(np.median(p)) if len(own) else 0.0
            forest.planes[t, node], forest.cuts[t, node] = plane, cut
            right = p > cut
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return forest


def _matrix(column, dim: int) -> np.ndarray:
    """Doubles from a column of packed vectors."""
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k largest scores of each row, ties at the end to the smaller id."""
    if scores.shape[1] > 4 * k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        r, c = np.nonzero(scores >= least[:, None])
    else:
        r, c = np.indices(scores.shape).reshape(2, -1)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(scores)))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], c[keep]


def _brute(classes: DataFrame, queries: list[tuple[int, np.ndarray]], dim: int, k: int) -> dict[int, list[tuple[int, bytes]]]:
    """True neighbours (class, vector) of a few queries, over all classes."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((np.array([i for i, _ in queries]), np.stack([v for _, v in queries])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = shared.value
        for frame in frames:
            ids = frame["c"].to_numpy()
            for lo in range(0, len(frame), CHUNK):
                part = ids[lo : lo + CHUNK]
                s = q @ _matrix(frame["v"].iloc[lo : lo + CHUNK], dim).T
                r, c = _top(s, part, k)
                yield pd.DataFrame({"q": qid[r], "c": part[c], "score": s[r, c], "v": frame["v"].iloc[lo : lo + CHUNK].to_numpy()[c]})

    near = classes.select("c", "v").mapInPandas(run, "q long, c long, score double, v binary").filter("q != c")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("rank") <= k)
    out: dict[int, list[tuple[int, bytes]]] = {}
    for r in best.collect():  # at most TUNED * k rows
        out.setdefault(r["q"], []).append((r["c"], bytes(r["v"])))
    return out


def nearest(vectors: DataFrame, k: int = 20, queries=None, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, seed: int = 7, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row that the condition `queries` holds for (of a column; by default ids divisible by 20)."""
    spark = vectors.sparkSession
    is_query = queries or (lambda c: c % 20 == 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    good = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.filter(F.coalesce(good, F.lit(False)))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], result)
    dim = lengths["d"]
    # -0.0 + 0.0 is 0.0: equal vectors have equal names, of 128 bits.
    rows = rows.filter(F.size("x") == dim).select("id", F.transform("x", lambda v: v + F.lit(0.0)).alias("x"))
    rows = rows.withColumn("name", F.concat(F.hex(F.xxhash64("x")), F.lit(":"), F.hex(F.xxhash64(F.lit(1), "x"))))
    grouped = rows.groupBy("name").agg(F.min("id").alias("c"), F.first("x").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((flat * flat).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in flat], pa.binary()), pa.array(norm)], ["name", "c", "v", "norm"])

    classes = written(grouped.select("name", "c", "x").mapInArrow(pack, "name string, c long, v binary, norm double"), "classes")
    named = written(rows.select("id", "name").distinct(), "names")
    of_class = written(join_hot(named, classes.select("name", "c"), "name").select("id", "c"), "members")
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).first()
    leaf = min(LEAF, 4 * float(np.sqrt(total["n"])))
    deepest = int(np.log2(max(1, HELD_BYTES // (8 * (dim + 1) * trees)) + 1))
    depth = int(min(DEEPEST, deepest, max(0, np.ceil(np.log2(max(1, total["n"] / leaf))))))
    sample = classes.orderBy(F.xxhash64("c"), "c").limit(max(4, min(max(SAMPLE, 4 << depth), HELD_BYTES // (8 * dim)))).select("v").collect()
    depth = min(depth, int(np.log2(max(4, len(sample)) / 4)))
    forest = grow(_matrix([r["v"] for r in sample], dim), total["norm"], depth, trees, seed)
    asked = of_class.filter(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "c")
    asked_classes = classes.join(asked.select("c").distinct(), "c", "left_semi")

    some = [(r["c"], np.frombuffer(bytes(r["v"]), np.float64)) for r in asked_classes.orderBy(F.xxhash64(F.lit(1), "c"), "c").limit(TUNED).select("c", "v").collect()]
    if not some:
        return spark.createDataFrame([], result)
    true = _brute(classes, some, dim, k + 1)
    leaves = trees << depth
    paths = forest.probe(np.stack([v for _, v in some]), leaves)
    ranks = []
    for (c, _), path in zip(some, paths, strict=True):
        at = np.full(leaves, leaves)
        at[path] = np.arange(len(path))
        near = true.get(c, [])[:k]
        if near:
            own = forest.leaves(forest.lifted(_matrix([v for _, v in near], dim)))
            ranks += at[own].min(axis=1).tolist()
    probes = int(np.quantile(ranks, target, method="higher")) + 1 if ranks else 1
    # Of the sample's vectors in the leaves that a query opens the (k + 1)-th best is found for sure: what scores less isn't handed on.
    known = _matrix([r["v"] for r in sample], dim)
    shared = spark.sparkContext.broadcast((forest, known, forest.leaves(forest.lifted(known))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value[0]
        for b in batches:
            x = _matrix([v.as_py() for v in b.column(1)], dim) if b.num_rows else np.zeros((0, dim))
            leaf = f.leaves(f.lifted(x)) if b.num_rows else np.zeros((0, trees), np.int64)
            at = pa.array(np.repeat(np.arange(b.num_rows), trees))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(leaf.reshape(-1))], ["c", "v", "leaf"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, known, at_leaf = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                asking = _matrix([v.as_py() for v in part.column(1)], dim)
                found = f.probe(asking, probes)
                least = np.full(len(asking), -np.inf)
                scores = asking @ known.T
                for i, path in enumerate(found):
                    opened = np.zeros(trees << f.depth, bool)
                    opened[path] = True
                    own = scores[i][opened[at_leaf].any(axis=1)]
                    if len(own) > k:
                        least[i] = np.partition(own, len(own) - k - 1)[-k - 1]
                least -= 1e-9 * np.where(np.isfinite(least), np.abs(least), 0)
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(found).astype(np.int64)), pa.array(least).take(at)], ["q", "v", "leaf", "least"])

    members = classes.select("c", "v").mapInArrow(route, "c long, v binary, leaf long")
    probed = asked_classes.select("c", "v").mapInArrow(ask, "q long, v binary, leaf long, least double")
    # At most trees << DEEPEST rows (65,536): chunks of members and of queries of each leaf.
    sizes = members.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("ms")).join(probed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("qs")), "leaf")
    sizes = F.broadcast(written(sizes, "leaves"))
    dealt = lambda df, mine, all_of, name: df.join(sizes, "leaf").withColumn(name[0], F.pmod(F.xxhash64(mine), F.col(all_of[0])).cast("int")).withColumn(name[1], F.explode(F.sequence(F.lit(0), F.col(all_of[1]) - 1)))
    left = dealt(members, "c", ("ms", "qs"), ("m", "n")).select("leaf", "m", "n", "c", "v")
    right = dealt(probed, "q", ("qs", "ms"), ("n", "m")).select("leaf", "m", "n", "q", "v", "least")

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids, qs = a["c"].to_numpy(), b["q"].to_numpy()
        x, y = _matrix(a["v"], dim), _matrix(b["v"], dim)
        out = []
        for lo in range(0, len(qs), 256):
            s = y[lo : lo + 256] @ x.T
            r, c = _top(s, ids, k + 1)
            enough = s[r, c] >= b["least"].to_numpy()[lo + r]
            r, c = r[enough], c[enough]
            out.append(pd.DataFrame({"q": qs[lo + r], "c": ids[c], "score": s[r, c]}))
        return pd.concat(out)

    keys = ("leaf", "m", "n")
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "q long, c long, score double")
    scored = scored.groupBy("q", "c").agg(F.max("score").alias("score"))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("place") <= k + 1).drop("place")
    # The k + 1 smallest ids of each class, first of each of its salts: a common vector may hold very many.
    some = of_class.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("place", F.row_number().over(Window.partitionBy("c", "salt").orderBy("id"))).filter(F.col("place") <= k + 1)
    few = some.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy("id"))).filter(F.col("place") <= k + 1).select("c", F.col("id").alias("vec_id"))
    listed = best.join(few, "c").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1)
    lists = written(listed.groupBy(F.col("q").alias("c")).agg(F.collect_list(F.struct("vec_id", "score")).alias("near")), "lists")  # k + 1 each
    own = join_hot(asked, lists, "c").select("query_id", F.explode("near").alias("n")).select("query_id", "n.*").filter("query_id != vec_id")
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return own.select("query_id", "rank", "vec_id", "score")
