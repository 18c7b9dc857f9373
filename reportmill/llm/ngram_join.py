"""N-gram Jaccard self-join by universe partition and pigeonhole.

A text's set is that of its distinct k-word shingles. Two sets with Jaccard similarity of at least t differ in at most
H = (1 - t) / (1 + t) * (|r| + |s|) shingles. Sizes are cut into bands; each band cuts the universe of shingle hashes
into m segments. Of a set, the part within a segment is one signature; for some segments there are also the signatures
of the part with one shingle left out (the one-deletion neighbourhood). A segment with only the first finds pairs that
differ nowhere in it, one with both finds pairs that differ in it at most once; so with allocations of 1 and 2 that add
up to H + 1 some segment finds each pair that may link. How many segments of either kind a band has is chosen by cost:
signatures to be shuffled against false candidates. Empty segments find nothing: bands have spare segments for them, and
a set with more empty segments than that also gives the signatures of these.

A difference of one shingle in a segment means that one set's whole part equals the other's part with one left out, so two
parts that both have one left out are never held against each other.

Sets that are equal (by 128 bits of hash) are one class, so copies are never paired. Within a bucket of one signature the
members are not paired with each other. A bucket's hub is the member that shares most signatures with others; first each
set is held against the hub that it meets in most buckets. Components of these links are made, and only members whose
component isn't that of the bucket's majority are then held against the members of other components. So every pair that may
link is either compared or known to be in one component already.

Buckets in which that would be more than BUCKET_PAIRS pairs, as where very many texts share a template and differ in words
of their own, are split once more by prefixes: with all shingles of their members in one order, rarest first, two sets of
similarity t share one of the first n - ceil(t * n) + 1 shingles of each. Their members are held against each other only
where they share such a shingle, again without those of the majority's component, and in blocks of BLOCK_ROWS rows, so that
no task holds a large bucket.

No pair is formed that a parity sketch rules out: each bit of a set's sketch is the parity of the number of its shingles
that hash to the bit, so two sketches differ in no more bits than the sets differ in shingles, and a pair whose sketches
differ in more than H bits can't link. Pairs that are left are compared word by word.

Frequent signatures are found beforehand among the texts of one in HINT by hash, and dealt to SALTS tasks each; this
decides where rows go, not which there are. Joins by hubs, roots and classes look frequent keys up in a bounded broadcast.

Null and blank texts have an empty set (n_shingles 0) and are linked with nothing, not even each other. A row without
id takes part, and its component is named by the smallest id that there is, or null. Rows with one id and several texts
are kept apart. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import BLOCK_BYTES, NOT_SPACE, blocks, mix, signed, words
from .components import components
from .skew import join_hot
from .store import delete, new_path, small_batches, written

K = 3
#: Two texts link when PER * intersection >= LEAST * union.
LEAST, PER = 90, 100
#: Upper end of a band of sizes, as a multiple of its lower end.
BAND = 1.3
#: Weight of a false candidate against a signature, for sets of one shingle; it falls with size, as passages that texts share do.
FALSE_COST = 1_000.0
#: Chance that a shingle of a set is also in a related one that doesn't link.
SHARED = 0.75
#: Up to so many ids of candidates are broadcast to read their texts again; beyond, they are joined by shuffle.
BROADCAST_IDS = 400_000
#: Pairs of a bucket that are formed without splitting it, and rows of a side of a block of one that is split.
BUCKET_PAIRS = 1 << 13
BLOCK_ROWS = 1_000
#: Shingles whose frequency decides their place in a split bucket's prefixes.
FREQUENT = 500_000
#: One in so many texts is looked at for frequent signatures; those found HINT_ROWS times, HINTED at most, are dealt to SALTS tasks.
HINT, HINT_ROWS, HINTED, SALTS = 64, 8, 50_000, 64
#: Longs of a parity sketch.
SKETCH = 8

_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _spare(needed: int, n: int) -> int:
    """Spare segments for so many needed ones, that a set of n shingles seldom has more empty segments than."""
    spare = 0
    for _ in range(30):
        m = needed + spare
        empty = m * math.exp(-n / m)
        more = math.ceil(empty + 3 * math.sqrt(empty)) if needed > 2 else 0
        if more <= spare:
            break
        spare = more
    return spare


@lru_cache(maxsize=4096)
def band(i: int, least: int, per: int) -> tuple[int, int, int, int, int]:
    """Of band i: smallest and largest size, segments with and without deletions, spare allocation."""
    lo = 1 if i == 0 else band(i - 1, least, per)[1] + 1
    hi = max(lo, int(lo * BAND))
    differ = (per - least) * 2 * hi // (per + least)
    if not differ:
        return lo, hi, 0, 0, 0
    best = None
    for d in range((differ + 2) // 2 + 1):
        e = max(0, differ + 1 - 2 * d)
        spare = _spare(d + e, lo) if e else 0
        m = d + e + spare
        g = (lo + hi) / 2 / m
        false = SHARED**g * (e + d * (1 + g * (1 - SHARED) / SHARED))
        cost = e + d * (1 + g) + FALSE_COST / lo * false
        if best is None or cost < best[0]:
            best = cost, d, e + spare, spare
    return lo, hi, *best[1:]


def band_of(n: int, least: int, per: int) -> int:
    i = 0
    while band(i, least, per)[1] < n:
        i += 1
    return i


def signatures(shingles: np.ndarray, i: int, least: int, per: int) -> tuple[np.ndarray, int]:
    """Signatures in band i of a sorted array of distinct shingle hashes, and how many of them, the first, are of whole parts."""
    _, _, d, e, spare = band(i, least, per)
    m = d + e
    if not m:
        return np.zeros(0, np.uint64), 0
    segment = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    cut = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    value = mix(shingles ^ _C1)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)]
    part = total[cut[1:]] - total[cut[:-1]]
    name = mix(np.arange(m, dtype=np.uint64) + np.uint64(i << 32) + _C2)
    full = mix(part ^ name) ^ name
    empty = cut[1:] == cut[:-1]
    if empty[d:].sum() <= spare:
        full = full[~empty | (np.arange(m) < d)]
    if not d:
        return full, len(full)
    own = segment[: cut[d]].astype(np.int64)
    return np.r_[full, mix((part[own] - value[: cut[d]]) ^ name[own]) ^ name[own]], len(full)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of k words, or of the whole text if it has fewer."""
    w = words(data, at, NOT_SPACE)
    h = w.hash
    rolled = h.copy()
    for j in range(1, k):
        rolled = mix(rolled[: len(h) - j] * _C1) + h[j:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(w.row_start[:-1].tolist(), w.row_start[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            x = h[a : a + 1]
            for j in range(a + 1, b):
                x = mix(x * _C1) + h[j : j + 1]
            out.append(mix(x ^ np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH longs of parities."""
    bit = (mix(shingles ^ _C1 ^ _C2) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.uint64)


def set_names(found: list[np.ndarray]) -> pa.Array:
    """A name of 128 bits for each set."""
    sums = np.array([[np.sum(mix(s ^ _C2), dtype=np.uint64), np.sum(mix(~s ^ _C1), dtype=np.uint64)] for s in found], np.uint64).reshape(-1, 2)
    names = mix(sums ^ np.array([len(s) for s in found], np.uint64)[:, None])
    return pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(np.arange(0, 16 * len(found) + 1, 16, dtype=np.int32)), pa.py_buffer(names.tobytes())])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.LargeListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64), pa.array(signed(flat))).cast(pa.list_(pa.int64()))


def sketch(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """doc_id, text_hash, n, set (hash of the whole set) and bits (its parity sketch) of every row."""
    kept = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in blocks(batch, "text"):
                found = shingle_sets(data, at, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(s) for s in found], pa.int32()), set_names(found), _lists([parity_sketch(s) for s in found])], ["doc_id", "text_hash", "n", "set", "bits"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text_hash long, n int, set binary, bits array<long>")


def emit(docs: DataFrame, text: str, k: int, least: int, per: int) -> DataFrame:
    """sig, set, n and whole: the signatures of every row's set. n is negative in the band above the set's own, where larger sets may link; whole: of a whole part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in blocks(batch, "text"):
                found = [s for s in shingle_sets(data, at, k) if len(s)]
                sig, size, whole = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
                times = []
                for s in found:
                    n = len(s)
                    i = band_of(n, least, per)
                    own, w0 = signatures(s, i, least, per)
                    after, w1 = signatures(s, i + 1, least, per) if per * n >= least * (band(i, least, per)[1] + 1) else (s[:0], 0)
                    sig += [own, after]
                    size.append(np.r_[np.full(len(own), n, np.int32), np.full(len(after), -n, np.int32)])
                    whole.append(np.r_[np.arange(len(own)) < w0, np.arange(len(after)) < w1])
                    times.append(len(own) + len(after))
                names = set_names(found).take(pa.array(np.repeat(np.arange(len(found)), times)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sig))), names, pa.array(np.concatenate(size)), pa.array(np.concatenate(whole))], ["sig", "set", "n", "whole"])

    return docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "sig long, set binary, n int, whole boolean")


def _texts(docs: DataFrame, about: DataFrame, pairs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """set and words (lower-cased, parted by single spaces) of the classes in pairs, from one text of each; written to path."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    ids = written(about.join(wanted, "set", "left_semi").select("set", F.col("kept.doc_id").alias("__id"), F.col("kept.text_hash").alias("__hash")), "candidates")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return written(rows.select("set", F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " ")).alias("words")).dropDuplicates(["set"]), "texts", path)


def exact_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct numbers of each text's k-word shingles, or of the whole text if it has fewer words. Equal shingles, and no others, have equal numbers; nothing is hashed."""
    split = pc.split_pattern(texts, " ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    word = split.flatten().dictionary_encode()
    none, names = len(word.dictionary), len(word.dictionary) + 1
    width = np.maximum(n, k)
    start = np.cumsum(width) - width
    told = np.full(int(width.sum()) + k - 1, none, np.int64)  # texts of fewer than k words are filled up with a word that there isn't
    told[np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)] = word.indices.to_numpy()
    number, most = told[: len(told) - k + 1], names
    for j in range(1, k):
        if most * names >= 1 << 62:
            ranks, number = np.unique(number, return_inverse=True)
            most = len(ranks)
        number = number * names + told[j : len(told) - k + 1 + j]
        most *= names
    return [np.unique(number[a : a + w - k + 1]) for a, w in zip(start.tolist(), width.tolist(), strict=True)]


def linking(batches: Iterator[pa.RecordBatch], k: int, least: int, per: int) -> Iterator[pa.RecordBatch]:
    """a and b of the rows (a, b, w_a, w_b) whose texts w_a and w_b link. Sets are held for rows of about BLOCK_BYTES of text (one row, if its texts are longer), however many rows a batch has."""
    for batch in batches:
        a, b = (batch.column(i).cast(pa.large_string()) for i in (2, 3))
        end = np.cumsum(pc.binary_length(a).to_numpy() + pc.binary_length(b).to_numpy())
        lo = 0
        while lo < len(end):
            hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
            texts = pa.concat_arrays([a.slice(lo, hi - lo), b.slice(lo, hi - lo)]).dictionary_encode()  # a hub's text is taken once
            found = exact_sets(texts.dictionary, k)
            keep = []
            for x, y in texts.indices.to_numpy().reshape(2, -1).T.tolist():
                common = len(np.intersect1d(found[x], found[y], assume_unique=True))
                keep.append(per * common >= least * (len(found[x]) + len(found[y]) - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])
            lo = hi


def _compared(docs: DataFrame, about: DataFrame, pairs: DataFrame, key: str, text: str, k: int, least: int, per: int) -> DataFrame:
    """The pairs (a, b) of classes whose texts' sets of shingles link, by the words themselves. The texts are stored only until the links are."""
    texts_at, half_at = (new_path(docs.sparkSession, name) for name in ("texts", "half-compared"))
    texts = _texts(docs, about, pairs, key, text, texts_at)
    of = lambda x: texts.select(F.col("set").alias(x), F.col("words").alias(f"w_{x}"))
    both = written(join_hot(pairs, of("a"), "a", size=F.octet_length("w_a")), "half-compared", half_at)
    both = join_hot(both, of("b"), "b", size=F.octet_length("w_b"))

    links = written(both.select("a", "b", "w_a", "w_b").mapInArrow(lambda batches: linking(batches, k, least, per), "a binary, b binary"), "links")
    for path in (texts_at, half_at):
        delete(docs.sparkSession, path)
    return links


def _split_pairs(docs: DataFrame, about: DataFrame, members: DataFrame, possible, key: str, text: str, k: int, least: int, per: int) -> DataFrame:
    """Pairs (set, x) with other roots that share a shingle of their prefixes and are possible, of members (set, root, size and sketch)."""
    names = about.join(members.select("set"), "set", "left_semi").select(F.col("kept.doc_id").alias("__id"), F.col("kept.text_hash").alias("__hash")).distinct()
    names = written(names, "split-ids")
    names = F.broadcast(names) if names.count() <= BROADCAST_IDS else names
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("h")).join(names, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__hash"))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in blocks(batch, "text"):
                shingle, n = np.unique(np.concatenate(shingle_sets(data, at, k)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(shingle)), pa.array(n)], ["shingle", "n"])

    # Any one order will do; the FREQUENT most frequent shingles come last, so that prefixes hold rare ones.
    frequency = rows.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df")).filter("df > 1")
    told = frequency.orderBy(F.desc("df"), "shingle").limit(FREQUENT).toArrow()
    shingle, df = told.column("shingle").to_numpy().view(np.uint64), told.column("df").to_numpy()
    by_name = np.argsort(shingle)
    shared = docs.sparkSession.sparkContext.broadcast((shingle[by_name], df[by_name]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = shared.value
        for batch in batches:
            for _, _, data, at in blocks(batch, "text"):
                found = [s for s in shingle_sets(data, at, k) if len(s)]
                kept = []
                for s in found:
                    times = np.ones(len(s), np.int64)
                    if len(known):
                        i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        times = np.where(known[i] == s, df[i], 1)
                    kept.append(s[np.lexsort((s, times))[: len(s) + least * len(s) // -per + 1]])
                row = pa.array(np.repeat(np.arange(len(found)), [len(s) for s in kept]))
                yield pa.RecordBatch.from_arrays([set_names(found).take(row), pa.array(signed(np.concatenate(kept))) if kept else pa.array([], pa.int64())], ["set", "token"])

    tokens = written(rows.mapInArrow(prefixes, "set binary, token long").distinct().join(members, "set"), "prefixes")
    sketch_of = [c for c in members.columns if c not in ("set", "root")]
    counts = tokens.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    counts = counts.select("token", F.col("m.root").alias("major"), F.ceil((F.col("all") - F.col("m.c")) / BLOCK_ROWS).cast("int").alias("xs"), F.ceil(F.col("all") / BLOCK_ROWS).cast("int").alias("ys"))
    told = join_hot(tokens, counts, "token")
    block = lambda n: F.pmod(F.xxhash64("set"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    odd = told.filter("root != major").withColumn("xb", block("xs")).withColumn("yb", all_of("ys")).select("token", "xb", "yb", F.col("set").alias("x"), F.col("root").alias("x_root"), *[F.col(c).alias(f"x_{c}") for c in sketch_of])
    every = told.withColumn("yb", block("ys")).withColumn("xb", all_of("xs")).select("token", "xb", "yb", "set", "root", *sketch_of)
    return odd.join(every, ["token", "xb", "yb"]).filter((F.col("root") != F.col("x_root")) & possible).select("set", "x")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, least: int = LEAST, per: int = PER) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, text_hash, n and set of every row, and set and root (the name of its component) of the sets that are linked."""
    small_batches(docs.sparkSession)
    each = written(sketch(docs, key, text, k), "sketches")
    filled = each.filter("n > 0")
    bits = [f"k{i}" for i in range(SKETCH)]
    row = F.struct("doc_id", "text_hash")
    about = filled.groupBy("set").agg(F.first("n").alias("size"), F.first("bits").alias("bits"), F.min(row).alias("kept"), F.count(F.lit(1)).alias("rows"))
    about = written(about.select("set", "size", "kept", "rows", *[F.get("bits", F.lit(i)).alias(b) for i, b in enumerate(bits)]), "classes")
    # One row of each class gives its signatures; the rows of copies are few enough to be broadcast, or else are shuffled.
    several = about.filter("rows > 1").select("set", "kept")
    copies = written(join_hot(filled.select("set", "doc_id", "text_hash"), several, "set").filter(~row.eqNullSafe(F.col("kept"))).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    classes = docs.join(copies, F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left_anti")
    # Dealt once by signature; frequent ones to several tasks.
    some = emit(classes.filter(F.pmod(F.xxhash64(text), F.lit(HINT)) == 0), text, k, least, per)
    hinted = some.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= HINT_ROWS).orderBy(F.desc("c"), "sig").limit(HINTED).select("sig").collect()  # HINTED longs at most
    emitted, by = emit(classes, text, k, least, per), ["sig"]
    frequent = F.lit(False)
    if hinted:
        hints = docs.sparkSession.createDataFrame([(r["sig"], True) for r in hinted], "sig long, hot boolean")
        frequent = F.coalesce("hot", F.lit(False))
        emitted = emitted.join(F.broadcast(hints), "sig", "left").withColumn("salt", F.when(frequent, F.pmod(F.xxhash64("set"), F.lit(SALTS))).otherwise(0))
        by = ["sig", "salt"]
    of_sig = Window.partitionBy(*by)
    emitted = emitted.withColumns({"members": F.count(F.lit(1)).over(of_sig), "largest": F.max("n").over(of_sig), "wholes": F.max("whole").over(of_sig)})
    ranked = written(emitted.filter(frequent | ((F.col("members") > 1) & (F.col("largest") > 0) & F.col("wholes"))).select("sig", "set", "n", "whole", "members").distinct(), "buckets")

    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"x_{b}"))) for b in bits), F.lit(0))
    fits = lambda m, x: (m * per >= x * least) & (x * per >= m * least)
    possible = fits(F.col("size"), F.col("x_size")) & (differ * (per + least) <= (F.col("size") + F.col("x_size")) * (per - least))
    own = about.select("set", "size", *bits)
    other = about.select(F.col("set").alias("x"), F.col("size").alias("x_size"), *[F.col(b).alias(f"x_{b}") for b in bits])
    order = (F.least("set", "x").alias("a"), F.greatest("set", "x").alias("b"))
    half_at = new_path(docs.sparkSession, "half-pairs")
    # Pairs (set, x) that sketches leave; x may be a hub.
    left = lambda pairs: join_hot(written(join_hot(pairs, own, "set"), "half-pairs", half_at), other, "x").filter(possible).select(*order).distinct()

    # First each set is held against the one hub that it shares most buckets with.
    degree = ranked.groupBy("set").agg(F.sum(F.col("members") - 1).alias("degree"))
    hubs = ranked.filter("n > 0").join(degree, "set").groupBy("sig").agg(F.max(F.struct("degree", "set", "n")).alias("hub")).select("sig", F.col("hub.set").alias("x"), F.col("hub.n").alias("x_n"))
    met = join_hot(ranked, hubs, "sig").filter((F.col("set") != F.col("x")) & fits(F.abs("n"), F.abs("x_n"))).groupBy("set", "x").agg(F.count(F.lit(1)).alias("c"))
    best = written(met.groupBy("set").agg(F.max(F.struct("c", "x")).alias("m")).select("set", F.col("m.x").alias("x")), "met")
    first = written(left(best), "pairs")
    delete(docs.sparkSession, half_at)
    links = _compared(docs, about, first, key, text, k, least, per)
    roots = components(links)
    each = each.select("doc_id", "text_hash", "n", "set")

    # Then those outside a bucket's largest component against the members of other components.
    rooted = written(ranked.join(roots.withColumnRenamed("node", "set"), "set", "left").select("sig", "set", "n", "whole", F.coalesce("root", "set").alias("root")), "rooted")
    by_root = rooted.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("largest"), F.max("whole").alias("wholes")).groupBy("sig").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("all"), F.max("largest").alias("largest"), F.max("wholes").alias("wholes"))
    by_root = by_root.filter("roots > 1 and largest > 0 and wholes").select("sig", F.col("m.root").alias("major"), ((F.col("all") - F.col("m.c")) * F.col("all") > BUCKET_PAIRS).alias("large"))
    split = written(join_hot(rooted, by_root, "sig").join(own, "set"), "split")
    sizes = {r["large"]: r["n"] for r in split.groupBy("large").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return each, roots.withColumnRenamed("node", "set")
    small = split.filter("not large")
    odd = small.filter("root != major").select("sig", F.col("set").alias("x"), F.col("n").alias("x_n"), F.col("whole").alias("x_whole"), F.col("root").alias("x_root"), *[F.col(c).alias(f"x_{c}") for c in ("size", *bits)])
    met = odd.join(small, "sig").filter(possible & (F.col("root") != F.col("x_root")) & ((F.col("n") > 0) | (F.col("x_n") > 0)) & (F.col("whole") | F.col("x_whole"))).select("set", "x")
    if sizes.get(True):
        members = written(split.filter("large").select("set", "root", "size", *bits).distinct(), "large-buckets")
        met = met.unionByName(_split_pairs(docs, about, members, possible, key, text, k, least, per))
    second = written(met.select(*order).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = _compared(docs, about, second, key, text, k, least, per)
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    return each, roots.withColumnRenamed("node", "set")


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, least: int = LEAST, per: int = PER) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of docs."""
    each, roots = groups(docs, key, text, k, least, per)
    filled = each.filter("n > 0")
    named = written(filled.groupBy("set").agg(F.min("doc_id").alias("m")).join(roots, "set", "left").select("set", "m", F.coalesce("root", "set").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("m").alias("component_id"))
    of_set = join_hot(named.select("root", "set"), smallest, "root").select("set", "component_id")
    out = join_hot(filled.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set"), of_set, "set").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(each.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each component: that with the smallest id (a row without id only if there is no other). Rows with empty sets all stay."""
    each, roots = groups(docs, key, text, **how)
    rows = join_hot(each.filter("n > 0"), roots, "set", "left").select("doc_id", "text_hash", F.coalesce("root", "set").alias("root"))
    rows = written(rows.withColumn("name", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")), "rooted-rows")
    kept = rows.groupBy("root").agg(F.min("name").alias("kept"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("root", "kept")
    members = written(join_hot(rows, kept, "root").select("doc_id", "text_hash", F.col("name").eqNullSafe(F.col("kept")).alias("is_kept")), "group-rows")
    names = (F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    gone = members.filter("not is_kept").select(*names).distinct()
    twins = members.filter("is_kept").groupBy("doc_id", "text_hash").count().filter("count > 1").select(*names)
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    left = docs.join(small(gone), same, "left_anti")
    if not twins.limit(1).count():
        return left
    twins = small(twins)
    again = left.join(twins, same, "left_semi").withColumn("__hash", F.xxhash64(text)).dropDuplicates([key, "__hash"]).drop("__hash")
    return left.join(twins, same, "left_anti").unionByName(again)
