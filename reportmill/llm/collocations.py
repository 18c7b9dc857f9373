"""Frequent phrases of each language, and those whose words stand together more often than their parts suggest.

Texts are lower-cased in A-Z and cut into pieces at PIECE_ENDS, pieces into words at spaces and tabs. A phrase is up to
`longest` consecutive words of a piece; its frequency counts all its places in its language's texts.

First pass: phrases are hashed and dealt to hash partitions by the first bits of the hash. Tasks add up equal hashes and hand
on a summary for each partition; in each partition the summaries are merged into one Misra-Gries summary whose capacity
exceeds the partition's mass divided by the threshold. Merging lowers the counts of what doesn't fit by less than the
threshold in all, so every frequent phrase survives, with whatever else does. Survivors are marked in a bitmap of
bounded size, each partition's in a slice of its own. Second pass: phrases with a mark are counted as texts, exactly;
what isn't frequent goes then. Marks that stand for several phrases only let more through to be counted.

Collocations: cut after its first k words a phrase with a places, whose parts have l and r, scores
floor(SCALE * a / (l + r)); its lowest-scoring cut counts (then the smallest k). A phrase whose words lie within a longer frequent one
with at least `absorbed` percent of its places is left out. All arithmetic is in integers and decimals.

Null languages are the language NO_LANG. Null and empty texts have no words; pieces of one word have no phrases; repeated rows
count each time; a text of any length is read whole by one task, and its numbers lie in arrays of its words' number. Phrases with equal
scores and frequencies are in the order of their UTF-8 bytes. Empty tables give empty results. Other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import blocks, byte_table, mix, words
from .skew import join_hot
from .store import written

#: What ends a piece, and what parts words within one.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
NO_LANG = "und"
SCALE = 2_000_000
#: Phrase places that a hash partition is to have, and bytes of text to a phrase place at least: their number is set from the texts' bytes.
PARTITION_MASS, PLACE_BYTES = 2_000_000, 1.2
#: Phrase places that a task gathers before it hands on what they add up to.
GATHERED = 1_000_000
#: Entries of summaries that are merged at once at least.
MERGED = 250_000
#: Bits of the bitmap at most (32 MB), and bits to a survivor: it is made for as many as there can be, and folded to those there are.
BITMAP_BITS, BITS_EACH = 28, 8
#: Tasks that a language's best phrases are looked for in.
SALTS = 32

_WORDS = byte_table(b for b in range(256) if b not in PIECE_ENDS and b not in BLANKS)
_WORDS[0] = 255  # a byte that UTF-8 doesn't have, as 0 parts words there
_ENDS = np.isin(np.arange(256), list(PIECE_ENDS))
_K = np.uint64(0x9E3779B97F4A7C15)


class _Block:
    """Words of a block of texts: their hashes within their languages, and how many words of its piece a word has from itself on."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: np.ndarray, seeds: np.ndarray, longest: int):
        self.data, self.words = data, words(data, at, _WORDS)
        self.rows = self.words.rows()
        n = len(self.words.start)
        self.lang = langs[self.rows]
        self.seed = seeds[self.lang]
        ends = np.concatenate([[0], np.cumsum(_ENDS[data], dtype=np.int32)])
        on = np.zeros(n, bool)  # whether the next word is in the same piece
        if n > 1:
            on[:-1] = (self.rows[1:] == self.rows[:-1]) & (ends[self.words.start[1:]] == ends[self.words.end[:-1]])
        self.left = np.ones(n, np.int8)
        for _ in range(longest - 1):
            more = np.ones(n, np.int8)
            more[:-1][on[:-1]] += self.left[1:][on[:-1]]
            self.left = more

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all places of phrases of so many words, and the phrases' hashes."""
        first = np.flatnonzero(self.left >= size)
        h = self.seed[first] ^ np.uint64(size)
        for j in range(size):
            h = mix(h ^ self.words.hash[first + j])
        return first, h

    @functools.cached_property
    def lower(self) -> bytes:
        return self.data.tobytes().translate(_LOWER)

    def texts(self, first: np.ndarray, size: int) -> list[str]:
        """The phrases that begin at these words."""
        raw, out = self.lower, []
        for lo in range(0, len(first), 10_000):
            own = first[lo : lo + 10_000]
            made = [[raw[a:b] for a, b in zip(self.words.start[own + j].tolist(), self.words.end[own + j].tolist(), strict=True)] for j in range(size)]
            out += [b" ".join(one).decode("utf-8") for one in zip(*made, strict=True)]
        return out


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _blocks(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[_Block, list[str]]]:
    """Blocks of a batch (lang, text), and the names of its languages."""
    coded = batch.column(0).dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    for lo, hi, data, at in blocks(batch, batch.schema.names[1]):
        yield _Block(data, at, codes[lo:hi], seeds, longest), names


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(keys) else counts


def merge_summaries(parts: Iterator[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries summaries merged: at most `capacity` keys with counts, and by how much a count can be too low.

    Where more keys have counts, all are lowered by the (capacity + 1)-th largest count and those at 0 go: each time that takes
    so much from more than `capacity` keys, so in all less than the mass divided by the capacity.
    """
    held, waiting, lowered = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray, int]:
        keys, counts = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
        cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]) if len(keys) > capacity else 0
        return keys[counts > cut], counts[counts > cut] - cut, cut

    for part in parts:
        held.append(part)
        waiting += len(part[0])
        if waiting > max(capacity, MERGED):
            keys, counts, cut = merged()
            held, waiting, lowered = [(keys, counts)], 0, lowered + cut
    keys, counts, cut = merged()
    return keys, counts, lowered + cut


def _summaries(bits: int, longest: int):
    """A function from batches (lang, text) to rows (part, mass, keys, counts): key is the 32 bits of the hash after those that name the partition."""

    def hand_on(gathered: list[np.ndarray]) -> pa.RecordBatch:
        places = np.concatenate(gathered)
        gathered.clear()
        places.sort()
        begins = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        keys, counts = places[begins], np.diff(np.append(begins, len(places)))
        begins = np.searchsorted(keys >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
        low, told = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(counts, 0xFFFFFFFF).astype("<u4")
        spans = [(p, a, b) for p, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)) if b > a]
        columns = [[p for p, _, _ in spans], [int(counts[a:b].sum()) for _, a, b in spans], [low[a:b].tobytes() for _, a, b in spans], [told[a:b].tobytes() for _, a, b in spans]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "mass", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in batches:
            for block, _ in _blocks(batch, longest):
                for size in range(1, longest + 1):
                    # The partition's bits and the key's, in one number.
                    gathered.append(block.phrases(size)[1] >> np.uint64(32 - bits))
                    n += len(gathered[-1])
                if n >= GATHERED:
                    yield hand_on(gathered)
                    n = 0
                    pa.default_memory_pool().release_unused()
        if n:
            yield hand_on(gathered)

    return run


def _marks(bits: int, mark_bits: int, least: int):
    """A function from a partition's summaries to its slice of the bitmap."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(rows["mass"].sum()) // least + 1
        parts = ((np.frombuffer(k, "<u4").astype(np.uint64), np.frombuffer(c, "<u4").astype(np.int64)) for k, c in zip(rows["keys"], rows["counts"], strict=True))
        keys, counts, lowered = merge_summaries(parts, capacity)
        kept = keys[counts + lowered >= least]
        marks = np.zeros(1 << (mark_bits - bits), bool)
        marks[(kept >> np.uint64(32 - (mark_bits - bits))).astype(np.int64)] = True
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "survivors": [len(kept)], "marks": [np.packbits(marks).tobytes()]})

    return run


def _counts(told, mark_bits: int, longest: int):
    """A function from batches (lang, text) to rows (lang, size, phrase, f): marked phrases and their places; size 0: all words."""

    def hand_on(gathered: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        yield from pa.concat_tables(gathered).group_by(["lang", "size", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "size", "phrase", "f"]).to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, gathered, n = np.frombuffer(told.value, np.uint8), [], 0
        for batch in batches:
            for block, names in _blocks(batch, longest):
                for size in range(1, longest + 1):
                    first, h = block.phrases(size)
                    place = h >> np.uint64(64 - mark_bits)
                    found = np.flatnonzero(marks[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1)
                    if not len(found):
                        continue
                    first, h = first[found], h[found]
                    order = np.argsort(h)
                    first, h = first[order], h[order]
                    other = block.seed[first]
                    for j in range(size):
                        other = mix((other ^ block.words.hash[first + j]) * _K)
                    begins = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (other[1:] != other[:-1])]))
                    f = np.diff(np.append(begins, len(first)))
                    one = first[begins]
                    langs = pa.array(names).take(pa.array(block.lang[one]))
                    gathered.append(pa.table([langs, pa.array(np.full(len(one), size, np.int32)), pa.array(block.texts(one, size)), pa.array(f, pa.int64())], ["lang", "size", "phrase", "f"]))
                    n += len(one)
                all_words = np.bincount(block.lang, minlength=len(names))
                gathered.append(pa.table([pa.array(names), pa.array(np.zeros(len(names), np.int32)), pa.array([""] * len(names)), pa.array(all_words, pa.int64())], ["lang", "size", "phrase", "f"]))
                if n >= GATHERED // 8:
                    yield from hand_on(gathered)
                    gathered, n = [], 0
                    pa.default_memory_pool().release_unused()
        if gathered:
            yield from hand_on(gathered)

    return run


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, size, phrase and f of every phrase of 1 to `longest` words with at least `least` places in its language; size 0: f is the number of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = n_bytes / PLACE_BYTES * longest / 4
    bits = min(max(0, int(np.ceil(np.log2(max(1.0, places / PARTITION_MASS))))), 24)
    mark_bits = min(max(bits + 3, 16, int(np.ceil(np.log2(max(1.0, BITS_EACH * places / least))))), BITMAP_BITS)
    summaries = texts.mapInArrow(_summaries(bits, longest), "part int, mass long, keys binary, counts binary")
    slices = summaries.groupBy("part").applyInPandas(_marks(bits, mark_bits, least), "part int, survivors long, marks binary")
    rows = slices.collect()  # a slice for each partition, 2 ** BITMAP_BITS bits in all at most
    survivors = sum(r["survivors"] for r in rows)
    while mark_bits > max(bits + 3, 16) and BITS_EACH * survivors <= 1 << (mark_bits - 1):
        mark_bits -= 1
    width = 1 << (mark_bits - bits - 3)
    marks = bytearray(1 << (mark_bits - 3))
    for r in rows:
        found = np.unpackbits(np.frombuffer(r["marks"], np.uint8))
        marks[r["part"] * width : (r["part"] + 1) * width] = np.packbits(found.reshape(8 * width, -1).any(axis=1)).tobytes()
    told = spark.sparkContext.broadcast(bytes(marks))
    counted = texts.mapInArrow(_counts(told, mark_bits, longest), "lang string, size int, phrase string, f long")
    return written(counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("size") == 0)), "frequent")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, absorbed: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` best phrases of 2 to `longest` words, by score, frequency and phrase."""
    found = frequent_phrases(docs, least, longest, text, lang)
    # No phrase has a line feed, so language and phrase can be told from the joined key.
    key = lambda phrase: F.concat("lang", F.lit("\n"), phrase)
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    split = found.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), key(part(F.lit(1), k)).alias("first"), key(part(k + 1, F.col("size") - k)).alias("rest")))
    cut = split.select(key(F.col("phrase")).alias("key"), F.explode(cuts).alias("c")).select("key", "c.*")
    parts = found.filter("size > 0").select(key(F.col("phrase")).alias("part"), F.col("f").alias("part_f"))
    told = written(cut.withColumn("part", F.col("first")), "cuts")
    told = written(join_hot(told, parts, "part").select("key", "k", F.col("part_f").alias("l"), F.col("rest").alias("part")), "cuts")
    told = join_hot(told, parts, "part").select("key", "k", "l", F.col("part_f").alias("r"))
    # Phrases within longer ones, with the largest frequency of those.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: key(part(i, n)))))
    within = split.filter("size > 2").select(F.explode(inner).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    candidates = split.select(key(F.col("phrase")).alias("key"), "lang", "phrase", F.col("f").alias("a")).join(within, "key", "left")
    candidates = candidates.filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer") < F.lit(absorbed).cast("decimal(3,0)") * F.col("a")))
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div cast(cast(l as decimal(19,0)) + cast(r as decimal(19,0)) as decimal(20,0))")
    scored = candidates.join(told, "key").select("key", "lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c"))
    best = scored.groupBy("key", "lang", "phrase", "a").agg(F.min("c").alias("c")).select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", "salt").orderBy(*order)
    first = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
