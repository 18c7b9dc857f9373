"""The Merkle manifest, byte-level BPE and phrase mining against brute force, the library and SQL."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reportmill.llm import byte_bpe, collocations, merkle, queries
from tests.test_queries import compared

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_as_sql(spark, sf_dir, name):
    compared(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


# ---- Manifest ----


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i - i % 3 : i], level[i + 1 : i - i % 3 + 3]))
        i //= 3
    return out


def manifest(rows, tamper):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(told, r)))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            proof, folded = path(trees[s], i) + path(top, j), leaf(tamper(r))
            for left, right in proof:
                folded = h("".join([*left, folded, *right]))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], "".join(x for left, right in proof for x in left + right), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def tampered(r):
    return (*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r


def proved(docs, **how):
    now = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.prove(docs, {"text": now}, **how)
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, bytes(r.proof).hex(), r.folded_root, r.verified) for r in rows.collect()), key=str)


@pytest.mark.parametrize(("n", "levels"), [(0, 7), (1, 7), (120, 7), (260, 1), (260, 2)])
def test_manifest(spark, n, levels):
    """Nulls in all columns, empty texts, repeated rows and ids, one hot source beside many small ones; superblocks of 3 and 9 leaves make several rounds."""
    pick = random.Random(n + levels)
    rows = [(pick.choice([None, 1, i, i]), pick.choice([None, "", "a", "é", "hot", "hot", "hot", f"s{i}"]), pick.choice([None, "en"]), pick.choice([None, 5]), pick.choice([None, "", "a\nb", f"t{i}\n"])) for i in range(n)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit(1), "TREE": F.lit("x"), "key": F.lit(2)}).repartition(3)
    got = proved(docs, levels=levels)
    assert got == manifest(rows, tampered)
    assert not n or any(not r[6] for r in got) or n == 1


def test_manifest_of_one_source_and_very_long_text(spark):
    rows = [(i, "one", "en", 3, "x\n" * (500_000 if i == 7 else 1)) for i in range(28)]
    assert proved(spark.createDataFrame(rows, DOCS), levels=2) == manifest(rows, tampered)


# ---- Byte-level BPE ----


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(RANKS)


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_bpe.Encoder(ranks, ranks.made)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def unpacked(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_every_character_as_the_library(encoder, library):
    pack = byte_bpe.packer(encoder)
    texts = [f"a{chr(c)}{chr(c)} b1{chr(c)} {chr(c)}x" for c in [*range(0x3100), *range(0x4E00, 0x4F00), *range(0x1F600, 0x1F640), 0x10FFFF] if not 0xD800 <= c < 0xE000]
    assert not [t for t in texts if unpacked(pack(t)) != library.encode_ordinary(t)]


def test_random_pieces_as_the_library(encoder, library, ranks):
    pick, tokens = random.Random(3), list(ranks.ranks)
    for k in range(4000):
        raw = b"".join(pick.choice(tokens) for _ in range(pick.randint(1, 6))) if k % 2 else bytes(pick.choice(b"abcdeteh  ernt\xc3\xa9\xe4\xb8") for _ in range(pick.randint(1, 40)))
        if k % 7 == 0:
            raw = pick.choice(tokens) * pick.randint(1, 50)
        assert encoder.ids(raw) == library._core_bpe.encode_single_piece(raw), raw


def merged(raw, ranks):
    """Merging by its definition, with the whole piece first."""
    if raw in ranks:
        return [ranks[raw]]
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_small_vocabularies_by_definition():
    """Random ranks over three letters, many of tokens that merging never makes: going back and leaving places happens all the time."""
    pick = random.Random(11)
    for _ in range(60):
        words = {bytes([c]) for c in b"abc"}
        while len(words) < 14:
            words.add(bytes(pick.choice(b"abc") for _ in range(pick.randint(2, 5))))
        order = [*b"abc"]
        order = [bytes([c]) for c in order] + pick.sample(sorted(w for w in words if len(w) > 1), 11)
        own = byte_bpe.Ranks.__new__(byte_bpe.Ranks)
        own.ranks = {w: i for i, w in enumerate(order)}
        encoder = byte_bpe.Encoder(own, own.made)
        for _ in range(150):
            raw = bytes(pick.choice(b"abc") for _ in range(pick.randint(1, 24)))
            assert encoder.ids(raw) == merged(raw, own.ranks), (order, raw)
        with pytest.raises(ValueError, match="no sequence"):
            encoder.ids(b"abxd")


def test_long_pieces(encoder, ranks):
    """Pieces of 200,000 bytes, for which trying every place with every place before would take hours."""
    for unit in (b"ab", b" ", "中".encode(), b"aaaaab"):
        raw = unit * (200_000 // len(unit))
        ids = encoder.ids(raw)
        assert b"".join(ranks.token[i] for i in ids) == raw
        assert all(encoder.merged(ranks.token[a] + ranks.token[b]) == [a, b] for a, b in set(zip(ids, ids[1:])))


def test_remembered_pieces_and_pairs_are_let_go(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(byte_bpe, "PAIRS", 5)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 40)
    pack = byte_bpe.packer(byte_bpe.Encoder(ranks, ranks.made))
    for text in ("unlikelywords inventedhere foroneortwo testsonly", "short", "x" * 90 + " tail"):
        assert unpacked(pack(text)) == library.encode_ordinary(text)


def test_encode_and_decode(spark, library):
    texts = [None, "", "it's <|endoftext|> 'LL", "Ünïcödé 中文 \U0001f600", " \n\n\t  x", "\x00\x01", "y" * 70_000, "twice", "twice"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"ids": F.lit(1), "__value": F.lit(2)})
    rows = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS, keep=("doc_id", "ids")).orderBy("doc_id").collect()
    assert [unpacked(r.ids) for r in rows] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r.bytes).decode() for r in rows] == [t or "" for t in texts]
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == 0
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f"))], "doc_id long, ids binary"), RANKS).collect()


def test_op12_on_documents(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, sf_dir).collect()}
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(library.encode_ordinary(d.text or ""), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), h(d.text or ""))
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want


# ---- Phrases ----


def phrase_counts(rows, longest=4):
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return f, n


def best_phrases(rows, least, top):
    f, n = phrase_counts(rows)
    kept = {}
    frequent = {k: a for k, a in f.items() if a >= least}
    for (lang, w), a in frequent.items():
        if len(w) < 2:
            continue
        longer = [b for (lg, v), b in frequent.items() if lg == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        kept.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in kept.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def corpus(seed, texts):
    pick = random.Random(seed)
    words = ["The", "the", "cat", "sat", "é", "中", "on", "mat", "x\x00y", "O'Neil"] + [f"w{i}" for i in range(30)]
    marks = [" ", "  ", "\t", ". ", "\n", ",", "; ", "\x0b"]
    out = [(pick.choice(["en", "en", "en", None, "und", "de\nx"]), "".join(pick.choice(words[: pick.choice([4, 10, 40])]) + pick.choice(marks[: pick.choice([3, 8])]) for _ in range(pick.randint(0, 60)))) for _ in range(texts)]
    return [*out, ("en", None), ("en", ""), (None, " .,! "), ("en", "New York City hall " * 40), ("en", "New York City hall " * 40), ("en", "very long " * 20_000)]


@pytest.mark.parametrize("mass", [4_000_000, 300])
def test_phrases(spark, mass, monkeypatch):
    """Nulls, ties, repeated rows, NUL bytes, a language with a line feed, one phrase of half of all places; with little mass to a partition there are many partitions."""
    monkeypatch.setattr(collocations, "PARTITION_MASS", mass)
    rows = corpus(4, 150)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=5, top=40).collect())
    assert got == best_phrases(rows, 5, 40)
    assert collocations.collocations(docs.limit(0)).count() == 0
    f, n = phrase_counts(rows)
    found = {(r.lang, r.phrase): r.f for r in collocations.frequent_phrases(docs, least=5).filter("size > 0").collect()}
    assert found == {(lang, " ".join(w)): a for (lang, w), a in f.items() if a >= 5}


def test_large_counts_are_exact(spark, monkeypatch):
    """Scores beyond 64 bits: 2,000,000 times 10^13 places."""
    big = 10_000_000_000_000
    rows = [("en", 0, "", 3 * big), ("en", 1, "a", 2 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7)]
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a, **k: spark.createDataFrame(rows, "lang string, size int, phrase string, f long"))
    docs = spark.createDataFrame([], "lang string, text string")
    assert [tuple(r) for r in collocations.collocations(docs).collect()] == [("en", 1, "a b", big - 7, 2 * big, big + 1, 3 * big, 2_000_000 * (big - 7) // (3 * big + 1))]


@pytest.mark.parametrize("merged_at", [10, 10_000])
def test_summaries_keep_every_frequent_key(monkeypatch, merged_at):
    monkeypatch.setattr(collocations, "MERGED", merged_at)
    pick = np.random.default_rng(2)
    for least in (5, 30):
        parts = [np.unique(np.r_[pick.zipf(1.3, 400) % 5000, pick.integers(0, 10_000, 300)].astype(np.uint64), return_counts=True) for _ in range(12)]
        exact = Counter()
        for k, c in parts:
            exact.update(dict(zip(k.tolist(), c.tolist())))
        mass = sum(exact.values())
        capacity = mass // least + 1
        keys, counts, lowered = collocations.merge_summaries(iter([(k, c.astype(np.int64)) for k, c in parts]), capacity)
        kept = dict(zip(keys.tolist(), counts.tolist()))
        assert len(kept) <= capacity and lowered < least
        assert all(c <= exact[k] <= c + lowered for k, c in kept.items())
        assert {k for k, c in exact.items() if c >= least} <= set(kept)
