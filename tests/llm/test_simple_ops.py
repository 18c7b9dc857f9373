"""Token counts, mixing and WARC against the library, the formula and an exact round trip."""

import gzip
import hashlib
import math
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reportmill.llm import mixing, token_counts, warc
from reportmill.llm.mixing import mix_sources
from reportmill.llm.store import new_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def odd_texts():
    pick = random.Random(5)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x600, 0x660), 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x2460, 0xBD, 0x1C, 0x1D, 0x1E, 0x1F]]
    texts = ["".join(pick.choice(pool) for _ in range(pick.randint(0, 60))) for _ in range(400)]
    return [*texts, "", " ", "  a  b\n\n c", "it's they'LL 'tis I'm", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "x" * 5000, " " * 3000, "1234567890" * 30]


def test_every_character_as_the_library(library):
    count = token_counts.counter(token_counts.Vocabulary(VOCABULARY))
    texts = [f"a{chr(c)}{chr(c)} b" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if len(e.ids) != count(t)]
    assert not wrong


def test_token_counts(spark, library):
    texts = [*odd_texts(), None, "twice", "twice"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS).withColumn("n_tokens_", F.lit(1))
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, VOCABULARY).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 1024)
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_long_texts_are_read_piecewise(library, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_TEXT", 10)
    count = token_counts.counter(token_counts.Vocabulary(VOCABULARY))
    text = "some longer text, with 12 words and \n\n blanks"
    assert count(text) == len(library.encode(text).ids)


def expected_copies(seed, row_key, mean):
    parts = math.ceil(mean / 400)
    total = 0
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{row_key}|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        m = mean / parts
        p = c = math.exp(-m)
        k = 0
        while c <= u:
            k += 1
            p *= m / k
            c += p
        total += k
    return total


def test_mixing_counts_by_formula(spark):
    rows = [(i, f"t{i}", ("hot" if i % 3 else "b") if i % 10 else None) for i in range(300)] + [(None, "no id", "b"), (7, "t7", "hot")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mean", F.lit("x")).withColumn("COPY", F.lit("y"))
    targets = spark.createDataFrame([("hot", 1.0), ("b", 3.0), ("nowhere", 5.0), (None, 1.0)], "s string, w double")
    got = Counter((r.doc_id, r.text) for r in mix_sources(docs, targets, size=2000, seed="s").collect())
    n = Counter(r[2] for r in rows)
    want = Counter()
    for i, t, s in rows:
        key = hashlib.md5(t.encode()).hexdigest() if i is None else str(i)
        want[(i, t)] += expected_copies("s", key, 2000 * {"hot": 1, "b": 3, None: 1}[s] / 5 / n[s])
    assert got == +want
    assert "mean" in mix_sources(docs, targets).columns


def test_mixing_reaches_targets_and_large_means(spark):
    docs = spark.createDataFrame([(i, "t", "a" if i < 1900 else "b") for i in range(2000)], DOCS)
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "s string, w double")
    got = mix_sources(docs, targets, size=200_000).groupBy("source").count().collect()
    assert all(abs(r["count"] - 100_000) < 1500 for r in got)
    assert mix_sources(docs.limit(0), targets).count() == 0
    assert mix_sources(docs.limit(0)).count() == 0


def test_mixing_is_the_same_with_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "" if i % 50 == 1 else "x" * 100_000 if i == 7 else None if i == 8 else "t", f"s{i % 9}" if i % 3 else "hot" if i % 2 else None) for i in range(500)], DOCS).withColumn("salt", F.lit(1))
    told = lambda: sorted((r.doc_id, r.copy, r.salt) for r in mix_sources(docs, size=1500).collect())
    want = told()
    assert len({i for i, _, _ in want}) > 300
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert told() == want
    monkeypatch.setattr(mixing, "BROADCAST_RATES", 1)
    assert told() == want


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    long, umlauts = "ab\r\n\r\n" * 20_000, "äöü€😀" * 9_000
    rows = [(1, "http://a/ b\n", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", umlauts), (9, "u", umlauts), (9, "u", umlauts), (None, "u", "z" * 2000), (11, "u", "WARC/1.1\r\n" * 200)]
    got = warc.pages_through_warc(pages_frame(spark, rows).withColumn("record", F.lit(1)).withColumn("digest", F.lit(2))).collect()
    assert len(got) == len(rows) and all(r.whole for r in got)
    for r in got:
        payload = next(h or "" for p, _, h in rows if p == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [(0, "response", 0), (1, "revisit", 2), (2, "response", 0), (3, "response", 0), (4, "response", 0), (5, "response", 0), (6, "revisit", 9), (9, "response", 0), (9, "revisit", 9), (11, "response", 0)]
    assert warc.pages_through_warc(pages_frame(spark, [])).count() == 0


def test_missing_segments_show(spark):
    parts = list(warc.records(1, "u", b"x" * 100_000, 100_000, hashlib.sha1(b"x" * 100_000).hexdigest(), 5, None, None))
    assert len(parts) > 3
    for k, kept in enumerate(([parts[0], *parts[2:]], parts[:-1], parts[::-1])):
        path = new_path(spark, "broken")
        spark.createDataFrame([(gzip.compress("".join(p + warc.RECORD_END for p in kept).encode()),)], "b binary")
        spark.createDataFrame([(p,) for p in kept], "value string").coalesce(1).write.option("lineSep", warc.RECORD_END).option("compression", "gzip").text(path)
        (row,) = warc.read_archives(spark, path).collect()
        assert row.whole is (k == 2) and row.page_id == 1
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_broken_archives_give_what_is_whole(spark, tmp_path):
    digest = lambda p: hashlib.sha1(p).hexdigest()
    one, two = (b"a" * 50, b"b" * 3000)
    records = [*warc.records(1, "u", one, 50, digest(one), 1, None, None), *warc.records(2, "u", None, 50, digest(one), 2, 1, 1), *warc.records(3, "u", None, 50, digest(two), 3, 1, 1), *warc.records(4, "u", None, 50, digest(one), 4, 9, 99), *warc.records(5, "u", two, 3000, digest(two), 5, None, None, segment=32 << 10)]
    archive = "".join(r + warc.RECORD_END for r in records).encode()
    whole = gzip.compress(archive)
    cases = {"whole": whole, "cut": whole[:-30], "short": gzip.compress(archive[:-200]), "not": b"no gzip file", "framing": gzip.compress(archive.replace(b"32\r\n" + one, b"31\r\n" + one))}
    got = {}
    for name, content in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.gz").write_bytes(content)
        got[name] = {(r.page_id, r.record_type): r for r in warc.read_archives(spark, str(tmp_path / name)).collect()}
    rows = got["whole"]
    assert sorted(p for p, _ in rows) == [1, 2, 3, 4, 5] and [rows[p, t].whole for p, t in ((1, "response"), (2, "revisit"), (5, "response"))] == [True] * 3
    # A revisit is held against the record it refers to: another digest, or no such record, isn't whole.
    assert rows[2, "revisit"].payload_digest == digest(one) and not rows[3, "revisit"].whole and not rows[4, "revisit"].whole and rows[4, "revisit"].payload_bytes is None
    assert sorted(got["not"]) == [(None, "broken")] and not got["not"][None, "broken"].whole
    for name in ("cut", "short"):
        assert (None, "broken") in got[name] and (1, "response") in got[name] and (5, "response") not in got[name]
    # A record whose last segment is lost is told, but isn't whole.
    parts = [*warc.records(6, "u", two, 3000, digest(two), 6, None, None), *warc.records(7, "u", one, 50, digest(one), 7, None, None)]
    assert len(parts) == 3
    (tmp_path / "lost").mkdir()
    (tmp_path / "lost" / "a.gz").write_bytes(gzip.compress("".join(r + warc.RECORD_END for r in (parts[0], parts[2])).encode()))
    lost = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "lost")).collect()}
    assert sorted(lost) == [6, 7] and not lost[6].whole and lost[7].whole
    assert not got["framing"][1, "response"].whole and got["framing"][5, "response"].whole and not got["framing"][2, "revisit"].whole


def test_shared_folder(spark):
    from reportmill.llm import store

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        store.shared_dir(Cluster)
    assert store.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    df = store.written(spark.range(3).toDF("x"), "x")
    assert df.count() == 3
    store.clear(spark)
    import os

    assert not os.path.exists(store.shared_dir(spark).removeprefix("file://"))
