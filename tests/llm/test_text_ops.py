"""PII, licences, n-gram join, decontamination and the components against brute force, with null, empty, long, tied and repeated rows."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportmill.llm import decontaminate, license_scan, ngram_join, pii, skew, store
from reportmill.llm.components import components

DOCS = "doc_id long, text string, source string"


def frame(spark, texts, ids=None):
    rows = [(i, t, "s") for i, t in zip(ids or range(len(texts)), texts)]
    # Columns that clash with names the operators use themselves.
    return spark.createDataFrame(rows, DOCS).withColumn("TEXT_HASH", F.lit(1)).withColumn("row_hash", F.lit("x")).withColumn("n", F.lit(2.5)).withColumn("set", F.lit(None).cast("string"))


# ---- Personal data. ----

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_pattern(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_as_the_patterns():
    pick = random.Random(3)
    alphabet = ["a", "Z", "9", "1", "0", ".", ".", "@", "@", "-", "+", " ", "(", ")", "_", "%", "é", "\n", "12.34.56.78", "4111 1111 1111 1111", "+1 (212) 555-7713", "x.y@mail.example.com", "255", "0001"]
    for _ in range(4000):
        text = "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 40)))
        assert pii.base_spans(text) == base_by_pattern(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000 + " @ x@y.com", "1" * 300_000 + "@", "1." * 150_000 + "@b", "+1" * 150_000, "1 " * 150_000, "a@" * 150_000):
        pii.base_spans(run)


def test_disclosing_terms(spark):
    pick = random.Random(4)
    noise = lambda n: " ".join("w" + str(pick.randint(0, 400)) for _ in range(n))
    texts = [f"{noise(20)} Zanzibar mail boss@corp.example.com now {noise(20)}" for _ in range(8)] + [noise(60) for _ in range(300)] + [None, "", "boss@corp.example.com", "boss@corp.example.com"]
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in pii.find_disclosures(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base_by_pattern(t or "")]
        assert rows[i].base == ",".join(base) and rows[i].n_email == len(base)
        hidden = {(t or "")[x.start : x.end] for x in rows[i].terms}
        assert hidden == ({"Zanzibar", "mail", "now"} if i < 8 else set())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zanzibar" not in clean[0] and "boss@" not in clean[0] and "[EMAIL]" in clean[0]
    assert all(clean[i] == texts[i] for i in range(8, 310)) and clean[310] == "[EMAIL]"
    assert pii.find_disclosures(docs.limit(0)).count() == 0 and set(pii.sanitise(docs).columns) == set(docs.columns)


def test_copies_of_one_text_are_no_evidence(spark):
    texts = ["secret Zanzibar mail boss@corp.example.com now"] * 10 + ["nothing here"] * 50
    assert all(not r.terms for r in pii.find_disclosures(frame(spark, texts)).collect())


def test_terms_of_a_kind(spark):
    pick = random.Random(6)
    noise = lambda n: " ".join("w" + str(pick.randint(0, 400)) for _ in range(n))
    # Every address stands in one text only, so that no pair of a value and a term has support.
    texts = [f"{noise(20)} Zanzibar kontakt user{i}@corp{i}.example.com {noise(20)}" for i in range(12)] + [noise(60) for _ in range(400)]
    rows = {r.doc_id: r for r in pii.find_disclosures(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert {t[x.start : x.end] for x in rows[i].terms} == ({"Zanzibar", "kontakt"} if i < 12 else set())
        assert {x.action for x in rows[i].terms} <= {"remove"}
    # Beside an address in 12 texts of 15 and alone in 3: generalised, as 12 / 15 lies between the two shares of 12 / 415.
    more = {r.doc_id: r for r in pii.find_disclosures(frame(spark, [*texts, *["kontakt " + noise(20) for _ in range(3)]])).collect()}
    assert {(texts[0][x.start : x.end], x.action) for x in more[0].terms} == {("Zanzibar", "remove"), ("kontakt", "generalise")}


@pytest.mark.parametrize("held", [pii.FLAGGED_HELD, 0])
def test_flagged_terms_are_marked_wherever_they_stand(spark, monkeypatch, held):
    monkeypatch.setattr(pii, "FLAGGED_HELD", held)
    pick = random.Random(7)
    noise = lambda n: " ".join("w" + str(pick.randint(0, 400)) for _ in range(n))
    # Beside the address, also ten words on, behind 2,000 characters of padding, and in texts without it.
    texts = [f"é {noise(9)} Zanzibar, boss@corp.example.com {'-' * 2000} Qétaro {noise(9)} ZANZIBAR zanzibar@x.example.com" for _ in range(9)]
    texts += ["é zanzibar " + noise(30), "Zanzibar"] + [noise(60) for _ in range(300)] + [None, ""]
    docs = frame(spark, [*texts, texts[9]], [*range(len(texts)), 9])
    rows = {}
    for r in pii.find_disclosures(docs).collect():
        rows.setdefault(r.doc_id, []).append([(texts[r.doc_id] or "")[x.start : x.end] for x in r.terms])
    assert all(rows[i] == [["Zanzibar", "Qétaro", "ZANZIBAR"]] for i in range(9))
    assert rows[9] == [["zanzibar"]] * 2 and rows[10] == [["Zanzibar"]]
    assert all(rows[i] == [[]] for i in range(11, len(texts)))
    clean = pii.sanitise(docs).collect()
    assert len(clean) == len(texts) + 1 and not any("zanzibar" in (r.text or "").lower() or "Qétaro" in (r.text or "") for r in clean)


def test_terms_as_by_hand(spark):
    """Flagged terms from counts and mutual information written out."""
    pick = random.Random(11)
    pool = ["w" + str(i) for i in range(60)]
    texts = []
    for i in range(250):
        t = [pick.choice(pool) for _ in range(pick.randint(0, 40))]
        if i % 5 == 0:
            who = pick.choice(["boss@corp.example.com", "aide@corp.example.com", f"u{i}@x.example.com", "10.1.2.3"])
            near = {"boss@corp.example.com": "Zanzibar", "10.1.2.3": "Router"}.get(who, "mail") if pick.random() < 0.9 else "w1"
            at = pick.randrange(len(t) + 1)
            t[at:at] = [near, who, pick.choice(pool)]
        texts.append(" ".join(t))
    texts += ["Zanzibar w3", "x " * 60_000 + "Router 10.1.2.3"]
    docs = frame(spark, texts)
    term = lambda x: x.translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
    n, df, of, co, contexts, kinds, co_kind, low_high = len(texts), {}, {}, {}, {}, {}, {}, {}
    for t in texts:
        for w in {term(m[0]) for m in pii._TERM.finditer(t)}:
            df[w] = df.get(w, 0) + 1
        spans = pii.base_spans(t)
        values = [(k, t[a:b].lower()) for k, a, b in spans]
        for v in set(values):
            of[v] = of.get(v, 0) + 1
        for k in {k for k, _ in values}:
            kinds[k] = kinds.get(k, 0) + 1
        pairs, by_kind = {}, {}
        for j, places in pii.contexts(t, spans, pii.WINDOW):
            around = [term(t[a:b]) for a, b in places]
            for w in around:
                pairs.setdefault((values[j], w), tuple(around))
                by_kind.setdefault((values[j][0], w), set()).add(tuple(around))
        for key, c in pairs.items():
            co[key] = co.get(key, 0) + 1
            contexts.setdefault(key, set()).add(c)
        for key, c in by_kind.items():
            co_kind[key] = co_kind.get(key, 0) + 1
            low_high.setdefault(key, set()).update(c)
    action = {}

    def told(w, c, d, k, of_kind):
        pmi, content = math.log2(c * n / (d * df[w])), math.log2(n / d)
        got = "remove" if content > 0 and pmi >= pii.REMOVE * content else "generalise" if content > 0 and pmi >= pii.GENERALISE * content and (of_kind or pmi > math.log2(n / kinds[k])) else None
        if got:
            action[w] = max(action.get(w, ""), got)

    for (v, w), c in co.items():
        if c >= pii.SUPPORT and len(contexts[v, w]) >= 2:
            told(w, c, of[v], v[0], False)
    for (k, w), c in co_kind.items():
        if c >= pii.SUPPORT and len(low_high[k, w]) >= 2:
            told(w, c, kinds[k], k, True)
    assert {"zanzibar", "router"} & set(action)
    for r in pii.find_disclosures(docs).collect():
        t = texts[r.doc_id]
        covered = pii.Covered(pii.base_spans(t))
        want = [(m.start(), m.end(), action[term(m[0])]) for m in pii._TERM.finditer(t) if term(m[0]) in action and covered.free(*m.span())]
        assert [(x.start, x.end, x.action) for x in r.terms] == want


def test_sanitising_in_place_and_by_join_are_the_same(spark, monkeypatch):
    pick = random.Random(8)
    noise = lambda n: " ".join("w" + str(pick.randint(0, 300)) for _ in range(n))
    texts = [f"{noise(9)} Zanzibar, é boss@corp.example.com {noise(9)} +1 212 555 7713" for _ in range(9)] + [noise(60) for _ in range(200)] + [None, "", "Zanzibar 10.0.0.1"]
    docs = frame(spark, [*texts, texts[0]], [*range(len(texts)), 0])
    plain = sorted(((r.doc_id, r.text or "") for r in pii.sanitise(docs).collect()))
    assert "[EMAIL]" in plain[0][1] and "[PHONE]" in plain[0][1] and "Zanzibar" not in plain[0][1]
    monkeypatch.setattr(pii, "FLAGGED_HELD", 0)
    assert sorted((r.doc_id, r.text or "") for r in pii.sanitise(docs).collect()) == plain
    assert pii.sanitise(docs.limit(0)).count() == 0 and {r.doc_id for r in pii.sanitise(docs).collect() if r.text is None} == {209}


# ---- Licences. ----


def license_by_hand(text):
    words = re.findall(license_scan.WORD, (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)))
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_license_scan(spark):
    pick = random.Random(5)
    pool = ["MIT", "license", "Apache", "the", "GNU", "General", "public", "License,", "version", "3.", "x", "ÉTÉ", "mit-license", "apache  license"]
    texts = [" ".join(pick.choice(pool) for _ in range(pick.randint(0, 30))) for _ in range(200)]
    texts += [None, "", "mit", "mit license " * 3000, "Licensed under CC BY-NC 4.0.", "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"]
    texts += ["MIT license"] * 2
    ids = [*range(len(texts) - 1), len(texts) - 2]
    rows = license_scan.scan_licenses(frame(spark, texts, ids)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    by_id = {r.doc_id: r for r in rows}
    for i, t in zip(ids, texts):
        n, places = license_by_hand(t)
        r = by_id[i]
        assert (r.n_words, r.n_base) == (n, len(places)), t
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by_id[204].labels == "cc-by-nc-4.0" and "mit" in by_id[205].labels.split(",")
    assert license_scan.scan_licenses(frame(spark, texts).limit(0)).count() == 0


# ---- Near duplicates. ----


def sets_by_hand(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_by_hand(texts, k, least, per, ids):
    s = [sets_by_hand(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if s[i] and s[j] and per * len(s[i] & s[j]) >= least * len(s[i] | s[j]):
            root[find(j)] = find(i)
    smallest = {}
    for i in range(len(texts)):
        smallest[find(i)] = min(smallest.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(s[i]), smallest[find(i)]) for i in range(len(texts))]


def near_copies(seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 4)))
    texts = []
    for size in (1, 2, 3, 5, 9, 12, 14, 20, 30, 45, 80, 150, 400):
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(pick.choice(texts[-6:]).split(" "))
            for _ in range(pick.randint(0, max(1, len(copy) // 15))):
                at = pick.randrange(len(copy))
                copy[at : at + pick.randint(0, 1)] = [word()] * pick.randint(0, 2)
            texts.append(" ".join(copy) or "x")
    return texts + [None, "", " \n", "ONE Two three", "one two\tTHREE"]


@pytest.mark.parametrize("k,least,per,seed", [(3, 90, 100, 1), (3, 90, 100, 2), (5, 80, 100, 3), (3, 60, 100, 4)])
def test_ngram_components_as_by_hand(spark, k, least, per, seed):
    texts = near_copies(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    got = ngram_join.ngram_components(frame(spark, texts, ids), k=k, least=least, per=per).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components_by_hand(texts, k, least, per, ids))


@pytest.mark.parametrize("k,least,per,seed", [(3, 90, 100, 5), (5, 80, 100, 6)])
def test_large_buckets_and_frequent_keys_as_by_hand(spark, monkeypatch, k, least, per, seed):
    """With every bucket split by prefixes in blocks of three rows, and every key that occurs twice a frequent one."""
    for module, name, value in ((ngram_join, "BUCKET_PAIRS", 0), (ngram_join, "BLOCK_ROWS", 3), (ngram_join, "HINT", 1), (ngram_join, "HINT_ROWS", 2), (skew, "HOT_ROWS", 2), (skew, "HOT_KEYS", 40)):
        monkeypatch.setattr(module, name, value)
    texts = near_copies(seed) + ["a b c d e f g h i j k l m " + w for w in "n o p q r s t u v".split()] + ["same text as itself today"] * 9
    ids = random.Random(seed).sample(range(1000), len(texts))
    got = ngram_join.ngram_components(frame(spark, texts, ids), k=k, least=least, per=per).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components_by_hand(texts, k, least, per, ids))


def test_parts_that_both_lack_a_shingle_are_no_candidates():
    """Texts of a template and one word of their own: no signature of a whole part is shared, so no pair is formed."""
    from reportmill.llm.bytewords import signed

    def of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        s = ngram_join.shingle_sets(data, np.array([0, len(data)]), 3)[0]
        own, whole = ngram_join.signatures(s, ngram_join.band_of(len(s), 90, 100), 90, 100)
        return set(signed(own[:whole]).tolist()), set(signed(own).tolist())

    (w1, s1), (w2, s2) = (of("one two three four five six seven eight nine ten eleven twelve thirteen " + x) for x in ("alpha", "beta"))
    assert s1 & s2 and not w1 & s2 and not w2 & s1


def test_keep_one(spark):
    texts = near_copies(7) + ["same text as itself", "same text as itself", None]
    ids = [*range(len(texts) - 3), 5000, 5000, 6000]
    kept = ngram_join.keep_one(frame(spark, texts, ids), k=3, least=90).collect()
    want = components_by_hand(texts, 3, 90, 100, ids)
    empty = [i for i, n, _ in want if n == 0]
    assert sorted(r.doc_id for r in kept) == sorted({c for _, n, c in want if n} | set(empty))
    no_id = ngram_join.ngram_components(frame(spark, ["a b c d"] * 2, [None, None])).collect()
    assert [r.component_id for r in no_id] == [None, None]
    assert ngram_join.keep_one(frame(spark, ["a b c d"] * 2, [None, None])).count() == 1
    assert ngram_join.ngram_components(frame(spark, ["a"]).limit(0)).count() == 0 and ngram_join.keep_one(frame(spark, ["a"]).limit(0)).count() == 0


def test_bands_cover_every_pair_that_may_link():
    for least in (60, 80, 90, 95):
        for n in range(1, 400):
            i = ngram_join.band_of(n, least, 100)
            lo, hi, d, e, spare = ngram_join.band(i, least, 100)
            assert lo <= n <= hi
            differ = (100 - least) * 2 * hi // (100 + least)
            assert not differ or e + 2 * d >= differ + 1 + (spare if e else 0)


def test_components(spark):
    pick = random.Random(8)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(1000, x) for x in range(1001, 1100)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    rows = spark.createDataFrame([*edges, (7, None)], "a long, b long")
    got = {r.node: r.root for r in components(rows).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(rows.limit(0)).count() == 0


# ---- Decontamination. ----


def bm25_by_hand(passages, items, k1=decontaminate.K1, b=decontaminate.B):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)))
    w = [words(t) for t in items]
    mean = sum(map(len, w)) / len(w)
    df = {t: sum(t in x for x in w) for x in w for t in x}
    weight = [{t: math.log1p((len(w) - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * (k1 + 1) / (x.count(t) + k1 * (1 - b + b * len(x) / mean)) for t in set(x)} for x in w]
    return [[sum(v for t, v in u.items() if t in set(words(p))) / sum(u.values()) for u in weight] for p in passages]


def contaminated(seed):
    pick = random.Random(seed)
    pool = [f"v{i}" for i in range(150)] + ["the"] * 30 + ["of"] * 20
    text = lambda n: " ".join(pick.choice(pool) for _ in range(n))
    items = [text(pick.randint(6, 30)) + ". " + text(pick.randint(2, 6)) for _ in range(40)] + ["Q only.", "", None, "Why. " + text(20)]
    docs = [text(pick.randint(0, 200)) for _ in range(60)]
    for i in range(20):
        words = items[i].split()
        for _ in range(len(words) // 12):
            words[pick.randrange(len(words))] = "changed"
        docs.append(text(pick.randint(0, 150)) + " " + " ".join(words).upper() + " " + text(pick.randint(0, 60)))
    return items, docs + [None, "", items[0], items[0], text(40) + " " + items[43]]


def test_retrieval_finds_every_item_above_the_threshold(spark):
    items, docs = contaminated(1)
    kept = [x for x in items if x]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    (index,) = decontaminate.build_indexes(table, threshold=0.3)
    for d in docs:
        words = (d or "").split()
        windows = [" ".join(words[i : i + 2 * index.stride]) for i in range(0, max(1, len(words)), index.stride)]
        data = (d or "").encode()
        w = decontaminate.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), decontaminate.WORD_CHARS)
        found = {(win, i) for _, i, win, *_ in index.hits(w, 0.3, 0.0, 0.0)}
        want = {(n * index.stride, i) for n, row in enumerate(bm25_by_hand(windows, kept)) for i, s in enumerate(row) if s >= 0.3 + 1e-6}
        assert want <= found


def test_decontamination(spark, monkeypatch):
    items, docs = contaminated(2)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = frame(spark, docs)
    hits = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(rows, table).collect()}
    assert {(60 + i, i) for i in range(20)} <= hits and not any(d < 60 for d, _ in hits)
    assert (84, 43) in hits
    assert {d for d, _ in hits} >= {82, 83} and not {80, 81} & {d for d, _ in hits}
    left = {r.doc_id for r in decontaminate.drop_contaminated(rows, table).collect()}
    assert left == set(range(len(docs))) - {d for d, _ in hits}
    assert decontaminate.find_contamination(rows, table.limit(0)).count() == 0 and decontaminate.find_contamination(rows.limit(0), table).count() == 0
    assert decontaminate.drop_contaminated(rows, table.limit(0)).count() == len(docs)
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 10)
    monkeypatch.setattr(decontaminate, "HELD_SHARDS", 3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(rows, table).collect()} == hits
    assert {r.doc_id for r in decontaminate.drop_contaminated(rows, table).collect()} == left


def test_decontamination_output_as_by_hand(spark):
    """Best passage, score and both overlaps of every hit, from words and BM25 written out."""
    items, docs = contaminated(3)
    docs.append("pad " * 100_000 + items[5])
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = [(i, x) for i, x in enumerate(items) if x]
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    stride = max(16, max(len(words(x)) for _, x in kept))
    shingles = lambda w, k: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
    want = {}
    for d, doc in enumerate(docs):
        w = words(doc or "")
        windows = [w[a : a + 2 * stride] for a in range(0, max(1, len(w)), stride)]
        if d == len(docs) - 1:
            windows = [x if set(x) != {"pad"} else [] for x in windows]
        for n, scores in enumerate(bm25_by_hand([" ".join(x) for x in windows], [x for _, x in kept])):
            for (i, item), score in zip(kept, scores):
                if score < decontaminate.THRESHOLD - 1e-9:
                    continue
                q, a = (words(x) for x in decontaminate.split_item(item.lower()))
                if not q or not a:
                    q = a = words(item)
                k = min(3, len(q))
                own = shingles(windows[n], k)
                qs = shingles(q, k)
                over = (len(qs & own) / len(qs), len(set(a) & set(windows[n])) / len(set(a)))
                if over[0] >= decontaminate.QUESTION and over[1] >= decontaminate.ANSWER:
                    want[d, i] = max(want.get((d, i), (0, 0)), (round(min(score, 1.0), 9), -n * stride, *(round(x, 9) for x in over)))
    got = {(r.doc_id, r.item_id): (round(r.score, 9), -r.first_word, round(r.question_overlap, 9), round(r.answer_overlap, 9)) for r in decontaminate.find_contamination(frame(spark, docs), table).collect()}
    assert set(got) == set(want) and (len(docs) - 1, 5) in got
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-7), k


def test_planted_terms_are_found_by_how_much_they_reveal(spark):
    """3,000 texts, a tenth with a mail address each. Terms that stand beside one in all, nine or seven tenths of their texts are flagged, those of four tenths or at random aren't."""
    pick = random.Random(21)
    rare = lambda: f"r{pick.randint(0, 9000)}"
    noise = lambda n: [rare() if pick.random() < 0.2 else f"w{pick.randint(0, 300)}" for _ in range(n)]
    texts = [noise(40) for _ in range(3000)]
    mailed = pick.sample(range(3000), 300)
    for i in mailed:
        texts[i][20] = f"m{i}@corp{i}.example.com"
    plain = sorted(set(range(3000)) - set(mailed))
    planted = {}
    for share in (10, 9, 7, 4, 0):
        for j in range(12):
            term = f"planted{share}x{j}"
            planted[term] = share
            for i in pick.sample(mailed, share):
                texts[i][pick.choice((17, 18, 19, 21, 22, 23))] = term
            for i in pick.sample(plain, 10 - share):
                texts[i][pick.randrange(40)] = term
    docs = frame(spark, [" ".join(t) for t in texts])
    flagged = {}
    for r in pii.find_disclosures(docs).collect():
        for x in r.terms:
            flagged.setdefault(" ".join(texts[r.doc_id])[x.start : x.end], set()).add(x.action)
    # Planted terms lose places to one another, so a term's real share is counted.
    beside, df = Counter(), Counter()
    for i, t in enumerate(texts):
        df.update(set(t))
        if "@" in t[20]:
            beside.update({*t[14:20], *t[21:27]})
    telling = {w for w in planted if beside[w] / df[w] >= 0.66}
    silent = {w for w in planted if beside[w] / df[w] <= 0.6}
    assert telling <= set(flagged) and not silent & set(flagged) and len(telling) > 30 and len(silent) >= 24
    # Of what is flagged, nearly all is planted or stands beside addresses as often by chance (three texts at least).
    right = [w for w in flagged if beside[w] >= pii.SUPPORT and beside[w] / df[w] >= 0.6]
    assert len(right) / len(flagged) > 0.99 and len(set(flagged) & set(planted)) / len(flagged) > 0.8


def test_the_joins_texts_are_not_kept(spark):
    """Texts laid beside pairs are deleted when the pairs are compared; the result doesn't need them."""
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base[:30], f"own{i}", *base[30:]] if i else base)) for i in range(6)], "doc_id long, text string")
    shared = store.shared_dir(spark).removeprefix("file://")
    left = lambda: {p.name for p in Path(shared).glob("*") if p.name.split("-")[0] in ("texts", "half")}
    before = left()
    out = ngram_join.ngram_components(docs, least=80)
    assert left() == before
    assert {r.component_id for r in out.collect()} == {0}


def long_pairs(n):
    """A batch of n pairs of texts of 2,000 words; every second pair links at 80 of 100 with five-word shingles, the others differ in every fifth word."""
    pick = random.Random(n)
    rows = []
    for i in range(n):
        x = [f"w{pick.randrange(3000)}" for _ in range(2000)]
        y = ["other" if j % (5 if i % 2 else 400) == 2 else w for j, w in enumerate(x)]
        rows.append((b"a%d" % i, b"b%d" % i, " ".join(x), " ".join(y)))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["a", "b", "w_a", "w_b"])


def test_comparing_pairs_takes_no_memory_for_all_texts_of_a_batch():
    """Sets of shingles are held for a block of bytes: four times the pairs in a batch take no more memory, and the same pairs link."""
    peaks = []
    for n in (100, 400):
        batch = long_pairs(n)
        tracemalloc.start()
        got = [x for out in ngram_join.linking(iter([batch]), 5, 80, 100) for x in out.column(0).to_pylist()]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert got == [b"a%d" % i for i in range(0, n, 2)]
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 24e6


@pytest.mark.parametrize("k,least", [(1, 50), (3, 90), (5, 80)])
def test_pairs_link_as_by_hand(k, least):
    texts = [" ".join(t.lower().split()) for t in near_copies(11) if t and t.strip()]
    pairs = [(x, y) for i, x in enumerate(texts) for y in texts[i + 1 : i + 9]]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(len(pairs))])] * 2 + [pa.array(c) for c in zip(*pairs, strict=True)], ["a", "b", "w_a", "w_b"])
    got = [int(x) for out in ngram_join.linking(iter([batch, batch.slice(0, 0)]), k, least, 100) for x in out.column(0).to_pylist()]
    sets = [[sets_by_hand(t, k) for t in pair] for pair in pairs]
    assert got == [i for i, (s, t) in enumerate(sets) if 100 * len(s & t) >= least * len(s | t)] and got


def test_batches_for_python_are_bounded_in_bytes(spark):
    """Rows of long texts come in batches of about BATCH_BYTES; a limit that the session has stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    sizes = lambda: [r.b for r in spark.range(0, 300, 1, 1).selectExpr("repeat('word ', 10000) as text").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["b"]) for b in bs), "b long").collect()]
    try:
        spark.conf.unset(limit)
        ngram_join.keep_one(frame(spark, ["a b c", "d e f"]))
        assert len(sizes()) > 2 and max(sizes()) < 2 * store.BATCH_BYTES
        spark.conf.set(limit, str(64 << 20))
        store.small_batches(spark)
        assert len(sizes()) == 1
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
