"""Sanitising of personal data, and of terms that give it away.

Base: e-mail addresses, IP addresses, card and telephone numbers of every whole text, leftmost and without overlap for
each kind. Each value is a protected entity.

Method: the corpus tells how much a term that stands near an entity reveals of it. With N texts, df(e) and df(t) texts
with the entity and the term, and co(t, e) texts that have t within `window` words of e, the pointwise mutual
information log2(co * N / (df(t) * df(e))) is held against the entity's information content log2(N / df(e)), which is
the most that any term can reveal, and against that of its kind log2(N / df(kind)). A term that reveals at least `remove`
of the former is removed; one that reveals at least `generalise` of it, and more than the kind does, is replaced by its
shape. Pairs need `support` texts and two different contexts, so that copies of one text are no evidence.

Most values stand in one text only, where no such pair can be had. So the same is held for the kind of entity: with
co(t, kind) texts that have t within `window` words of any entity of the kind, log2(co * N / (df(t) * df(kind))) is held
against log2(N / df(kind)) with the same two shares.

A flagged term takes the strongest action that any entity or kind gives it, and is marked wherever it stands outside
entities, in all texts, as the counts are over all texts too.

Counts are aggregates over all texts, entities and terms are shuffled as 64-bit hashes. Of the flagged terms a bitmap of
1 << BITS bits is sent out, by which a pass over the texts finds the places that may be theirs; these are joined with the
terms themselves, which are broadcast up to FLAGGED_HELD and shuffled in SALTS salts beyond.

Null text is empty. Rows with equal id and text are counted once in the statistics and all given back. An empty table
gives an empty result. Of the input only the named columns are read; sanitise() keeps the others as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import WORD_CHARS, blocks, signed, words
from .store import fresh, written

KINDS = ("email", "ip", "card", "phone")
WINDOW = 6
SUPPORT = 3
REMOVE = 0.95
GENERALISE = 0.8
#: Bits of the bitmap of flagged terms, as a power of two.
BITS = 26
#: Flagged terms that are broadcast; more are shuffled, each to so many salts.
FLAGGED_HELD = 500_000
SALTS = 32
#: Distinct terms that a worker counts before it hands its counts on.
TERMS_HELD = 1_500_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, @ and a dotted domain; each @ is looked at once, so that long runs of letters cost no more than their length."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL_END.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted parts, taken in turn from each run of parts; matches with a part over 255 are dropped."""
    for m in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0]) <= 255 for p in four):
                yield four[0].start(), four[3].end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_PART.findall(s))


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end) by kind and start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if _PART.search(text):
        out += [(1, a, b) for a, b in ips(text)]
        out += [(2, a, b) for a, b in cards(text)]
        if "+" in text:
            out += [(3, a, b) for a, b in phones(text)]
    return out


class Covered:
    """Which places of a text lie outside all its spans."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted((a, b) for _, a, b in spans):  # joined where they overlap
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, b - 1)
        return i == 0 or self.ends[i - 1] <= a


def contexts(text: str, spans: list[tuple[int, int, int]], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each span the places of the words around it, outside all spans, of at least three characters; however far off the words are."""
    covered = Covered(spans)
    found = [m.span() for m in _TERM.finditer(text)]
    starts, ends = [a for a, _ in found], [b for _, b in found]
    out = []
    for n, (_, a, b) in enumerate(spans):
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        around = found[max(0, before - window) : before] + found[after : after + window]
        out.append((n, [s for s in around if s[1] - s[0] >= 3 and covered.free(*s)]))
    return out


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, entities array<struct<entity:long,kind:int>>, near array<struct<entity:long,kind:int,term:long,context:long>>, by_kind array<struct<kind:int,term:long,low:long,high:long>>"


def find_entities(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """doc_id, text_hash and _FOUND of every row of docs."""
    kept = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text_hash long, {_FOUND}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        near_type = pa.list_(pa.struct([("entity", pa.int64()), ("kind", pa.int32()), ("term", pa.int64()), ("context", pa.int64())]))
        entity_type = pa.list_(pa.struct([("entity", pa.int64()), ("kind", pa.int32())]))
        by_kind_type = pa.list_(pa.struct([("kind", pa.int32()), ("term", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))
        as_long = lambda s: int.from_bytes(xxhash.xxh64_digest(s.encode()), "big", signed=True)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base, entities, near, by_kind, wanted = [], [], [], [], []
            for t in batch.column(2):
                t = t.as_py()
                spans = base_spans(t)
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in spans))
                base.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans))
                ids = [(as_long(f"{KINDS[k]}:{t[a:b].lower() if k == 0 else t[a:b] if k == 1 else _digits(t[a:b])}"), k) for k, a, b in spans]
                entities.append([{"entity": e, "kind": k} for e, k in dict.fromkeys(ids)])
                pairs: dict[tuple, dict] = {}
                kinds: dict[tuple, dict] = {}  # least and largest context of each kind's terms
                for n, places in contexts(t, spans, window) if spans else ():
                    around = [t[a:b].translate(_ASCII_LOWER) for a, b in places]
                    context = as_long(" ".join(around))
                    for term in around:
                        if (ids[n], term) not in pairs:
                            pairs[ids[n], term] = {"entity": ids[n][0], "kind": ids[n][1], "term": len(wanted), "context": context}
                            wanted.append(term)
                        x = pairs[ids[n], term]
                        y = kinds.setdefault((ids[n][1], term), {"kind": ids[n][1], "term": x["term"], "low": context, "high": context})
                        y["low"], y["high"] = min(y["low"], context), max(y["high"], context)
                near.append(list(pairs.values()))
                by_kind.append(list(kinds.values()))
            terms = term_hashes(wanted)
            for row in [*near, *by_kind]:
                for x in row:
                    x["term"] = terms[x["term"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(entities, entity_type), pa.array(near, near_type), pa.array(by_kind, by_kind_type)], ["doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base", "entities", "near", "by_kind"])

    return kept.mapInArrow(run, schema)


def term_hashes(terms: list[str]) -> list[int]:
    """Hashes of terms as term_counts() has them."""
    data = "\n".join(terms).encode()
    return signed(words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), WORD_CHARS).hash).tolist() if terms else []


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """term (its hash) and df, in how many rows it stands, of all terms of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
            return h[first], (np.add.reduceat(n, first) if len(h) else n)

        for batch in batches:
            for _, _, data, at in blocks(batch, "text"):
                w = words(data, at, WORD_CHARS)
                order = np.lexsort((w.rows(), w.hash))
                h, r = w.hash[order], w.rows()[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
                h = h[new]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
                held.append((h[first], np.diff(np.r_[first, len(h)])))
                if sum(len(x) for x, _ in held) > TERMS_HELD:
                    held = [merged()]
                    if len(held[0][0]) > TERMS_HELD // 2:
                        yield from out(held.pop())
        if held:
            yield from out(merged())

    def out(x: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(x[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(signed(x[0][lo : lo + 50_000])), pa.array(x[1][lo : lo + 50_000].astype(np.int64))], ["term", "n"])

    return docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def find_disclosures(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """doc_id, text_hash, n_email ... n_phone, base (spans as kind:start:end) and terms (array of start, end, action) of every row."""
    found = written(find_entities(docs, key, text, window), "entities")
    spans = marked(docs, key, text, flagged_terms(docs, found, text, **how)).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    joined = found.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    return joined.select("doc_id", "text_hash", *[f"n_{k}" for k in KINDS], "base", F.coalesce("terms", F.array().cast("array<struct<start:long,end:long,action:string>>")).alias("terms"))


def flagged_terms(docs: DataFrame, found: DataFrame, text: str, support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """term (its hash) and action of the terms that disclose too much; found: the written table of find_entities()."""
    once = found.filter(F.size("entities") > 0).dropDuplicates(["doc_id", "text_hash"])
    total = found.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(f"n_{k}") > 0, 1)).alias(k) for k in KINDS]).first()
    n = float(max(total["n"], 1))
    by_context = once.select(F.explode("near").alias("x")).groupBy("x.entity", "x.kind", "x.term", "x.context").agg(F.count(F.lit(1)).alias("c"))
    pairs = by_context.groupBy("entity", "kind", "term").agg(F.sum("c").alias("co"), F.count(F.lit(1)).alias("contexts")).filter((F.col("co") >= support) & (F.col("contexts") >= 2))
    entities = once.select(F.explode("entities").alias("x")).groupBy("x.entity").agg(F.count(F.lit(1)).alias("df_entity"))
    valued = pairs.join(entities, "entity").select("term", "kind", "co", F.col("df_entity").alias("df_of"), F.lit(False).alias("of_kind"))
    kinds = once.select(F.explode("by_kind").alias("x")).groupBy("x.kind", "x.term").agg(F.count(F.lit(1)).alias("co"), (F.min("x.low") != F.max("x.high")).alias("varied")).filter((F.col("co") >= support) & F.col("varied"))
    df_kind = F.element_at(F.array(*[F.lit(max(total[k], 1)).cast("long") for k in KINDS]), F.col("kind") + 1)
    scored = valued.unionByName(kinds.select("term", "kind", "co", df_kind.alias("df_of"), F.lit(True).alias("of_kind"))).join(term_counts(docs, text), "term")
    pmi = F.log2(F.col("co") * F.lit(n) / (F.col("df_of") * F.col("df")))
    content = F.log2(F.lit(n) / F.col("df_of"))
    enough = F.col("of_kind") | (pmi > F.log2(F.lit(n) / df_kind))
    action = F.when((content > 0) & (pmi >= remove * content), "remove").when((content > 0) & (pmi >= generalise * content) & enough, "generalise")
    strongest = scored.select("term", action.alias("action")).filter(F.col("action").isNotNull()).groupBy("term").agg(F.max("action").alias("action"))  # "remove" is the larger
    return written(strongest, "flagged-terms")


def bitmap(flagged: DataFrame) -> np.ndarray:
    """1 << BITS bits, of which those named by the highest BITS bits of a flagged term are set."""
    at = F.shiftrightunsigned("term", 64 - BITS)
    bits = flagged.groupBy(F.shiftright(at, 3).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(term, {64 - BITS}) & 7 as int))")).alias("bits")).toArrow()  # at most 1 << (BITS - 3) rows of 12 bytes
    out = np.zeros(1 << (BITS - 3), np.uint8)
    out[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint8)
    return out


def marked(docs: DataFrame, key: str, text: str, flagged: DataFrame) -> DataFrame:
    """doc_id, text_hash and terms (array of start, end, action) of the texts in which flagged terms (term, action) stand outside entities; once for repeated rows."""
    n = flagged.count()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(flagged))
    kept = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"))
    place = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for lo, hi, data, at in blocks(batch, "text"):
                w = words(data, at, WORD_CHARS)
                high = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
                hits = np.flatnonzero(bits[high >> 3] >> (high & 7).astype(np.uint8) & 1)
                if not len(hits):
                    continue
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters before each byte
                row = np.searchsorted(w.row_start, hits, "right") - 1
                first = chars[at[row]]
                start, end, term = (chars[w.start[hits]] - first).tolist(), (chars[w.end[hits]] - first).tolist(), signed(w.hash[hits]).tolist()
                cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]).tolist()
                rows, found = [], []
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    r = lo + int(row[x])
                    covered = Covered(base_spans(batch.column(2)[r].as_py()))
                    own = [{"term": term[i], "start": start[i], "end": end[i]} for i in range(x, y) if covered.free(start[i], end[i])]
                    if own:
                        rows.append(r)
                        found.append(own)
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(found, place)], ["doc_id", "text_hash", "places"])

    places = kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text_hash long, places array<struct<term:long,start:long,end:long>>")
    places = places.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("places").alias("p")).select("doc_id", "text_hash", "p.*")
    if n <= FLAGGED_HELD:
        joined = places.join(F.broadcast(flagged), "term")
    else:
        salted = flagged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = places.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    return joined.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))


def replaced(text: str, base: str, terms: list) -> str:
    """text with entities as [EMAIL], [IP], [CARD], [PHONE], generalised terms as their shape and removed ones left out. Where spans overlap, the one that begins first, then the longer, stays."""
    spans = [(int(a), -int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in base.split(",") if x)]
    for x in terms:
        term = text[x["start"] : x["end"]]
        shape = "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[TERM]"
        spans.append((x["start"], -x["end"], "" if x["action"] == "remove" else shape))
    out, at = [], 0
    for a, b, word in sorted(spans):
        if a >= at:
            out += [text[at:a], word]
            at = -b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """docs with their texts sanitised; texts with nothing to hide stay as they are, null stays null.

    The texts are rewritten where they are read: the flagged terms are sent out, and no text is shuffled. Only with more than
    FLAGGED_HELD flagged terms the places are joined to the texts that have some.
    """
    found = written(find_entities(docs, key, text, window), "entities")
    flagged = flagged_terms(docs, found, text, **how)
    if flagged.count() > FLAGGED_HELD:
        return _sanitise_by_join(docs, key, text, found, flagged)
    actions = flagged.toArrow()  # FLAGGED_HELD rows of a long and a word at most
    order = np.argsort(actions.column("term").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((actions.column("term").to_numpy()[order], np.array(actions.column("action").to_pylist(), object)[order]))
    at_text, columns = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, action = shared.value
        for batch in batches:
            out = []
            for lo, hi, data, at in blocks(batch, text):
                places: dict[int, list[tuple[int, int, str]]] = {}
                if len(terms):
                    w = words(data, at, WORD_CHARS)
                    h = signed(w.hash)
                    i = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                    hits = np.flatnonzero(terms[i] == h)
                    if len(hits):
                        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                        row = np.searchsorted(w.row_start, hits, "right") - 1
                        for x, r in zip(hits.tolist(), row.tolist(), strict=True):
                            first = chars[at[r]]
                            places.setdefault(r, []).append((int(chars[w.start[x]] - first), int(chars[w.end[x]] - first), action[i[x]]))
                for r, t in enumerate(batch.column(at_text).slice(lo, hi - lo).to_pylist()):
                    spans = base_spans(t) if t else []
                    if not spans and r not in places:
                        out.append(t)
                        continue
                    covered = Covered(spans)
                    own = [{"start": a, "end": b, "action": x} for a, b, x in places.get(r, ()) if covered.free(a, b)]
                    out.append(replaced(t, ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans), own))
            yield pa.RecordBatch.from_arrays([pa.array(out, c.type) if i == at_text else c for i, c in enumerate(batch.columns)], columns)

    return docs.mapInArrow(run, docs.schema)


def _sanitise_by_join(docs: DataFrame, key: str, text: str, found: DataFrame, flagged: DataFrame) -> DataFrame:
    spans = marked(docs, key, text, flagged)
    places = found.select("doc_id", "text_hash", "base").join(spans.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    places = places.filter((F.col("base") != "") | F.col("terms").isNotNull()).dropDuplicates(["doc_id", "text_hash"])
    places = places.select(F.col("doc_id").alias("__pii_id"), F.col("text_hash").alias("__pii_hash"), F.col("base").alias("__pii_base"), F.coalesce("terms", F.array().cast("array<struct<start:long,end:long,action:string>>")).alias("__pii_terms"))
    (row_hash,) = fresh(docs.columns, "row_hash")
    joined = docs.withColumn(row_hash, F.xxhash64(text)).join(places, F.col(key).eqNullSafe(F.col("__pii_id")) & (F.col(row_hash) == F.col("__pii_hash")), "left")

    @F.pandas_udf("string")
    def clean(t, base, terms):
        return t.combine(base, lambda a, b: (a, b)).combine(terms, lambda ab, x: ab[0] if ab[0] is None or ab[1] is None else replaced(ab[0], ab[1], list(x)))

    return joined.withColumn(text, F.when(F.col("__pii_base").isNotNull(), clean(F.col(text), F.col("__pii_base"), F.col("__pii_terms"))).otherwise(F.col(text))).select(*docs.columns)
