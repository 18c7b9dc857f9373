"""Queries over the given tables that apply this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_disclosures

    found = find_disclosures(table(spark, sf_dir, "documents"))
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, terms))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import pages_through_warc

    return pages_through_warc(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import prove

    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    now = {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    proof = F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256")
    return prove(table(spark, sf_dir, "documents"), now).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    rows = decode(ids, path, keep=("doc_id", "ids"))
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP5_SQL = """
WITH RECURSIVE stats AS (
  SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source
), rates AS (
  SELECT source, CAST(sum(n) OVER () AS DOUBLE) * w / sum(w) OVER () / n AS mean FROM stats
), cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM rates
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k + 1 <= CAST(floor(mean + 10 * sqrt(mean) + 25) AS INTEGER)
), drawn AS (
  SELECT d.*, CAST(('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR) || '|1'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents d
), counted AS (
  SELECT doc_id, count(*) AS n FROM drawn JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= drawn.u GROUP BY doc_id
)
SELECT d.*, unnest(generate_series(1, c.n)) AS copy FROM documents d JOIN counted c USING (doc_id)
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS response FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response = page_id THEN NULL ELSE response END AS refers_to, true AS whole
FROM g
"""

OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT DISTINCT doc_id, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: list_transform(range(8), lambda j: (CAST(ascii(ch) AS BIGINT) >> CAST(j AS INTEGER)) & 1)))) AS b FROM documents WHERE doc_id IS NOT NULL
), crcs AS (
  SELECT doc_id, xor(list_reduce(b, lambda c, x: CASE WHEN (xor(c, x) & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS crc FROM bits
), told AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, CASE WHEN crc % 2 = 0 THEN replace(d.text, chr(10), '') ELSE d.text END AS now FROM documents d LEFT JOIN crcs USING (doc_id)
), front AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS start FROM told
), leaves AS (
  SELECT doc_id, source, sha256(start || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(start || coalesce(strlen(now) || ':' || now, '-')) AS held FROM front
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves
), nodes(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3
), ends AS (
  SELECT tree, level AS height, h AS subroot FROM nodes WHERE n = 1
), tops(level, pos, h, n) AS (
  SELECT 0, tree, subroot, count(*) OVER () FROM ends
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, pos // 3
), steps AS (
  SELECT p.tree, p.pos, n.level, string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos < p.pos // CAST(pow(3, n.level) AS BIGINT)) AS l,
    string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos > p.pos // CAST(pow(3, n.level) AS BIGINT)) AS r
  FROM placed p JOIN nodes n ON n.tree = p.tree AND n.n > 1 AND n.pos // 3 = p.pos // CAST(pow(3, n.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT p.tree, p.pos, e.height + t.level, string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < p.tree // CAST(pow(3, t.level) AS BIGINT)),
    string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > p.tree // CAST(pow(3, t.level) AS BIGINT))
  FROM placed p JOIN ends e USING (tree) JOIN tops t ON t.n > 1 AND t.pos // 3 = p.tree // CAST(pow(3, t.level + 1) AS BIGINT) GROUP BY ALL
), proofs AS (
  SELECT tree, pos, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY tree, pos
), folds(tree, pos, level, h) AS (
  SELECT tree, pos, 0, held FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(coalesce(s.l, '') || f.h || coalesce(s.r, '')) FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level
), folded AS (
  SELECT tree, pos, arg_max(h, level) AS folded_root FROM folds GROUP BY tree, pos
)
SELECT p.doc_id, p.leaf, e.subroot, t.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.h AS verified
FROM placed p JOIN ends e USING (tree) JOIN folded f ON f.tree = p.tree AND f.pos = p.pos LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), places AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, count(*) AS n FROM places WHERE size = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first_part, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rest
  FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score, c.k
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, unnest(list_transform(range(1, size - n + 2), lambda i: array_to_string(string_split(phrase, ' ')[i : i + n - 1], ' '))) AS phrase, f
  FROM f, (SELECT unnest([2, 3]) AS n) WHERE n < size
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM inner_phrases GROUP BY ALL
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 80 * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {
    "op1_disclosure": op1_disclosure,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_mix_sources": op5_mix_sources,
    "op6_token_counts": op6_token_counts,
    "op7_nearest": op7_nearest,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {"op2_ngram_join": OP2_SQL, "op5_mix_sources": OP5_SQL, "op9_warc": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_collocations": OP13_SQL}
