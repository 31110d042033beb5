"""The queries of this subpackage, each over its whole tables, and their SQL twins where SQL can say it.

A query answers nulls, empty and very long texts, ties, repeated rows, empty tables and further columns as its operator's
docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, langid, lmscore, packing, periodic, quality, scratch, secrets, sharding, tokencount, urlfilter, vectorcode, warc

#: The public vocabularies of the packing and counting queries; the files are read where they lie and never copied.
PACKING_TOKENIZER, COUNTING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, upper(sha1(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  translate(concat(
    to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32, 8), to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32, 8),
    to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32, 8), to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32, 8)),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

#: The contract's rules: action, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Absolute canonical links and refreshes are followed; the tables have no relative ones.
OP11_SQL = r"""
WITH RECURSIVE rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
links AS (
  SELECT url AS src, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''>\s]+)', 1) AS dst FROM tags WHERE regexp_matches(tag, '(?i)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
  UNION ALL
  SELECT url, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''>\s]+)', 1) FROM tags WHERE regexp_matches(tag, '(?i)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b')),
urls AS (SELECT url FROM pages UNION SELECT dst FROM links WHERE dst <> ''),
parts AS (
  SELECT url, translate(regexp_extract(url, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1) AS query FROM urls WHERE url IS NOT NULL),
judged AS (
  SELECT url, host, path, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query AS node, r.rule, r.action
  FROM parts LEFT JOIN LATERAL (
    SELECT h || p AS rule, action FROM rules WHERE (parts.host = h OR ends_with(parts.host, '.' || h)) AND starts_with(parts.path, p) ORDER BY length(h || p) DESC, action, rule LIMIT 1) r ON true),
edges AS (SELECT DISTINCT a.node AS a, b.node AS b FROM links JOIN judged a ON a.url = links.src JOIN judged b ON b.url = links.dst),
reached(node) AS (
  SELECT node FROM judged WHERE action = 'block' AND contains(url, '://')
  UNION SELECT CASE WHEN e.a = r.node THEN e.b ELSE e.a END FROM reached r JOIN edges e ON r.node IN (e.a, e.b))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  coalesce(action, CASE WHEN contains(pages.url, '://') AND node IN (SELECT node FROM reached) THEN 'block' ELSE 'allow' END) AS verdict,
  action IS NULL AND contains(pages.url, '://') AND node IN (SELECT node FROM reached) AS via_alias
FROM pages LEFT JOIN judged ON judged.url = pages.url
"""


def _codes_sql() -> str:
    """Four rounds of assignment and update, one common table each."""
    part = "list_transform(list_zip(p.part, c.entry_part), lambda x: (x[1] - x[2]) * (x[1] - x[2]))"
    steps = ["""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "parts AS MATERIALIZED (SELECT vec_id, label, k, v[k * len(v) // 4 + 1 : (k + 1) * len(v) // 4] AS part FROM kept, range(4) t(k))",
             "c0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, part AS entry_part FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"]
    for i in range(5):
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.vec_id, p.label, p.k, p.part, min(struct_pack(d := list_sum({part})::BIGINT, e := c.e)) AS best FROM parts p JOIN c{i} c USING (k) GROUP BY ALL)")
        if i < 4:
            steps += [
                f"s{i} AS (SELECT k, e, j, sum(x) AS s, count(*) AS n FROM (SELECT k, best.e AS e, unnest(part) AS x, generate_subscripts(part, 1) AS j FROM a{i}) GROUP BY k, e, j)",
                f"m{i} AS (SELECT k, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS entry_part FROM s{i} GROUP BY k, e)",
                f"c{i + 1} AS MATERIALIZED (SELECT c.k, c.e, coalesce(m.entry_part, c.entry_part) AS entry_part FROM c{i} c LEFT JOIN m{i} m USING (k, e))",
            ]
    return "WITH " + ",\n".join(steps) + """,
books AS (SELECT sha256(string_agg(list_aggregate(entry_part, 'string_agg', ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c4),
coded AS (SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(best.e AS INTEGER))), '' ORDER BY k) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""


OP13_SQL = _codes_sql()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, words and greedy word pieces of every document, see :func:`.tokencount.token_counts`."""
    pieces = tokencount.read_pieces(COUNTING_TOKENIZER)
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), pieces)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more, see :func:`.jaccard.ngram_components`."""
    return jaccard.ngram_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 of nearly equal bytes, see :func:`.sharding.assign_shards`."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, told apart by a forest that learned from planted findings, see :func:`.secrets.scan`."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, see :func:`.decontaminate.contaminated`."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and context-tree scores of every document, see :func:`.lmscore.score_texts`."""
    return lmscore.score_texts(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives in the shared folder and read back, see :func:`.warc.write_warc` and :func:`.warc.page_index`."""
    path = scratch.new_path(spark, "archives")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_index(spark, path)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, log-likelihood ratio and verdict of every document, see :func:`.quality.quality`."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 1024, see :func:`.packing.pack`."""
    return packing.pack(_table(spark, sf_dir, "documents"), PACKING_TOKENIZER)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, see :func:`.langid.identify`."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict, with block decisions of its aliases, see :func:`.urlfilter.judge`."""
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, after the contract's repetitions, see :func:`.periodic.periodic_runs`."""
    return periodic.periodic_runs(_table(spark, sf_dir, "documents"), change=periodic.repeating)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte codes of all whole vectors and their errors, see :func:`.vectorcode.compress`."""
    return vectorcode.compress(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of_them = (
        op1_token_counts, op2_ngram_jaccard, op3_sharding, op4_secret_scan, op5_decontamination, op6_lm_scores, op7_warc, op8_quality_rules, op9_packing,
        op10_language_id, op11_url_filters, op12_periodic_runs, op13_vector_codes,
    )
    return {f.__name__: f for f in all_of_them}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7_SQL, "op11_url_filters": OP11_SQL, "op13_vector_codes": OP13_SQL}
