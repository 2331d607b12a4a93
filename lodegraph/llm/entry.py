"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import bpe, cotraining, jaccard, line_dedup, media, mixing, outliers, token_counts, url_filters, warc
from lodegraph.llm.common import Scratch, table

#: The rules that op4 judges by; the word rules judge what these leave.
URL_RULES = [
    url_filters.host_rule("allow", "org/"),
    url_filters.host_rule("block", "example.org/es/"),
    url_filters.host_rule("block", "example.org/en/1"),
    url_filters.host_rule("allow", "com/fr/"),
    url_filters.host_rule("block", "com/de/"),
    *url_filters.WORD_RULES,
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = scratch.save(warc.write_archives(pages), "archives")
    kind = pages.schema["page_id"].dataType
    read = warc.read_archives(archives, payloads=False)
    return read.select(F.expr("nullif(record_id, '')").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "error")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.with_verdicts(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_text", "p_meta", "score", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.with_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines_removed", "n_words_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_media_columns, op3_warc, op4_url_filters, op5_bpe, op6_quality_classifier, op7_quality_rules, op8_mixing, op9_ngram_jaccard, op10_line_dedup)}

SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT q.page_id, payload_bytes, q.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM q LEFT JOIN f USING (payload_digest)""",
    "op4_url_filters": r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
r(rule, h, p, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
                            ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9_-])(cheap-pills|spam-farm|casino|xxx|porn)($|[^a-z0-9_-])') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN b USING (page_id)""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (SELECT a, b FROM sides UNION SELECT r.x, b.b FROM reach r JOIN sides b ON r.y = b.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY 1) m ON m.x = d.doc_id""",
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w WHERE n > 0),
m AS (SELECT a.doc_id AS d, b.doc_id AS e, a.k - b.k AS s, a.k, a.n FROM p a JOIN p b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.k < a.k)),
r AS (SELECT *, k - row_number() OVER (PARTITION BY d, e, s ORDER BY k) AS g FROM m),
spans AS (SELECT d, min(k) AS a, max(k) AS z FROM r WHERE e < d GROUP BY d, e, s, g HAVING sum(n) >= 50
  UNION ALL SELECT d, k, least(k + s - 1, last) FROM (SELECT *, max(k) OVER (PARTITION BY d, s, g) AS last, sum(n) OVER (PARTITION BY d, s, g ORDER BY k ROWS BETWEEN CURRENT ROW AND s - 1 FOLLOWING) AS words FROM r WHERE e = d) WHERE words >= 50),
gone AS (SELECT DISTINCT doc_id, i, n FROM p JOIN spans ON d = doc_id AND k BETWEEN a AND z),
c AS (SELECT doc_id, count(*) AS lines, sum(n) AS words FROM gone GROUP BY 1),
t AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY 1)
SELECT d.doc_id, coalesce(lines, 0)::BIGINT AS n_lines_removed, coalesce(words, 0)::BIGINT AS n_words_removed, sha256(t.text) AS text_sha256 FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
