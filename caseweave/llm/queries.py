"""Registered queries of the subpackage and their SQL: the operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from caseweave.llm import audit, decontaminate, exact, html_text, langid, minhash, mixing, spelling, substrings, suffixes, tokens, urls, warc
from caseweave.llm.shared import ship_package

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeated_strings(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken_words(mixing.mix_sources(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents")).drop("key")


def op4_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeated_windows(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived_pages(table(spark, sf_dir, "pages"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


# The list of rules (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents")
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [pipeline, op1_suffix_dedup, op2_mix_sources, op3_near_duplicates, op4_contained_items, op5_substring_dedup, op6_warc, op7_language, op8_page_text, op9_token_records, op10_exact_dedup, op11_url_filter, op12_filter_audit, op13_spelling_variants]
    return {function.__name__: function for function in named}


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
"""


OP6_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top
    FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages)
)
"""


OP11_SQL = """
WITH behind AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM behind
), judged AS (
    SELECT *, CASE
        WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/'
    END AS rule
    FROM parsed
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


OP12_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), judged AS (
    SELECT doc_id, part,
           CASE WHEN len(words) < 200 THEN 1 ELSE 0 END AS a,
           CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 1 ELSE 0 END AS b,
           CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 1 ELSE 0 END AS c,
           CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
           CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END AS e
    FROM words
), marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), sets AS (
    SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM judged LEFT JOIN marks USING (doc_id) GROUP BY 1, 2
), letters AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)
), orders AS (
    SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5
), steps AS (
    SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step - 1]) AS before
    FROM orders, range(1, 6) AS r(step)
), parts AS (SELECT DISTINCT part FROM sets), counted AS (
    SELECT part, filter_order, step, own,
           sum(CASE WHEN failed & (coalesce(before, 0)::BIGINT | own) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN failed & coalesce(before, 0)::BIGINT = 0 AND failed & own > 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN failed & coalesce(before, 0)::BIGINT > 0 AND failed & own > 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN failed & coalesce(before, 0)::BIGINT = 0 AND failed & own > 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN failed & coalesce(before, 0)::BIGINT = 0 AND failed & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM parts JOIN sets USING (part), steps GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_url_filter": OP11_SQL, "op12_filter_audit": OP12_SQL}
