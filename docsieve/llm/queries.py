"""The registered queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import exact_dedup, filter_audit, hnsw, html_blocks, langid, packing, periodic_runs, piece_sampling, pii, quality, simhash, suffix_dedup, token_count
from docsieve.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_sampled(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op7_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_exact_dedup, op3_sentencepiece_sampling, op4_simhash_near_dedup, op5_quality_classifier, op6_html_extraction, op7_hnsw_search, op8_token_counts, op9_suffix_dedup, op10_language_id, op11_pii, op12_filter_audit, op13_periodic_runs)}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
        f AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, false)] AS fails FROM w),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
        s AS (SELECT unnest(range(5)) AS i),
        o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS places FROM s a, s b, s c, s e, s g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
        p AS (SELECT places, array_to_string(list_transform(places, lambda x: substr('ABCDE', CAST(x + 1 AS INT), 1)), '') AS filter_order, s.i + 1 AS step FROM o, s),
        x AS (SELECT d.*, p.*, fails[places[step] + 1] AS own, len(list_filter(places[:step - 1], lambda k: fails[k + 1])) > 0 AS gone, len(list_filter(fails, lambda k: k)) AS n_fails FROM d, p),
        r AS (SELECT part, filter_order, CAST(step AS INT) AS step, places[step] AS f, CAST(sum(n) FILTER (NOT gone AND NOT own) AS BIGINT) AS kept, CAST(sum(n) FILTER (own AND NOT gone) AS BIGINT) AS removed,
            CAST(sum(n) FILTER (own AND gone) AS BIGINT) AS redundant, CAST(sum(n) FILTER (own AND n_fails = 1) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (own AND NOT gone) AS BIGINT) AS good_lost,
            CAST(sum(toxic) FILTER (own AND NOT gone) AS BIGINT) AS toxic_lost FROM x GROUP BY part, filter_order, step, places)
        SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost,
            coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
}
