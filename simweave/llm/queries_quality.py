"""Queries on text quality: p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.llm.quality import FEATURES, clean_labels, learn_rules, rules_sql, text_statistics
from simweave.sources.tables import table
from simweave.storage import written


def _statistics(spark: SparkSession, directory: str, documents: DataFrame) -> DataFrame:
    return text_statistics(documents, "doc_id", "text", table(spark, directory, "common_words"))


def judged(spark: SparkSession, directory: str) -> DataFrame:
    """The statistics of every document, and the number of the rule that calls it no prose (0: prose)."""
    documents = table(spark, directory, "documents")
    # written, so that its small size is known to the plan and no document is shuffled to meet its label
    labels = written(clean_labels(table(spark, directory, "doc_labels"), "doc_id", "kind"), "labels")
    # the labelled documents are measured first; the rules then go into the plan as constants
    rules = learn_rules(_statistics(spark, directory, documents.join(labels.select("doc_id"), "doc_id", "left_semi")), labels, "doc_id")
    return _statistics(spark, directory, documents).withColumn("rule", F.expr(rules_sql(rules)))


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return judged(spark, directory).where("chars > 0 AND rule > 0").select("doc_id")


def p10_statistics(spark: SparkSession, directory: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in FEATURES]
    return judged(spark, directory).select("doc_id", "chars", "words", "lines", *rounded, (F.col("rule") == 0).alias("is_prose"))


def p10_counts(spark: SparkSession, directory: str) -> DataFrame:
    """The statistics that do not depend on lines."""
    documents = table(spark, directory, "documents")
    kept = [F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "digit_ratio", "common_share")]
    return _statistics(spark, directory, documents).select("doc_id", "chars", "words", *kept)


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics, "p10_counts": p10_counts}

_CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
ORACLE_SQL = {
    "p10_counts": rf"""
        WITH listed AS (SELECT DISTINCT lower(trim(word)) AS word FROM common_words WHERE word IS NOT NULL),
             single AS (SELECT word FROM listed WHERE length(word) = 1 AND unicode(word) BETWEEN 13312 AND 40959),
             spelled AS (SELECT word FROM listed WHERE length(word) > 1 OR unicode(word) BETWEEN 1024 AND 1279),
             t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             word AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[{_CJK}]', ' ', 'g'), '[^\p{{L}}\p{{M}}''’]+'), lambda w: w <> '')) AS w FROM t),
             spelt AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS letters, count(*) FILTER (w IN (SELECT word FROM spelled)) AS common FROM word GROUP BY doc_id),
             sign AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{_CJK}]')) AS c FROM t),
             signs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (c IN (SELECT word FROM single)) AS common FROM sign GROUP BY doc_id),
             ink AS (SELECT doc_id, length(regexp_replace(text, '[ \t\n\x0b\f\r\p{{Z}}]', '', 'g')) AS chars,
                            length(regexp_replace(text, '[\p{{L}}\p{{M}}\p{{N}} \t\n\x0b\f\r\p{{Z}}\p{{Co}}]', '', 'g')) AS symbols, length(regexp_replace(text, '[^\p{{N}}]', '', 'g')) AS digits FROM t),
             every AS (SELECT doc_id, chars, symbols, digits, coalesce(s.n, 0) + coalesce(g.n, 0) AS words, coalesce(s.letters, 0) + coalesce(g.n, 0) AS letters, coalesce(s.common, 0) + coalesce(g.common, 0) AS common
                       FROM ink LEFT JOIN spelt s USING (doc_id) LEFT JOIN signs g USING (doc_id))
        SELECT doc_id, CAST(chars AS BIGINT) AS chars, CAST(words AS BIGINT) AS words,
               CASE WHEN words > 0 THEN round(letters / CAST(words AS DOUBLE), 6) END AS mean_word_length, CASE WHEN chars > 0 THEN round(symbols / CAST(chars AS DOUBLE), 6) END AS symbol_ratio,
               CASE WHEN chars > 0 THEN round(digits / CAST(chars AS DOUBLE), 6) END AS digit_ratio, CASE WHEN words > 0 THEN round(common / CAST(words AS DOUBLE), 6) END AS common_share
        FROM every
    """,
}
