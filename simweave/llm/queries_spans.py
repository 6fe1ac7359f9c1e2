"""Queries on shared spans: p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.llm.spans import shared_spans
from simweave.sources.tables import latest, table


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return shared_spans(table(spark, directory, "matched_texts"), "match_id", "left_text")


def p5_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Characters of each left text that stand in other rows, beside the figures of its current pair."""
    rows = table(spark, directory, "matched_texts").groupBy("match_id").agg(F.max("pair_id").alias("pair_id"), F.max(F.length("left_text")).alias("chars"))
    shared = p5_found(spark, directory).groupBy("match_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("spans"))
    pairs = latest(table(spark, directory, "similarity_pairs"), ["pair_id"], "scored_at", ["matched_text_chars", "exact_page_match_count"])
    return (
        rows.join(shared, "match_id", "left")
        .join(pairs, "pair_id", "left")
        .select("match_id", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"), "matched_text_chars", "exact_page_match_count")
    )


QUERIES = {"p5_found": p5_found, "p5_shares": p5_shares}

_SPANS = """
        WITH t AS (SELECT DISTINCT match_id, left_text FROM matched_texts WHERE length(left_text) >= 120),
             w AS (SELECT match_id, unnest(range(0, length(left_text) - 119)) AS o, left_text FROM t),
             h AS (SELECT match_id, o, substring(left_text, o + 1, 120) AS s FROM w),
             shared AS (SELECT s FROM h GROUP BY s HAVING count(DISTINCT match_id) > 1),
             hit AS (SELECT DISTINCT match_id, o FROM h SEMI JOIN shared USING (s)),
             marked AS (SELECT match_id, o, CASE WHEN o - lag(o) OVER (PARTITION BY match_id ORDER BY o) <= 120 THEN 0 ELSE 1 END AS new FROM hit),
             numbered AS (SELECT match_id, o, sum(new) OVER (PARTITION BY match_id ORDER BY o) AS run FROM marked),
             span AS (SELECT match_id, min(o) AS span_start, max(o) + 120 AS span_end FROM numbered GROUP BY match_id, run)
"""
# in the test tables no match has two texts
ORACLE_SQL = {
    "p5_found": _SPANS + "SELECT match_id, span_start, span_end FROM span",
    "p5_shares": _SPANS + """,
        own AS (SELECT match_id, max(pair_id) AS pair_id, max(length(left_text)) AS chars FROM matched_texts GROUP BY match_id),
        total AS (SELECT match_id, CAST(sum(span_end - span_start) AS BIGINT) AS n, count(*) AS spans FROM span GROUP BY match_id),
        current AS (SELECT pair_id, max_by(struct_pack(c := matched_text_chars, p := exact_page_match_count), scored_at) AS v FROM similarity_pairs GROUP BY pair_id)
        SELECT match_id, CAST(chars AS INTEGER) AS chars, coalesce(n, 0) AS shared_chars, coalesce(spans, 0) AS spans, v.c AS matched_text_chars, v.p AS exact_page_match_count
        FROM own LEFT JOIN total USING (match_id) LEFT JOIN current USING (pair_id)
    """,
}
