"""Queries on the form of texts: p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from simweave.llm.visual import fold_sql, visual_forms
from simweave.sources.tables import table


def p7_forms(spark: SparkSession, directory: str) -> DataFrame:
    """Both sides of every matched text in their one form."""
    rows = table(spark, directory, "matched_texts").select("match_id", "left_text", "right_text").distinct()
    return visual_forms(rows, ["match_id"], ["left_text", "right_text"])


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Matches whose sides differ as stored and are equal in their one form."""
    rows = table(spark, directory, "matched_texts").select("match_id", "left_text", "right_text")
    differing = rows.where("left_text IS NOT NULL AND right_text IS NOT NULL AND left_text <> right_text")
    return visual_forms(differing, ["match_id"], ["left_text", "right_text"]).where("left_text = right_text").select("match_id").distinct()


QUERIES = {"p7_found": p7_found, "p7_forms": p7_forms}
ORACLE_SQL = {
    "p7_found": f"""SELECT DISTINCT match_id FROM matched_texts WHERE left_text IS NOT NULL AND right_text IS NOT NULL AND left_text <> right_text
        AND {fold_sql("left_text")} = {fold_sql("right_text")}""",
    "p7_forms": f"""SELECT match_id, {fold_sql("left_text")} AS left_text, {fold_sql("right_text")} AS right_text FROM (SELECT DISTINCT match_id, left_text, right_text FROM matched_texts)""",
}
