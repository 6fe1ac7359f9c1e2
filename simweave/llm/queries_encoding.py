"""Queries on wrong encodings: p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.llm.mojibake import restore_own_encoding
from simweave.sources.tables import table


def p6_restored(spark: SparkSession, directory: str) -> DataFrame:
    """Garbled left texts with their original, the chain that was undone and its gain."""
    rows = table(spark, directory, "matched_texts").select("match_id", "left_text")
    found = restore_own_encoding(rows, "match_id", "left_text")
    return found.groupBy("match_id").agg(F.max(F.struct("gain", "restored", "chain")).alias("r")).select("match_id", "r.restored", "r.chain", F.round("r.gain", 3).alias("gain"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "matched_texts").select("match_id", "left_text")
    return restore_own_encoding(rows, "match_id", "left_text").select("match_id").distinct()


QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored}
ORACLE_SQL: dict[str, str] = {}
