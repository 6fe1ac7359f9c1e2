"""Queries on tokens and containers: p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.llm.packing import fill_containers
from simweave.llm.tokens import decode_corpus, encode_corpus
from simweave.sources.tables import table
from simweave.storage import written

CAPACITY = 2048


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode_corpus(table(spark, directory, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return decode_corpus(p8_ids(spark, directory), "doc_id", "ids")


def p9_containers(spark: SparkSession, directory: str) -> DataFrame:
    sizes = encode_corpus(table(spark, directory, "documents"), "doc_id", "text", counts=True)
    return fill_containers(sizes, "doc_id", "tokens", CAPACITY)


def p9_fill(spark: SparkSession, directory: str) -> DataFrame:
    """Used room of every container."""
    used = p9_containers(spark, directory).groupBy("container").agg(F.sum(F.col("end") - F.col("start")).alias("used"), F.count(F.lit(1)).alias("pieces"))
    return used.withColumn("unused", F.lit(CAPACITY) - F.col("used"))


def p9_whole(spark: SparkSession, directory: str) -> DataFrame:
    """Of every document: that its pieces join up, and that only one longer than a container is divided; of all containers: no gap, none too full."""
    placed = written(p9_containers(spark, directory), "placed")
    used = placed.groupBy("container").agg(F.sum(F.col("end") - F.col("start")).alias("used"))
    room = used.agg((F.max("used") <= CAPACITY).alias("within_capacity"), (F.max("container") + 1 == F.count(F.lit(1))).alias("no_gap"))
    documents = placed.groupBy("doc_id").agg(
        (F.max("end") == F.sum(F.col("end") - F.col("start"))).alias("joined_up"),
        ((F.count(F.lit(1)) == 1) | (F.max("end") > CAPACITY)).alias("divided_if_needed"),
    )
    return documents.crossJoin(F.broadcast(room))  # one row


QUERIES = {"p9_whole": p9_whole, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_containers": p9_containers, "p9_fill": p9_fill}

ORACLE_SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_whole": "SELECT doc_id, true AS joined_up, true AS divided_if_needed, true AS within_capacity, true AS no_gap FROM documents",
}
