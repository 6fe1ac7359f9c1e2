"""Queries on splitting: p1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simweave.llm.splitting import split_oversized
from simweave.sources.tables import file_tasks, latest, table


def page_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of all current pages, by the parameters of each file's task."""
    pages = latest(table(spark, directory, "page_texts"), ["file_id", "page"], "extracted_at", ["text"])
    tasks = table(spark, directory, "analyze_requests").select("task_id", "target_chunk_chars", "chunk_overlap_chars").dropDuplicates(["task_id"])
    limits = file_tasks(table(spark, directory, "files")).unionByName(file_tasks(table(spark, directory, "template_files"))).dropDuplicates(["file_id"]).join(tasks, "task_id")
    return split_oversized(pages.join(limits, "file_id"), ["file_id", "page"], "text", "target_chunk_chars", "chunk_overlap_chars")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pages that came out as more than one piece."""
    return page_pieces(spark, directory).where("piece = 1").select("file_id", "page")


def p1_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of every page longer than its limit."""
    return page_pieces(spark, directory).where("pieces > 1").select("file_id", "page", "piece", "start", "end")


def p1_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Of every page longer than its limit: whether its pieces cover it, keep the limit and overlap as asked."""
    tasks = table(spark, directory, "analyze_requests").groupBy("task_id").agg(F.max("target_chunk_chars").alias("target"), F.max("chunk_overlap_chars").alias("overlap"))
    limits = file_tasks(table(spark, directory, "files")).unionByName(file_tasks(table(spark, directory, "template_files"))).dropDuplicates(["file_id"]).join(tasks, "task_id")
    pieces = page_pieces(spark, directory).where("pieces > 1")
    following = F.lead("start").over(W.partitionBy("file_id", "page").orderBy("piece"))
    steps = pieces.withColumn("next", following).join(limits, "file_id")
    return steps.groupBy("file_id", "page").agg(
        F.min("start").alias("first"),
        F.max("end").alias("chars"),
        (F.count(F.lit(1)) == F.max("pieces")).alias("numbered"),
        F.bool_and(F.col("end") - F.col("start") <= F.col("target")).alias("within_target"),
        F.bool_and(F.coalesce(F.col("end") - F.col("next") == F.col("overlap"), F.lit(True))).alias("overlapping"),
    )


def p1_file_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Pieces of each file against the chunk count of its last scan; null where that is unknown."""
    pieces = page_pieces(spark, directory).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("piece") == 1).alias("divided_pages")
    )
    files = table(spark, directory, "files")
    files = files.unionByName(table(spark, directory, "template_files").select(*files.columns))
    stated = latest(files.where("id IS NOT NULL").withColumnRenamed("id", "file_id"), ["file_id"], "scanned_at", ["chunk_count"])
    joined = stated.join(pieces, "file_id", "left").select(
        "file_id", F.coalesce("pieces", F.lit(0)).alias("pieces"), F.coalesce("divided_pages", F.lit(0)).alias("divided_pages"), "chunk_count"
    )
    return joined.withColumn("agrees", F.col("pieces") == F.col("chunk_count"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_coverage": p1_coverage, "p1_file_counts": p1_file_counts}

ORACLE_SQL = {
    "p1_coverage": """
        WITH pages AS (SELECT file_id, page, arg_max(struct_pack(t := text), extracted_at).t AS text FROM page_texts GROUP BY ALL),
             limits AS (SELECT DISTINCT f.id AS file_id, r.target_chunk_chars FROM (SELECT id, task_id FROM files UNION SELECT id, task_id FROM template_files) f JOIN analyze_requests r USING (task_id))
        SELECT file_id, page, CAST(0 AS BIGINT) AS first, length(text) AS chars, true AS numbered, true AS within_target, true AS overlapping
        FROM pages JOIN limits USING (file_id) WHERE length(text) > target_chunk_chars
    """,
    "p1_found": """
        WITH pages AS (SELECT file_id, page, arg_max(struct_pack(t := text), extracted_at).t AS text FROM page_texts GROUP BY ALL),
             limits AS (SELECT DISTINCT f.id AS file_id, r.target_chunk_chars FROM files f JOIN analyze_requests r USING (task_id))
        SELECT file_id, page FROM pages JOIN limits USING (file_id) WHERE length(text) > target_chunk_chars
    """,
}
