"""Queries on similarity pairs and groups: p2 and p3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.llm.components import connected_components
from simweave.llm.topn import top_n
from simweave.sources.tables import latest, table


def current_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return latest(table(spark, directory, "similarity_pairs"), ["pair_id"], "scored_at", ["final_score", "left_file_id", "right_file_id", "task_id"])


def _requests(spark: SparkSession, directory: str, column: str) -> DataFrame:
    return table(spark, directory, "analyze_requests").groupBy("task_id").agg(F.max(column).alias(column))


def best_pairs(spark: SparkSession, directory: str) -> DataFrame:
    pairs = current_pairs(spark, directory).join(_requests(spark, directory, "candidate_top_k_per_file"), "task_id")
    return top_n(pairs, "left_file_id", "final_score", "right_file_id", "pair_id", "candidate_top_k_per_file")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return best_pairs(spark, directory).select("left_file_id", "pair_id")


def p2_ranks(spark: SparkSession, directory: str) -> DataFrame:
    return best_pairs(spark, directory)


def file_links(spark: SparkSession, directory: str) -> DataFrame:
    """``a, b``: strong current pairs, and each group's members tied to its smallest one."""
    pairs = current_pairs(spark, directory).join(_requests(spark, directory, "final_threshold"), "task_id")
    strong = pairs.where("final_score >= final_threshold AND NOT isnan(final_score)").select(F.col("left_file_id").alias("a"), F.col("right_file_id").alias("b"))
    members = table(spark, directory, "similarity_groups").select(F.array_distinct(F.array_compact("file_ids")).alias("ids")).where("size(ids) > 1")
    grouped = members.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b"))
    return strong.unionByName(grouped)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    found = connected_components(file_links(spark, directory), "a", "b")
    return found.select(F.col("vertex").alias("file_id"), F.col("component").alias("group_file_id"))


QUERIES = {"p2_found": p2_found, "p2_ranks": p2_ranks, "p3_found": p3_found}

_CURRENT = """
    current AS (SELECT pair_id, max_by(struct_pack(s := final_score, l := left_file_id, r := right_file_id, t := task_id), scored_at) AS v
                FROM similarity_pairs GROUP BY pair_id)
"""
_RANKED = f"""
    WITH {_CURRENT},
    ranked AS (SELECT v.l AS left_file_id, pair_id, candidate_top_k_per_file AS k,
                      row_number() OVER (PARTITION BY v.l ORDER BY v.s DESC, v.r, pair_id) AS rank
               FROM current JOIN analyze_requests q ON q.task_id = v.t
               WHERE v.l IS NOT NULL AND v.r IS NOT NULL AND v.s IS NOT NULL AND NOT isnan(v.s))
"""
ORACLE_SQL = {
    "p2_found": _RANKED + "SELECT left_file_id, pair_id FROM ranked WHERE rank <= k",
    "p2_ranks": _RANKED + "SELECT left_file_id, pair_id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= k",
    "p3_found": f"""
        WITH RECURSIVE {_CURRENT},
        strong AS (SELECT v.l AS a, v.r AS b FROM current JOIN analyze_requests q ON q.task_id = v.t
                   WHERE v.s >= q.final_threshold AND NOT isnan(v.s) AND v.l IS NOT NULL AND v.r IS NOT NULL AND v.l <> v.r),
        member AS (SELECT row_number() OVER () AS g, list_distinct(file_ids) AS ids FROM similarity_groups),
        listed AS (SELECT g, unnest(ids) AS f FROM member),
        one AS (SELECT a, b FROM strong
                UNION SELECT x.f, y.f FROM listed x JOIN listed y USING (g) WHERE x.f < y.f),
        edge AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
        reach AS (SELECT a AS file_id, a AS other FROM edge
                  UNION SELECT reach.file_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
        SELECT file_id, min(other) AS group_file_id FROM reach GROUP BY file_id
    """,
}
