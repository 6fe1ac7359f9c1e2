"""Queries on near-duplicate texts: p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.llm.components import connected_components
from simweave.llm.neardup import all_pairs, near_duplicates
from simweave.sources.tables import table

SIMILARITY = 0.72


def id_components(pairs: DataFrame) -> DataFrame:
    """``first, group``: each id of ``a, b`` and the least id that it is connected to."""
    # numbers of either sign as strings of the same order
    shift = F.expr("CAST('9223372036854775808' AS DECIMAL(20,0))")
    edges = pairs.select(*[F.lpad((F.col(c).cast("decimal(20,0)") + shift).cast("decimal(20,0)").cast("string"), 20, "0").alias(c) for c in ("a", "b")])
    found = connected_components(edges, "a", "b")
    return found.select(*[(F.col(c).cast("decimal(20,0)") - shift).cast("bigint").alias(name) for c, name in (("vertex", "first"), ("component", "group"))])


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    found = all_pairs(*near_duplicates(table(spark, directory, "matched_texts"), "match_id", "left_text", SIMILARITY))
    return found.select(F.col("a").alias("match_id_a"), F.col("b").alias("match_id_b"))


def p4_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Each row with a near-duplicate: its group, the links of its text to other texts, and copies of its text."""
    pairs, copies = near_duplicates(table(spark, directory, "matched_texts"), "match_id", "left_text", SIMILARITY)
    links = pairs.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("links"))
    same = copies.groupBy("first").agg(F.count(F.lit(1)).alias("copies"))
    firsts = copies.select(F.col("first").alias("id"), "first").distinct().unionByName(copies)
    groups = id_components(pairs)
    texts = groups.select("first").unionByName(same.select("first")).distinct()
    whole = texts.join(groups, "first", "left").join(links, "first", "left").join(same, "first", "left").join(firsts, "first", "left")
    return whole.select(
        F.coalesce("id", "first").alias("match_id"),
        F.coalesce("group", "first").alias("group_match_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}

_SIMILAR = """
    WITH RECURSIVE t AS (SELECT DISTINCT match_id, left_text FROM matched_texts WHERE length(left_text) >= 5),
             g AS (SELECT DISTINCT match_id, substring(left_text, CAST(i AS INTEGER), 5) AS s
                   FROM (SELECT match_id, left_text, unnest(range(1, length(left_text) - 3)) AS i FROM t)),
             n AS (SELECT match_id, count(*) AS n FROM g GROUP BY match_id),
             c AS (SELECT a.match_id AS x, b.match_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.match_id < b.match_id GROUP BY ALL),
             pair AS (SELECT x, y FROM c JOIN n p ON p.match_id = x JOIN n q ON q.match_id = y WHERE c.c * 100 >= 72 * (p.n + q.n - c.c))
"""
ORACLE_SQL = {
    "p4_found": _SIMILAR + "SELECT x AS match_id_a, y AS match_id_b FROM pair",
    # in the test tables no match has two texts
    "p4_groups": _SIMILAR + """,
        edge AS (SELECT x AS a, y AS b FROM pair UNION SELECT y, x FROM pair),
        reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
        linked AS (SELECT a, count(DISTINCT y.left_text) FILTER (x.left_text <> y.left_text) AS links, count(*) FILTER (x.left_text = y.left_text) AS copies
                   FROM edge JOIN t x ON x.match_id = a JOIN t y ON y.match_id = b GROUP BY a)
        SELECT r.a AS match_id, min(r.b) AS group_match_id, any_value(links) AS links, any_value(copies) AS copies FROM reach r JOIN linked ON linked.a = r.a GROUP BY r.a
    """,
}
