"""Groups of similar files: connected components of the strong pairs and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.config import AnalysisConfig
from simweave.functions.text import level
from simweave.operators.skew import Pieces, split_join
from simweave.storage import drop_written, written

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """``file, root``: each file with an edge, and the smallest file that it is connected to.

    Labels spread along edges and then jump to their label's label, so long chains take a
    logarithmic number of rounds; each round is written to the shared folder. Files with very
    many edges and labels that very many files have are cut into pieces for the joins.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("lf").alias("a"), F.col("rf").alias("file")), F.struct(F.col("rf").alias("a"), F.col("lf").alias("file")))).alias("e"))
    links = written(both.select("e.a", "e.file").distinct(), "group-links")
    hubs = Pieces.of(links.groupBy("file").agg(F.count(F.lit(1)).alias("n")))
    labels = written(links.groupBy(F.col("a").alias("file")).agg(F.least(F.min("file"), F.col("a")).alias("root")), "group-labels")
    for _ in range(MAX_ROUNDS):
        near = hubs.join(links, labels, ["file"]).groupBy(F.col("a").alias("file")).agg(F.min("root").alias("near"))
        spread = written(labels.join(near, "file").select("file", "root", F.least("root", "near").alias("next")), "group-spread")
        over = spread.select(F.col("file").alias("next"), F.col("next").alias("over"))
        step = split_join(spread, over, ["next"]).select("file", F.col("root").alias("old"), F.least("next", "over").alias("root"))
        step = written(step, "group-labels")
        drop_written(labels, spread)
        labels = step
        if step.where("old <> root").isEmpty():
            drop_written(links)
            return step.select("file", "root")
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def strong_pairs(pairs: DataFrame, config: AnalysisConfig) -> DataFrame:
    return pairs.where(F.col("final_score") >= config.final_threshold)


def group_relations(pairs: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``root`` and the strong pairs inside each group."""
    strong = strong_pairs(pairs, config)
    return strong.join(components(strong).withColumnRenamed("file", "lf"), "lf")


def group_members(relations: DataFrame) -> DataFrame:
    """``root, file``: the members of the groups as rows, however large a group is."""
    return relations.select("root", F.explode(F.array("lf", "rf")).alias("file")).distinct()


def group_table(relations: DataFrame) -> DataFrame:
    """One row a group: members, score, level, density, flags and kind of evidence."""
    members = relations.select("root", F.explode(F.array("lf", "rf")).alias("file")).groupBy("root").agg(F.array_sort(F.collect_set("file")).alias("file_ids"))
    measured = relations.groupBy("root").agg(F.count(F.lit(1)).alias("edges"), F.avg("final_score").alias("mean"), F.bool_or(F.col("image_score") > 0).alias("images"))
    n = F.size("file_ids").cast("bigint")
    density = F.col("edges") / F.greatest(F.lit(1), F.floor(n * (n - 1) / 2))
    score = F.least(F.lit(1.0), 0.55 * F.col("mean") + 0.45 * density)
    weak = density < 0.5
    whole = members.join(measured, "root").select("*", density.alias("graph_density"), score.alias("group_score"), weak.alias("weak"))
    # named after its smallest file: a running number would need all groups in one task
    return whole.select(
        F.concat_ws("-", F.lit("group"), "root").alias("group_id"), "root", "file_ids", n.alias("files"), "edges", "graph_density", "group_score", level(F.col("group_score")).alias("level"),
        F.when(F.col("weak"), F.array(F.lit("WeakConnection"), F.lit("NeedsManualReview"))).otherwise(F.expr("cast(array() as array<string>)")).alias("quality_flags"),
        F.when(F.col("images"), "text-and-image").otherwise("text").alias("evidence_type"),
    )
