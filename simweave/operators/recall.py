"""Candidate file pairs from shared text features.

An inverted index of sketch hashes as a self-join: hashes that are too rare or too common are
dropped before it, which bounds what one hash contributes (at most 180 chunks meet), so there
is no skewed key. Everything after it is aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simweave.config import LOCAL_SHARED, MAX_POSTING, STRONG_SHARED, AnalysisConfig, feature_file_cap
from simweave.storage import written


def features(sketch: DataFrame, files: int) -> DataFrame:
    """``h, postings, df``: the hashes shared by at least two files and by not too many."""
    # the number of files of a hash needs no more than the cap; counting chunks first keeps it partial
    per_file = sketch.groupBy("h", "file").agg(F.count(F.lit(1)).alias("n"))
    counted = per_file.groupBy("h").agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("df"))
    return counted.where(F.col("postings").between(2, MAX_POSTING) & F.col("df").between(2, feature_file_cap(files)))


def chunk_pairs(sketch: DataFrame, feature: DataFrame, files: int) -> DataFrame:
    """``lf, lc, rf, rc, shared, weight``: chunks of two files with shared features, lf < rf."""
    weight = F.greatest(F.lit(0.1), F.log(F.lit(float(files)) / (1 + F.col("df")))).alias("weight")
    kept = written(sketch.join(feature.select("h", weight), "h"), "postings")
    left = kept.select("h", F.col("file").alias("lf"), F.col("chunk").alias("lc"), "weight")
    right = kept.select("h", F.col("file").alias("rf"), F.col("chunk").alias("rc"))
    met = left.join(right, "h").where("lf < rf")
    return met.groupBy("lf", "lc", "rf", "rc").agg(F.count(F.lit(1)).alias("shared"), F.sum("weight").alias("weight"))


def candidate_evidence(pairs: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``lf, rf, raw, matches, most, left_chunks, right_chunks`` of the pairs with enough evidence, and ``most_raw`` of all."""
    enough = F.col("shared") >= config.min_shared_shingles
    # the sets hold numbers of chunks of one file; the number of distinct ones would take an expansion
    per_file = pairs.groupBy("lf", "rf").agg(
        F.sum("weight").alias("raw"),
        F.count_if(enough).alias("matches"),
        F.max(F.when(enough, F.col("shared"))).alias("most"),
        F.size(F.collect_set(F.when(enough, F.col("lc")))).alias("left_chunks"),
        F.size(F.collect_set(F.when(enough, F.col("rc")))).alias("right_chunks"),
    )
    per_file = written(per_file, "evidence")
    top = per_file.agg(F.greatest(F.max("raw"), F.lit(1.0)).alias("most_raw"))
    return per_file.where(f"matches >= 2 OR most >= {STRONG_SHARED}").crossJoin(F.broadcast(top))  # one row


def scored_candidates(evidence: DataFrame, chunk_counts: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``lf, rf, score`` of the pairs that pass the threshold, or that share much in one place."""
    left = chunk_counts.select(F.col("file").alias("lf"), F.col("chunk_count").alias("ln"))
    right = chunk_counts.select(F.col("file").alias("rf"), F.col("chunk_count").alias("rn"))
    coverage = F.least(F.col("left_chunks") / F.greatest("ln", F.lit(1)), F.col("right_chunks") / F.greatest("rn", F.lit(1)), F.lit(1.0))
    score = 0.15 * F.least(F.lit(1.0), F.col("raw") / F.greatest(F.lit(1.0), "most_raw")) + 0.75 * coverage + 0.10 * F.least(F.lit(1.0), F.col("matches") / 12)
    scored = evidence.join(left, "lf").join(right, "rf").withColumn("score", score)
    return scored.where((F.col("score") >= config.candidate_score_threshold) | (F.col("most") >= LOCAL_SHARED)).select("lf", "rf", "score")


def top_candidates(scored: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The pairs that are among the best of either of their files."""
    ends = scored.select("lf", "rf", F.round("score", 9).alias("rounded"), F.explode(F.array("lf", "rf")).alias("file"))
    best = ends.withColumn("rank", F.row_number().over(W.partitionBy("file").orderBy(F.desc("rounded"), "lf", "rf"))).where(F.col("rank") <= config.candidate_top_k_per_file)
    return scored.join(best.select("lf", "rf").distinct(), ["lf", "rf"], "left_semi")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file").agg(F.count(F.lit(1)).alias("chunk_count"))
