"""Verification of candidate pairs: exact pages, chunk matches, coverage and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simweave.config import LARGE_IMAGE_AREA, MAX_CHUNK_COMPARISONS, MIN_FINAL, SHARED_RATIO, AnalysisConfig
from simweave.functions.text import hamming, is_readable, jaccard, level, preview


def exact_pages(candidates: DataFrame, clean: DataFrame) -> DataFrame:
    """``lf, rf, left_page, right_page, char_count``: pages with the same text, one to one.

    Where both files repeat a text, its occurrences pair up by rank: the first with the first,
    and the i-th one of the left with the i-th last of the right.
    """
    pages = clean.where("char_count >= 1").select("file", "page", F.unhex(F.sha2("text", 256)).alias("digest"), "char_count")
    order = W.partitionBy("file", "digest").orderBy("page")
    ranked = pages.withColumn("rank", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("file", "digest")))
    left = ranked.select(F.col("file").alias("lf"), "digest", F.col("page").alias("left_page"), F.col("rank").alias("lrank"), "char_count")
    right = ranked.select(F.col("file").alias("rf"), "digest", F.col("page").alias("right_page"), F.col("rank").alias("rrank"), F.col("n").alias("rn"))
    paired = candidates.select("lf", "rf").join(left, "lf").join(right, ["rf", "digest"])
    met = paired.where(F.col("rrank") == F.when(F.col("lrank") == 0, 0).otherwise(F.col("rn") - F.col("lrank")))
    # only the texts of pages that met are moved
    texts = clean.select(F.col("file").alias("lf"), F.col("page").alias("left_page"), "text")
    return met.join(texts, ["lf", "left_page"]).select("lf", "rf", "left_page", "right_page", "char_count", "text")


def ranked_chunk_pairs(candidates: DataFrame, pairs: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The chunk pairs of the candidates that are looked at: those that share most."""
    order = W.partitionBy("lf", "rf").orderBy(F.desc("shared"), "lc", "rc")
    enough = pairs.where(F.col("shared") >= config.min_shared_shingles).join(candidates.select("lf", "rf"), ["lf", "rf"], "left_semi")
    return enough.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_CHUNK_COMPARISONS)


def verified_chunk_pairs(ranked: DataFrame, chunks: DataFrame, simhash: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Ranked chunk pairs with ``jaccard, distance, ratio``, those that match: equal, similar, or close by fingerprint."""
    whole = chunks.join(simhash, ["file", "chunk"])
    side = lambda n: whole.select(
        F.col("file").alias(f"{n}f"), F.col("chunk").alias(f"{n}c"), F.col("page").alias(f"{n}page"), F.col("start").alias(f"{n}start"),
        F.col("end").alias(f"{n}end"), F.col("text_hash").alias(f"{n}hash"), F.col("shingles").alias(f"{n}s"), F.col("simhash").alias(f"{n}sim"),
    )
    met = ranked.join(side("l"), ["lf", "lc"]).join(side("r"), ["rf", "rc"])
    ratio = F.col("shared") / F.greatest(F.lit(1), F.least(F.size("ls"), F.size("rs")))
    measured = met.select(
        "lf", "rf", "lc", "rc", "rank", "shared", "lpage", "rpage", "lstart", "lend", "rstart", "rend",
        (F.col("lhash") == F.col("rhash")).alias("same"),
        jaccard(F.col("ls"), F.col("rs")).alias("jaccard"),
        hamming(F.col("lsim"), F.col("rsim")).alias("distance"),
        ratio.alias("ratio"),
    )
    matches = F.col("same") | (F.col("jaccard") >= config.text_threshold) | ((F.col("distance") <= config.simhash_hamming_threshold) & (F.col("ratio") >= SHARED_RATIO))
    return measured.where(matches)


def greedy_chunk_matches(verified: DataFrame, exact: DataFrame) -> DataFrame:
    """The matches in which no chunk is used twice, taken by rank; pages matched as a whole take no part.

    A pair that doesn't match uses nothing up, so filtering before the choice changes nothing.
    The choice runs over the numbers of the chunks only, at most ``MAX_CHUNK_COMPARISONS`` a pair.
    """
    left = exact.select("lf", "rf", F.col("left_page").alias("lpage")).distinct()
    right = exact.select("lf", "rf", F.col("right_page").alias("rpage")).distinct()
    open_ = verified.join(left, ["lf", "rf", "lpage"], "left_anti").join(right, ["lf", "rf", "rpage"], "left_anti")
    gathered = open_.groupBy("lf", "rf").agg(F.array_sort(F.collect_list(F.struct("rank", "lc", "rc"))).alias("all"))
    kind = "array<struct<rank:int,lc:int,rc:int>>"
    chosen = F.aggregate(
        F.col("all").cast(kind),
        F.expr(f"cast(array() as {kind})"),
        lambda acc, m: F.when(F.exists(acc, lambda x: (x["lc"] == m["lc"]) | (x["rc"] == m["rc"])), acc).otherwise(F.concat(acc, F.array(m))),
    )
    kept = gathered.select("lf", "rf", F.explode(chosen).alias("m")).select("lf", "rf", F.col("m.lc").alias("lc"), F.col("m.rc").alias("rc"))
    return open_.join(kept, ["lf", "rf", "lc", "rc"], "left_semi")


def with_texts(matched: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chosen matches with ``ltext, rtext``; what was only looked at needs no text."""
    side = lambda n: chunks.select(F.col("file").alias(f"{n}f"), F.col("chunk").alias(f"{n}c"), F.col("text").alias(f"{n}text"))
    return matched.join(side("l"), ["lf", "lc"]).join(side("r"), ["rf", "rc"])


def covered_chars(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, covered``: characters in the union of ``start, end`` on each ``page``."""
    before = W.partitionBy(*keys, "page").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    added = F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach))
    return intervals.where("end > start").withColumn("added", added).groupBy(*keys).agg(F.sum("added").cast("bigint").alias("covered"))


def text_scores(candidates: DataFrame, summaries: DataFrame, exact: DataFrame, matched: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``lf, rf, score, text_score, exact_page_match_count, approximate_text_match_count, matched_text_chars, matched_texts``."""
    zero = F.lit(0).cast("bigint")

    def side(page: str, exact_page: str, start: str, end: str) -> DataFrame:
        whole = exact.select("lf", "rf", F.col(exact_page).alias("page"), zero.alias("start"), F.col("char_count").alias("end"))
        return covered_chars(whole.unionByName(matched.select("lf", "rf", F.col(page).alias("page"), F.col(start).alias("start"), F.col(end).alias("end"))), ["lf", "rf"])

    left = side("lpage", "left_page", "lstart", "lend").withColumnRenamed("covered", "lcovered")
    right = side("rpage", "right_page", "rstart", "rend").withColumnRenamed("covered", "rcovered")
    counts = exact.groupBy("lf", "rf").agg(F.count(F.lit(1)).alias("exact_pages"))
    counts = counts.join(matched.groupBy("lf", "rf").agg(F.count(F.lit(1)).alias("approximate")), ["lf", "rf"], "full")
    # evidence: exact pages by page, then matches by rank; only so many of them are kept
    evidence = exact.select("lf", "rf", zero.alias("kind"), F.col("left_page").cast("bigint").alias("place"), "left_page", "right_page", F.lit(1.0).alias("similarity"), F.col("text").alias("left"), F.col("text").alias("right"))
    evidence = evidence.unionByName(
        matched.select(
            "lf", "rf", F.lit(1).cast("bigint").alias("kind"), F.col("rank").cast("bigint").alias("place"), F.col("lpage").alias("left_page"), F.col("rpage").alias("right_page"),
            F.least(F.lit(1.0), F.greatest("jaccard", "ratio")).alias("similarity"), F.col("ltext").alias("left"), F.col("rtext").alias("right"),
        )
    )
    first = evidence.withColumn("n", F.row_number().over(W.partitionBy("lf", "rf").orderBy("kind", "place"))).where(F.col("n") <= config.max_matches_per_pair)
    row = F.struct(
        "n", "left_page", "right_page", "similarity", (is_readable(F.col("left")) & is_readable(F.col("right"))).alias("text_readable"),
        preview(F.col("left")).alias("left_text"), preview(F.col("right")).alias("right_text"),
    )
    texts = first.groupBy("lf", "rf").agg(F.array_sort(F.collect_list(row)).alias("matched_texts"))
    chars = summaries.select("file", "total_text_chars")
    whole = candidates.join(left, ["lf", "rf"], "left").join(right, ["lf", "rf"], "left").join(counts, ["lf", "rf"], "left").join(texts, ["lf", "rf"], "left")
    whole = whole.join(chars.select(F.col("file").alias("lf"), F.col("total_text_chars").alias("lchars")), "lf").join(chars.select(F.col("file").alias("rf"), F.col("total_text_chars").alias("rchars")), "rf")
    covered, smaller = F.least(F.coalesce("lcovered", zero), F.coalesce("rcovered", zero)), F.least("lchars", "rchars")
    return whole.select(
        "lf", "rf", "score",
        F.when(smaller > 0, F.least(F.lit(1.0), covered / smaller)).otherwise(0.0).alias("text_score"),
        F.coalesce("exact_pages", zero).alias("exact_page_match_count"),
        F.coalesce("approximate", zero).alias("approximate_text_match_count"),
        covered.alias("matched_text_chars"),
        "matched_texts",
    )


def final_pairs(scored: DataFrame, image_matches: DataFrame | None, config: AnalysisConfig) -> DataFrame:
    """The pairs of the report, with the scores of text and images combined."""
    if image_matches is None:
        whole = scored.withColumn("image_score", F.lit(0.0)).withColumn("matched_images", F.lit(None))
        images, has_image = F.lit(0), F.lit(False)
    else:
        whole = scored.join(image_matches, ["lf", "rf"], "left").withColumn("image_score", F.coalesce("image_score", F.lit(0.0)))
        images = F.coalesce(F.size("matched_images"), F.lit(0))
        large = F.coalesce(F.exists("matched_images", lambda m: m["width"].cast("bigint") * m["height"] >= LARGE_IMAGE_AREA), F.lit(False))
        has_image = (images >= 2) | ((F.col("image_score") >= config.image_threshold) & large)
    has_text = F.coalesce(F.size("matched_texts"), F.lit(0)) > 0
    text, image = F.col("text_score"), F.col("image_score")
    final = F.when(has_text & has_image, F.greatest(text, 0.75 * text + 0.25 * image)).when(has_text, text).otherwise(image)
    found = whole.where(has_text | has_image).withColumn("final_score", final).withColumn("image_match_count", images)
    kept = found.where((F.col("final_score") >= MIN_FINAL) | (F.col("score") >= 1.0))
    return kept.select(
        F.concat_ws("-", F.lit("pair"), "lf", "rf").alias("pair_id"), "lf", "rf", "text_score", "image_score", F.lit(0.0).alias("page_image_score"), "final_score",
        level(F.col("final_score")).alias("level"), "exact_page_match_count", "approximate_text_match_count", "matched_text_chars",
        "image_match_count", "matched_texts", "matched_images",
    )
