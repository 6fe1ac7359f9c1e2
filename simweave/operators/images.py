"""Images: candidates by content hash and perceptual hash, and their one-to-one matching.

Images come as ``file, image, page, width, height, sha256, phash``; ``phash`` is a 64-bit
pattern in a BIGINT and may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simweave.config import LARGE_IMAGE_AREA, MAX_IMAGE_MATCHES, MAX_IMAGE_POSTING, MAX_IMAGE_WEIGHT, MIN_IMAGE_AREA, MIN_IMAGE_SIDE, AnalysisConfig, feature_file_cap
from simweave.functions.text import hamming


def usable_images(images: DataFrame) -> DataFrame:
    """Without images too small to mean anything."""
    return images.where((F.col("width") >= MIN_IMAGE_SIDE) & (F.col("height") >= MIN_IMAGE_SIDE) & (area() >= MIN_IMAGE_AREA))


def area() -> Column:
    return F.col("width").cast("bigint") * F.col("height")


def phash_bits(coefficients: Column) -> Column:
    """The pattern of 64 low-frequency coefficients: bit i is set if the i-th is at least the median; bit 0 never is."""
    rest = F.slice(coefficients, 2, 63)
    median = F.element_at(F.array_sort(rest), 32)
    bits = F.transform(rest, lambda c, i: F.when(c >= median, F.call_function("shiftleft", F.lit(1).cast("bigint"), (i + 1).cast("int"))).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def image_identity(width: Column, height: Column, content: Column) -> Column:
    """SHA-256 over both sides as four bytes each and the stored content, in hex."""
    side = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    return F.sha2(F.concat(side(width), side(height), content), 256)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def common_images(images: DataFrame, files: int) -> DataFrame:
    """``sha256`` of small images that occur in too many files."""
    grouped = images.groupBy("sha256").agg(F.max(area()).alias("largest"), F.count_distinct("file").alias("df"))
    return grouped.where(_too_common(files)).select("sha256")


def _too_common(files: int) -> Column:
    return F.lit(False) if files < 4 else (F.col("largest") < LARGE_IMAGE_AREA) & (F.col("df") > feature_file_cap(files))


def exact_image_candidates(images: DataFrame, files: int) -> DataFrame:
    """``lf, rf, score``: files with the same image, score 1."""
    posted = images.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.max(area()).alias("largest"), F.count_distinct("file").alias("df"))
    kept = posted.where((F.col("n") <= MAX_IMAGE_POSTING) & (F.col("df") > 1) & ~_too_common(files)).select("sha256")
    one = images.join(kept, "sha256").select("sha256", "file").distinct()
    left, right = one.withColumnRenamed("file", "lf"), one.withColumnRenamed("file", "rf")
    return left.join(right, "sha256").where("lf < rf").select("lf", "rf").distinct().withColumn("score", F.lit(1.0))


def band_image_candidates(images: DataFrame, files: int, config: AnalysisConfig) -> DataFrame:
    """``lf, rf, score``: files with similar images, found through 16-bit bands of the perceptual hash.

    Pairs that differ in all four bands are not found here, by design; lists beyond the bounds
    are skipped, so no band makes a skewed join.
    """
    shown = images.where("phash IS NOT NULL").join(common_images(images, files), "sha256", "left_anti")
    bands = shown.select("file", "image", "phash", area().alias("area"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("band"))
    key = F.call_function("shiftrightunsigned", "phash", F.col("band") * 16).bitwiseAND(F.lit(65535)).alias("bits")
    bands = bands.select("file", "phash", "area", "band", key)
    posted = bands.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n"), F.max("area").alias("largest"), F.count_distinct("file").alias("df"))
    kept = bands.join(posted.where((F.col("n") <= MAX_IMAGE_POSTING) & (F.col("df") > 1) & ~_too_common(files)).select("band", "bits"), ["band", "bits"])
    left = kept.select("band", "bits", F.col("file").alias("lf"), F.col("phash").alias("lp"))
    right = kept.select("band", "bits", F.col("file").alias("rf"), F.col("phash").alias("rp"))
    distance = hamming(F.col("lp"), F.col("rp"))
    near = left.join(right, ["band", "bits"]).where((F.col("lf") < F.col("rf")) & (distance <= config.phash_distance))
    return near.groupBy("lf", "rf").agg((1 - F.min(distance) / 64).alias("score"))


def image_candidates(images: DataFrame, files: int, config: AnalysisConfig) -> DataFrame:
    both = exact_image_candidates(images, files).unionByName(band_image_candidates(images, files, config))
    return both.groupBy("lf", "rf").agg(F.max("score").alias("score"))


def merge_candidates(text: DataFrame, image: DataFrame) -> DataFrame:
    """The better score of either kind; image candidates are not bound by the best per file."""
    return text.unionByName(image).groupBy("lf", "rf").agg(F.max("score").alias("score"))


def match_images(candidates: DataFrame, images: DataFrame, files: int, config: AnalysisConfig) -> DataFrame:
    """``lf, rf, image_score, matched_images``: one-to-one matches of each candidate pair.

    All pairs of their images are looked at, exact ones first, then by distance and weight; an
    image is used once. The score is the matched share of the smaller side, common images aside.
    """
    shown = images.join(common_images(images, files), "sha256", "left_anti")
    side = lambda n: shown.select(
        F.col("file").alias(f"{n}f"), F.col("image").alias(f"{n}i"), F.col("page").alias(f"{n}page"), F.col("width").alias(f"{n}w"),
        F.col("height").alias(f"{n}h"), F.col("sha256").alias(f"{n}sha"), F.col("phash").alias(f"{n}p"),
    )
    left, right = side("l"), side("r")
    exact = F.col("lsha") == F.col("rsha")
    distance = hamming(F.col("lp"), F.col("rp"))
    pairs = candidates.select("lf", "rf").join(left, "lf").join(right, "rf").where(exact | (distance <= config.phash_distance))
    weight = lambda n: F.least(F.col(f"{n}w").cast("bigint") * F.col(f"{n}h"), F.lit(MAX_IMAGE_WEIGHT))
    match = F.struct(
        (~exact).alias("inexact"),
        F.when(exact, 0).otherwise(distance).cast("int").alias("distance"),
        (-F.least(weight("l"), weight("r"))).alias("minus_weight"),
        "li", "ri", "lpage", "rpage",
        F.least("lw", "rw").alias("width"), F.least("lh", "rh").alias("height"),
    )
    kind = "struct<inexact:boolean,distance:int,minus_weight:bigint,li:bigint,ri:bigint,lpage:int,rpage:int,width:int,height:int>"
    found = pairs.groupBy("lf", "rf").agg(F.array_sort(F.collect_list(match.cast(kind))).alias("all"))
    start = F.expr(f"cast(array() as array<{kind}>)")
    chosen = F.aggregate(
        "all",
        start,
        lambda acc, m: F.when(F.exists(acc, lambda x: (x["li"] == m["li"]) | (x["ri"] == m["ri"])), acc).otherwise(F.concat(acc, F.array(m))),
    )
    chosen = found.select("lf", "rf", chosen.alias("chosen"))
    totals = shown.groupBy("file").agg(F.sum(F.least(area(), F.lit(MAX_IMAGE_WEIGHT))).alias("total"))
    whole = chosen.join(totals.select(F.col("file").alias("lf"), F.col("total").alias("lt")), "lf").join(totals.select(F.col("file").alias("rf"), F.col("total").alias("rt")), "rf")
    matched = F.aggregate("chosen", F.lit(0).cast("bigint"), lambda a, m: a - m["minus_weight"])
    smaller = F.least("lt", "rt")
    evidence = F.transform(
        F.slice("chosen", 1, MAX_IMAGE_MATCHES),
        lambda m: F.struct(
            m["lpage"].alias("left_page"), m["rpage"].alias("right_page"), m["distance"].alias("hamming_distance"),
            F.when(~m["inexact"], 1.0).otherwise(1 - m["distance"] / 64).alias("similarity"), (~m["inexact"]).alias("exact"),
            m["width"].alias("width"), m["height"].alias("height"),
        ),
    )
    return whole.select("lf", "rf", F.when(smaller > 0, F.least(F.lit(1.0), matched / smaller)).otherwise(0.0).alias("image_score"), evidence.alias("matched_images"))
