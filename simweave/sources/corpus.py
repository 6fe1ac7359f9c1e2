"""The test tables as inputs of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simweave.functions.text import lines
from simweave.operators.images import phash_bits
from simweave.sources.tables import latest, table


#: Lines of a document that make a page.
PAGE_LINES = 8


def page_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """``file, page, text``: the current page texts."""
    pages = latest(table(spark, directory, "page_texts"), ["file_id", "page"], "extracted_at", ["text"])
    return pages.select(F.col("file_id").alias("file"), "page", F.coalesce("text", F.lit("")).alias("text"))


def document_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """``file, page, text``: every document as a file, ``PAGE_LINES`` lines to a page."""
    rows = table(spark, directory, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("file"), lines(F.coalesce("text", F.lit(""))).alias("lines"))
    count = F.ceil(F.size("lines") / PAGE_LINES).cast("int")
    pages = F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.array_join(F.slice("lines", p * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n"))
    return rows.select("file", F.posexplode(pages).alias("page", "text")).select("file", (F.col("page") + 1).alias("page"), "text")


def document_files(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("file"))


def evidence_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """``file, page, text``: the two sides of every pair in the matched texts, as files of as many pages as it has matches."""
    rows = table(spark, directory, "matched_texts").select("match_id", "pair_id", "left_text", "right_text").distinct()
    page = F.row_number().over(W.partitionBy("pair_id").orderBy("match_id"))
    sides = F.explode(F.create_map(F.lit("/left"), F.coalesce("left_text", F.lit("")), F.lit("/right"), F.coalesce("right_text", F.lit("")))).alias("side", "text")
    return rows.withColumn("page", page).select("pair_id", "page", sides).select(F.concat("pair_id", "side").alias("file"), "page", "text")


def evidence_files(spark: SparkSession, directory: str) -> DataFrame:
    pairs = table(spark, directory, "matched_texts").select("pair_id").distinct()
    return pairs.select(F.explode(F.array(F.concat("pair_id", F.lit("/left")), F.concat("pair_id", F.lit("/right")))).alias("file"))


def image_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """Images made from the embeddings: the vector as the 64 coefficients of a perceptual hash.

    Every fifth has a copy that differs in up to 8 bits, in one band or spread over all four;
    every seventh an exact copy; a small logo stands in half of the 40 files.
    """
    vectors = table(spark, directory, "embeddings").select("vec_id", phash_bits(F.transform("embedding", lambda x: x.cast("double"))).alias("phash"))
    v = F.col("vec_id")
    flipped = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: j < v % 9)
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.when(v % 2 == 0, j + 1).otherwise(16 * (j % 4) + 1 + F.floor(j / 4)).cast("int"))
    mask = F.aggregate(flipped, F.lit(0).cast("bigint"), lambda acc, j: acc.bitwiseXOR(bit(j)))
    side = lambda a, b: F.when(v % 2 == 0, a).otherwise(b)

    def rows(kind: int, file, sha, phash) -> list:
        return [
            F.concat(F.lit("pair-"), file % 40).alias("file"), (v * 4 + kind).alias("image"), F.lit(1).alias("page"), side(400, 80).alias("width"),
            side(300, 80).alias("height"), F.sha2(sha, 256).alias("sha256"), phash.alias("phash"),
        ]

    name = v.cast("string")
    originals = vectors.select(*rows(0, v, name, F.col("phash")))
    near = vectors.where(v % 5 == 0).select(*rows(1, v + 7, F.concat(F.lit("n"), name), F.col("phash").bitwiseXOR(mask)))
    exact = vectors.where(v % 7 == 0).select(*rows(2, v + 13, name, F.col("phash")))
    logo = spark.range(20).select(
        F.concat(F.lit("pair-"), "id").alias("file"), (F.col("id") * 4 + 3).alias("image"), F.lit(1).alias("page"), F.lit(80).alias("width"),
        F.lit(80).alias("height"), F.sha2(F.lit("logo"), 256).alias("sha256"), F.lit(0x1234).cast("bigint").alias("phash"),
    )
    return originals.unionByName(near).unionByName(exact).unionByName(logo)
