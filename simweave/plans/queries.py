"""One query for each operator of the pipeline, over the whole test tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.config import PRESETS
from simweave.functions.text import file_name, is_readable, normalize_text, preview, status
from simweave.operators import chunks as C
from simweave.operators import compare as X
from simweave.operators import groups as G
from simweave.operators import images as I
from simweave.plans.oracles import ORACLE_SQL
from simweave.plans.pipeline import Analysis
from simweave.sources.corpus import document_corpus, document_files, evidence_corpus, evidence_files, image_corpus, page_corpus
from simweave.sources.pdf import parse_pdfs, split_parsed
from simweave.sources.printed import printed_documents
from simweave.sources.tables import table
from simweave.storage import written

__all__ = ["ORACLE_SQL", "QUERIES"]


def analysis(spark: SparkSession, directory: str, preset: str = "balanced", images: bool = False) -> Analysis:
    """The sides of the matched pairs as files; with images, those of the embeddings as 40 more files."""
    pages, files = evidence_corpus(spark, directory), evidence_files(spark, directory)
    if not images:
        return Analysis(pages, files, PRESETS[preset])
    shown = image_corpus(spark, directory)
    return Analysis(pages, files.unionByName(shown.select("file").distinct()), PRESETS[preset], shown)


def document_analysis(spark: SparkSession, directory: str) -> Analysis:
    """Every document as a file."""
    return Analysis(document_corpus(spark, directory), document_files(spark, directory), PRESETS["balanced"])


def _rounded(df: DataFrame) -> DataFrame:
    """Scores to six digits: the last bits depend on the order of additions."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def normalize_lines(spark, d):
    return C.page_lines(page_corpus(spark, d))


def line_frequency(spark, d):
    return C.line_frequency(C.page_lines(page_corpus(spark, d)))


def clean_pages(spark, d):
    return C.clean_pages(page_corpus(spark, d))


def clean_documents(spark, d):
    return document_analysis(spark, d).clean


def previews(spark, d):
    rows = table(spark, d, "matched_texts").select("match_id", "left_text").distinct()
    text = F.col("left_text")
    return rows.select("match_id", is_readable(text).alias("readable"), preview(text).alias("shown"), normalize_text(text).alias("normal"))


def chunks(spark, d, corpus=analysis):
    return C.chunk_pages(corpus(spark, d).clean, PRESETS["balanced"])


def shingle_stats(spark, d):
    first = F.element_at("shingles", 1)
    return analysis(spark, d).shingled.select("file", "chunk", F.size("shingles").alias("shingles"), first.alias("least"), F.element_at("shingles", -1).alias("greatest"))


def sketch(spark, d, corpus=analysis):
    return corpus(spark, d).sketch


def posting_filter(spark, d, corpus=analysis):
    return corpus(spark, d).features


def chunk_pairs(spark, d, corpus=analysis):
    return _rounded(corpus(spark, d).chunk_pairs)


def candidate_evidence(spark, d):
    return _rounded(analysis(spark, d).evidence)


def text_candidates(preset: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(analysis(spark, d, preset).text_candidates)

    return query


def document_candidates(spark, d):
    return _rounded(document_analysis(spark, d).text_candidates)


def document_pairs(spark, d):
    return _flat(document_analysis(spark, d).pairs)


def topk_per_file(spark, d):
    """All scored pairs, and whether one of their files ranks them among its best."""
    a = analysis(spark, d)
    best = a.text_candidates.select("lf", "rf", F.lit(True).alias("kept"))
    return _rounded(a.scored.join(best, ["lf", "rf"], "left").select("lf", "rf", "score", F.coalesce("kept", F.lit(False)).alias("kept")))


def simhash(spark, d):
    return C.simhashes(analysis(spark, d).shingled)


def jaccard_verify(spark, d, corpus=analysis):
    return _rounded(corpus(spark, d).verified.select("lf", "lc", "rf", "rc", "shared", "same", "jaccard", "distance", "ratio"))


def exact_pages(spark, d):
    return analysis(spark, d).exact_pages.select("lf", "rf", "left_page", "right_page", "char_count")


def greedy_chunk_matches(spark, d):
    return analysis(spark, d).matched.select("lf", "lc", "rf", "rc")


def coverage(spark, d):
    m = analysis(spark, d).matched.select("lf", "rf", F.col("lpage").alias("page"), F.col("lstart").alias("start"), F.col("lend").alias("end"))
    return X.covered_chars(m, ["lf", "rf"])


def _flat(pairs: DataFrame) -> DataFrame:
    return _rounded(pairs.withColumn("text_evidence", F.coalesce(F.size("matched_texts"), F.lit(0))).drop("matched_texts", "matched_images"))


def pairs_text(spark, d):
    return _flat(analysis(spark, d).pairs)


def pairs_full(spark, d):
    return _flat(analysis(spark, d, images=True).pairs)


def text_evidence(spark, d):
    rows = analysis(spark, d).pairs.select("pair_id", F.explode("matched_texts").alias("m")).select("pair_id", "m.*")
    return _rounded(rows)


def image_phash_bits(spark, d):
    return image_corpus(spark, d).select("file", "image", F.lpad(F.lower(F.hex("phash")), 16, "0").alias("phash"), "sha256", "width", "height")


def _images(spark, d) -> DataFrame:
    return I.usable_images(image_corpus(spark, d))


def image_common(spark, d):
    # in a corpus of the 40 files that have images
    return I.common_images(_images(spark, d), 40)


def image_exact_candidates(spark, d):
    return I.exact_image_candidates(_images(spark, d), 40)


def image_band_candidates(spark, d):
    return _rounded(I.band_image_candidates(_images(spark, d), 40, PRESETS["balanced"]))


def _image_matches(spark, d) -> DataFrame:
    images, config = _images(spark, d), PRESETS["balanced"]
    return I.match_images(I.image_candidates(images, 40, config), images, 40, config)


def image_match(spark, d):
    return _rounded(_image_matches(spark, d).select("lf", "rf", "image_score", F.size("matched_images").alias("matches")))


def merge_candidates(spark, d):
    return _rounded(analysis(spark, d, images=True).candidates)


def components(spark, d):
    a = analysis(spark, d)
    return G.components(G.strong_pairs(a.pairs, a.config))


def groups(spark, d, corpus=analysis):
    found = corpus(spark, d).groups
    return _rounded(found.select("group_id", "files", "edges", "graph_density", "group_score", "level", "evidence_type", F.array_join("file_ids", ",").alias("file_ids"), F.array_join("quality_flags", ",").alias("flags")))


def group_relations(spark, d):
    return _rounded(analysis(spark, d).relations.select("root", "lf", "rf", "final_score", "text_score", "exact_page_match_count"))


def group_exact_pages(spark, d):
    return analysis(spark, d).relations.groupBy("root").agg(F.sum("exact_page_match_count").cast("bigint").alias("exact_pages"))


def pairs_over_threshold(spark, d):
    """Pairs of the report table at or above the slider, best first."""
    pairs = table(spark, d, "similarity_pairs").distinct().where("final_score >= 0.6 AND NOT isnan(final_score)")
    return pairs.select("pair_id", "scored_at", "final_score").orderBy(F.desc("final_score"), "pair_id", "scored_at")


def run_totals(spark, d):
    return analysis(spark, d).run_totals()


def report_totals(spark, d):
    """Files by whether they could be read, over the distinct rows of the files table."""
    status = F.lower(F.trim("status"))
    ready = status.isin("ready", "cid-fallback", "image-only")
    files = table(spark, d, "files").where("id IS NOT NULL").groupBy("id").agg(F.max(status).alias("status"), F.max("image_count").alias("image_count"))
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("status").isin("ready", "cid-fallback", "image-only")).alias("ready_files"),
        F.count_if(~F.coalesce(F.col("status").isin("ready", "cid-fallback", "image-only"), F.lit(False))).alias("failed_files"), F.sum("image_count").alias("images"),
    )


def _printed(spark, d):
    files, pages, images = split_parsed(written(parse_pdfs(printed_documents(table(spark, d, "documents"))), "printed"))
    return files, pages.withColumn("text", F.regexp_replace("text", "\n$", "")), images  # the end of the last line is no content


def pdf_files(spark, d):
    """Every document printed as a PDF file and read again: its status and counts."""
    files, pages, images = _printed(spark, d)
    per_file = pages.groupBy("file").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"))
    rows = files.join(per_file, "file")
    return rows.select("file", file_name(F.col("file")).alias("name"), "pages", "chars", "image_count", "indexed_image_count", status(F.col("chars"), F.col("image_count"), F.col("glyph_fallback")).alias("status"), "error")


def pdf_pages(spark, d):
    return _printed(spark, d)[1]


def pdf_images(spark, d):
    return _printed(spark, d)[2].select("file", "image", "page", "width", "height", "sha256")


def pages_over_threshold(spark, d):
    """Totals of the report table over the distinct pairs at or above the slider."""
    return pairs_over_threshold(spark, d).join(table(spark, d, "similarity_pairs").distinct(), ["pair_id", "scored_at", "final_score"]).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("exact_page_match_count").alias("exact_pages"), F.sum("approximate_text_match_count").alias("approximate_matches"), F.sum("matched_text_chars").alias("chars")
    )


def group_members(spark, d):
    return analysis(spark, d).members


def pair_paths(spark, d):
    """Current paths of both files of every distinct pair; null for files without a row."""
    paths = table(spark, d, "files").where("id IS NOT NULL").groupBy("id").agg(F.max("path").alias("path"))
    paths = written(paths, "paths")
    pairs = table(spark, d, "similarity_pairs").select("pair_id", "left_file_id", "right_file_id").distinct()
    left, right = (paths.select(F.col("id").alias(f"{s}_file_id"), F.col("path").alias(f"{s}_path")) for s in ("left", "right"))
    return pairs.join(left, "left_file_id", "left").join(right, "right_file_id", "left").select("pair_id", "left_file_id", "left_path", "right_file_id", "right_path")


def files_summary(spark, d):
    return analysis(spark, d).summaries


def of_documents(query):
    """A query of a stage, on the documents in place of the matched texts."""
    return partial(query, corpus=document_analysis)


QUERIES = {
    "q_normalize_lines": normalize_lines,
    "q_line_frequency": line_frequency,
    "q_clean_pages": clean_pages,
    "q_clean_documents": clean_documents,
    "q_previews": previews,
    "q_chunks": chunks,
    "q_shingle_stats": shingle_stats,
    "q_sketch": sketch,
    "q_posting_filter": posting_filter,
    "q_chunk_pairs": chunk_pairs,
    "q_candidate_evidence": candidate_evidence,
    "q_text_candidates": text_candidates("balanced"),
    "q_text_candidates_fast": text_candidates("fast"),
    "q_text_candidates_deep": text_candidates("deep"),
    "q_text_candidates_exhaustive": text_candidates("exhaustive"),
    "q_document_candidates": document_candidates,
    "q_document_pairs": document_pairs,
    "q_document_chunks": of_documents(chunks),
    "q_document_sketch": of_documents(sketch),
    "q_document_posting_filter": of_documents(posting_filter),
    "q_document_chunk_pairs": of_documents(chunk_pairs),
    "q_document_verify": of_documents(jaccard_verify),
    "q_document_groups": of_documents(groups),
    "q_topk_per_file": topk_per_file,
    "q_simhash": simhash,
    "q_jaccard_verify": jaccard_verify,
    "q_exact_pages": exact_pages,
    "q_greedy_chunk_matches": greedy_chunk_matches,
    "q_coverage": coverage,
    "q_pairs_text": pairs_text,
    "q_text_evidence": text_evidence,
    "q_image_phash_bits": image_phash_bits,
    "q_image_common": image_common,
    "q_image_exact_candidates": image_exact_candidates,
    "q_image_band_candidates": image_band_candidates,
    "q_image_match": image_match,
    "q_merge_candidates": merge_candidates,
    "q_pairs_full": pairs_full,
    "q_components": components,
    "q_groups": groups,
    "q_group_relations": group_relations,
    "q_group_exact_pages": group_exact_pages,
    "q_run_totals": run_totals,
    "q_report_totals": report_totals,
    "q_pairs_over_threshold": pairs_over_threshold,
    "q_files_summary": files_summary,
    "q_group_members": group_members,
    "q_totals_over_threshold": pages_over_threshold,
    "q_pair_paths": pair_paths,
    "q_pdf_files": pdf_files,
    "q_pdf_pages": pdf_pages,
    "q_pdf_images": pdf_images,
}
