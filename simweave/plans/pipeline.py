"""A whole analysis: pages and images in, files, pairs and groups out.

Stages that several others read are written once to the shared folder, so nothing is computed
twice and a lost executor costs its running tasks only. The only values that come to the
driver on the way are the number of files and whether the groups have settled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.config import AnalysisConfig
from simweave.operators import chunks as C
from simweave.operators import compare as X
from simweave.operators import groups as G
from simweave.operators import images as I
from simweave.operators import recall as R
from simweave.storage import written


@dataclass
class Analysis:
    """The stages of one analysis, each computed when it is first asked for.

    ``pages``: ``file, page, text``; ``files``: ``file`` of every input, failed ones too;
    ``images``: see :mod:`simweave.operators.images`, or None.
    """

    pages: DataFrame
    files: DataFrame
    config: AnalysisConfig
    images: DataFrame | None = None

    @cached_property
    def file_count(self) -> int:
        return self.files.select("file").distinct().count()

    @cached_property
    def clean(self) -> DataFrame:
        return written(C.clean_pages(self.pages), "clean")

    @cached_property
    def chunks(self) -> DataFrame:
        return written(C.chunk_pages(self.clean, self.config), "chunks")

    @property
    def shingled(self) -> DataFrame:
        """The chunks with their shingles, which are eight times as large as the text and are made anew where they are needed."""
        return C.with_shingles(self.chunks, self.config)

    @cached_property
    def summaries(self) -> DataFrame:
        return C.file_summaries(self.files, self.clean, self.chunks)

    @cached_property
    def sketch(self) -> DataFrame:
        return C.sketches(self.shingled)

    @cached_property
    def features(self) -> DataFrame:
        # at rest, so that adaptive execution can split the postings of a hash that is no feature
        return written(R.features(self.sketch, self.file_count), "features")

    @cached_property
    def chunk_pairs(self) -> DataFrame:
        return written(R.chunk_pairs(self.sketch, self.features, self.file_count), "chunk-pairs")

    @cached_property
    def evidence(self) -> DataFrame:
        return R.candidate_evidence(self.chunk_pairs, self.config)

    @cached_property
    def scored(self) -> DataFrame:
        return R.scored_candidates(self.evidence, R.chunk_counts(self.chunks), self.config)

    @cached_property
    def text_candidates(self) -> DataFrame:
        return written(R.top_candidates(self.scored, self.config), "text-candidates")

    @cached_property
    def usable_images(self) -> DataFrame:
        return written(I.usable_images(self.images), "images")

    @cached_property
    def candidates(self) -> DataFrame:
        if self.images is None:
            return self.text_candidates
        return written(I.merge_candidates(self.text_candidates, I.image_candidates(self.usable_images, self.file_count, self.config)), "candidates")

    @cached_property
    def exact_pages(self) -> DataFrame:
        return written(X.exact_pages(self.candidates, self.clean), "exact-pages")

    @cached_property
    def verified(self) -> DataFrame:
        # text evidence of pairs that only images brought in comes from exact pages alone
        ranked = X.ranked_chunk_pairs(self.text_candidates, self.chunk_pairs, self.config)
        met = ranked.select(F.explode(F.array(F.struct(F.col("lf").alias("file"), F.col("lc").alias("chunk")), F.struct(F.col("rf").alias("file"), F.col("rc").alias("chunk")))).alias("x"))
        needed = self.chunks.join(met.select("x.file", "x.chunk").distinct(), ["file", "chunk"], "left_semi")
        needed = C.with_shingles(needed, self.config)
        return written(X.verified_chunk_pairs(ranked, needed, C.simhashes(needed), self.config), "verified")

    @cached_property
    def matched(self) -> DataFrame:
        return written(X.with_texts(X.greedy_chunk_matches(self.verified, self.exact_pages), self.chunks), "matched")

    @cached_property
    def image_matches(self) -> DataFrame | None:
        return None if self.images is None else I.match_images(self.candidates, self.usable_images, self.file_count, self.config)

    @cached_property
    def pairs(self) -> DataFrame:
        scored = X.text_scores(self.candidates, self.summaries, self.exact_pages, self.matched, self.config)
        return written(X.final_pairs(scored, self.image_matches, self.config), "pairs")

    @cached_property
    def relations(self) -> DataFrame:
        return written(G.group_relations(self.pairs, self.config), "relations")

    @property
    def members(self) -> DataFrame:
        return G.group_members(self.relations)

    @cached_property
    def groups(self) -> DataFrame:
        return G.group_table(self.relations)

    def run_totals(self) -> DataFrame:
        """One row: candidates, pairs, matches, groups and weak groups."""
        pairs = self.pairs.agg(
            F.count(F.lit(1)).alias("confirmed_pairs"),
            F.coalesce(F.sum(F.size("matched_texts")), F.lit(0)).alias("confirmed_text_matches"),
            F.coalesce(F.sum("image_match_count"), F.lit(0)).cast("bigint").alias("confirmed_image_matches"),
        )
        groups = self.groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.size("quality_flags") > 0).alias("weak_groups"))
        return self.candidates.agg(F.count(F.lit(1)).alias("candidate_pairs")).crossJoin(pairs).crossJoin(groups)  # one row each


STAGES: tuple[tuple[str, str], ...] = (
    ("BuildingTextIndex", "chunk_pairs"),
    ("RecallingCandidates", "candidates"),
    ("ComparingText", "pairs"),
    ("GeneratingReport", "relations"),
)


def run(analysis: Analysis, on_stage: Callable[[str], None] | None = None, cancelled: Callable[[], bool] | None = None) -> Analysis:
    """Compute all stages, telling which one begins. Between stages it may be cancelled; what is done stays."""
    for name, stage in STAGES:
        if cancelled and cancelled():
            break
        if on_stage:
            on_stage(name)
        getattr(analysis, stage)
    return analysis
