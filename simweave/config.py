"""Parameters of an analysis: presets, validation and the fixed limits of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Fixed values of the pipeline.
SKETCH_SIZE = 220  # hashes kept of a chunk for recall
MAX_POSTING = 180  # chunks that may share a feature
MAX_FEATURE_FILES = 10  # files that may share a feature
MAX_CHUNK_COMPARISONS = 2000  # verified chunk pairs of a file pair
STRONG_SHARED = 16  # shared hashes that make one chunk pair enough evidence
LOCAL_SHARED = 64  # shared hashes that make a pair a candidate whatever its score
SHARED_RATIO = 0.55  # least ratio of shared hashes for a match by fingerprint
MIN_FINAL = 0.03  # pairs below it are dropped, unless an image is the same
HEADER_CHARS = 120  # longest line that counts as a repeated header or footer
HEADER_PAGES = 4  # least number of pages it repeats on
PREVIEW_CHARS = 360
MIN_IMAGE_SIDE, MIN_IMAGE_AREA = 48, 4096
MAX_IMAGE_POSTING, MAX_IMAGE_MATCHES = 160, 30
LARGE_IMAGE_AREA = 100_000  # from it an image is never too common
MAX_IMAGE_WEIGHT = 2_000_000
CID_BASE = 0xF0000  # where glyph numbers without a mapping are put
KEPT_TASKS = 20


@dataclass(frozen=True)
class AnalysisConfig:
    """All parameters of a run; the defaults are the preset ``balanced``."""

    paths: tuple[str, ...] = ()
    analysis_depth: str = "balanced"
    text_threshold: float = 0.72
    image_threshold: float = 0.80
    final_threshold: float = 0.50
    min_chunk_chars: int = 80
    target_chunk_chars: int = 500
    chunk_overlap_chars: int = 80
    shingle_size: int = 5
    min_shared_shingles: int = 3
    simhash_hamming_threshold: int = 4
    candidate_score_threshold: float = 0.35
    candidate_top_k_per_file: int = 20
    max_matches_per_pair: int = 30

    @classmethod
    def preset(cls, depth: str, **changes) -> AnalysisConfig:
        return replace(PRESETS[depth], **changes)

    @classmethod
    def from_request(cls, request: dict) -> AnalysisConfig:
        """A request as read from JSON; every field must be there."""
        missing = [f.name for f in fields(cls) if f.name not in request]
        if missing:
            raise ValueError(f"missing fields: {missing}")
        return cls(**{f.name: request[f.name] for f in fields(cls)} | {"paths": tuple(request["paths"])})

    def validate(self, paths: bool = True) -> AnalysisConfig:
        rules = [
            (not paths or len(self.paths) >= 2, "at least two files are needed"),
            (all(0 <= x <= 1 for x in (self.text_threshold, self.image_threshold, self.final_threshold)), "thresholds lie between 0 and 1"),
            (self.min_chunk_chars >= 30, "min_chunk_chars is at least 30"),
            (self.target_chunk_chars >= self.min_chunk_chars, "target_chunk_chars is at least min_chunk_chars"),
            (0 <= self.chunk_overlap_chars < self.target_chunk_chars, "chunk_overlap_chars is less than target_chunk_chars"),
            (3 <= self.shingle_size <= 12, "shingle_size lies between 3 and 12"),
            (self.min_shared_shingles > 0, "min_shared_shingles is positive"),
            (self.candidate_top_k_per_file > 0, "candidate_top_k_per_file is positive"),
            (self.max_matches_per_pair > 0, "max_matches_per_pair is positive"),
        ]
        for holds, message in rules:
            if not holds:
                raise ValueError(message)
        return self

    @property
    def phash_distance(self) -> int:
        """The most differing bits of two similar images."""
        # halves are rounded away from zero
        return min(max(int((1 - self.image_threshold) * 32 + 0.5), 2), 10)


# Fast, balanced, deep, exhaustive.
PRESETS = {
    "balanced": AnalysisConfig(),
    "fast": AnalysisConfig((), "fast", 0.78, 0.80, 0.56, 120, 620, 70, 6, 4, 3, 0.42, 12, 24),
    "deep": AnalysisConfig((), "deep", 0.68, 0.80, 0.45, 60, 420, 120, 4, 2, 6, 0.24, 36, 60),
    "exhaustive": AnalysisConfig((), "exhaustive", 0.62, 0.78, 0.40, 40, 320, 160, 3, 1, 8, 0.16, 64, 100),
}


def feature_file_cap(files: int) -> int:
    """In how many files a text feature or image may occur before it is too common."""
    return min((files + 1) // 2, MAX_FEATURE_FILES) if files >= 4 else min(files, MAX_FEATURE_FILES)
