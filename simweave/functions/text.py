"""Text and hash functions over columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from simweave.config import PREVIEW_CHARS

# The letters that normalisation keeps beside ASCII ones and digits (ideographs
# and private glyph numbers), and Unicode white space.
KEPT = r"A-Za-z0-9\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{323af}\x{f0000}-\x{fffff}"
LINE_SPACE = r"\t\x{0b}\x{0c}\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = r"\n" + LINE_SPACE
GLYPHS = r"[\x{f0000}-\x{fffff}]"
UNREADABLE = "[no readable text: the glyphs have no mapping to characters]"


def normalize_text(text: Column) -> Column:
    """ASCII letters in lower case, digits, ideographs and glyph numbers; white space as single blanks.

    Everything else is deleted without leaving a gap. Lower case comes after the deletion, so
    that no other letter turns into an ASCII one.
    """
    kept = F.regexp_replace(text, f"[^{KEPT}{SPACE}]+", "")
    return F.trim(F.regexp_replace(F.lower(kept), f"[{SPACE}]+", " "))


def normal_lines(text: Column) -> Column:
    """The lines of a text, each as :func:`normalize_text` makes it, by two passes over the whole text."""
    kept = F.lower(F.regexp_replace(text, f"[^{KEPT}{SPACE}]+", ""))
    return F.split(F.trim(F.regexp_replace(kept, f"[{LINE_SPACE}]+", " ")), " ?\n ?")


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def is_readable(text: Column) -> Column:
    return ~text.rlike(GLYPHS)


def preview(text: Column) -> Column:
    cut = F.concat(F.substring(text, 1, PREVIEW_CHARS), F.lit("..."))
    return F.when(~is_readable(text), F.lit(UNREADABLE)).when(F.length(text) > PREVIEW_CHARS, cut).otherwise(text)


def hash60(text: Column) -> Column:
    """A non-negative 60-bit hash that any engine with MD5 can compute."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


# The modulus of the gram hash, and the generators of the multipliers of its two halves.
GRAM_MODULUS, GRAM_GENERATORS = 4294967291, (16807, 48271)


def gram_multipliers(k: int) -> tuple[list[int], list[int]]:
    """For each half of the hash the multipliers of the ``k`` characters of a gram."""
    one, two = ([pow(g, 5 * j + 7, GRAM_MODULUS) for j in range(k)] for g in GRAM_GENERATORS)
    return one, two


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` code points: two halves, each a weighted sum of the code points.

    It is linear, so that whole texts are hashed by a few vector operations, and any engine with
    64-bit integers can compute it.
    """
    n = max(0, len(codes) - k + 1)
    halves = []
    for multipliers in gram_multipliers(k):
        total = np.zeros(n, dtype=np.int64)
        for j, m in enumerate(multipliers):
            total += codes[j : j + n].astype(np.int64) * m  # 21 bits times 32 bits, at most 12 times
        halves.append(total % GRAM_MODULUS)
    return (halves[0] - (1 << 31)) * (1 << 32) + halves[1]


def level(score: Column) -> Column:
    return F.when(score >= 0.85, "Extreme").when(score >= 0.70, "High").when(score >= 0.50, "Medium").otherwise("Low")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def status(chars: Column, images: Column, glyph_fallback: Column) -> Column:
    return (
        F.when((chars == 0) & (images > 0), "image-only").when(chars == 0, "text-empty").when(glyph_fallback, "cid-fallback").otherwise("ready")
    )
