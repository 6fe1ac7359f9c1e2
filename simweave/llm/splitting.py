"""Splitting oversized texts at natural boundaries.

A recursive hierarchy of separators (section, paragraph, sentence, word, character): a piece
is packed greedily up to the limit and ends at the last boundary of the coarsest kind that leaves
it at least half of the new text it has room for; where there is none, at the last boundary of
the coarsest kind that leaves it any. The next piece starts ``overlap`` characters before that end.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coarse to fine. A boundary is the end of a match, so separators stay with the piece before.
LEVELS = (
    # section: form feed, two blank lines, a rule line, or just before a heading line
    regex.compile(r"\f+|\r?\n(?:[ \t]*\r?\n){2,}|\n[ \t]*[-=_*]{3,}[ \t]*\r?\n|\r?\n(?=#{1,6} \S)|\r?\n(?=第[一二三四五六七八九十百0-9]+[章节部])"),
    # paragraph: a blank line
    regex.compile(r"\r?\n[ \t]*\r?\n\s*"),
    # sentence: an end mark with its closing marks, then white space; in CJK none is needed
    regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？；][”’」』）】]*\s*"),
    # word: white space, or a CJK comma
    regex.compile(r"\s+|[，、：]"),
)


def split_spans(text: str, target: int | None, overlap: int | None) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text`` in code points.

    Empty text has no piece. A target that is null or below 1 leaves the text whole; an overlap
    that is null or negative is 0, and one of ``target`` or more is ``target - 1``.
    """
    n = len(text)
    if not n:
        return []
    if target is None or target < 1 or n <= target:
        return [(0, n)]
    overlap = min(max(overlap or 0, 0), target - 1)
    found: list[list[int] | None] = [None] * len(LEVELS)
    spans, start = [], 0
    while n - start > target:
        low, high = start + overlap + 1, start + target
        end, lasts = 0, []
        for level, pattern in enumerate(LEVELS):
            if found[level] is None:
                found[level] = [m.end() for m in pattern.finditer(text)]
            ends = found[level]
            at = bisect_right(ends, high)
            lasts.append(ends[at - 1] if at else 0)
            if lasts[-1] >= start + overlap + (target - overlap + 1) // 2:
                end = lasts[-1]
                break
        else:
            end = next((e for e in lasts if e >= low), 0)
        if not end:
            end = high
            # a cut between characters stays out of a line end and before no combining mark
            while end > low and (unicodedata.combining(text[end]) or text[end - 1 : end + 1] == "\r\n"):
                end -= 1
        spans.append((start, end))
        start = end - overlap
    spans.append((start, n))
    return spans


def split_oversized(df: DataFrame, keys: list[str], text: str, target: str, overlap: str) -> DataFrame:
    """``keys..., piece, start, end, pieces``: the pieces of every row's ``text``.

    ``target`` and ``overlap`` name columns, so each row may have its own limit. Pieces are
    numbered from 0; ``pieces`` is the row's number of pieces; ``end`` is exclusive. A null or
    empty text has no piece, repeated rows are split as often as they occur. Columns of ``df``
    other than the named ones are not read, so their names do not matter; keys must not be
    called like an output column.

    A narrow operation: no shuffle, one row in memory at a time beyond its Arrow batch.
    """
    clash = {"piece", "start", "end", "pieces"} & set(keys)
    if clash:
        raise ValueError(f"keys named like output columns: {sorted(clash)}")
    rows = df.select(
        *keys,
        F.col(text).cast("string").alias("_text"),
        F.col(target).cast("bigint").alias("_target"),
        F.col(overlap).cast("bigint").alias("_overlap"),
    )
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys] + ["piece INT, start BIGINT, `end` BIGINT, pieces INT"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, end, pieces = [], [], [], [], []
            limits = zip(batch.column("_text"), batch.column("_target").to_pylist(), batch.column("_overlap").to_pylist(), strict=True)
            for i, (value, t, o) in enumerate(limits):
                spans = split_spans(value.as_py() or "", t, o)
                at += [i] * len(spans)
                piece += range(len(spans))
                start += [s for s, _ in spans]
                end += [e for _, e in spans]
                pieces += [len(spans)] * len(spans)
            kept = [batch.column(k).take(pa.array(at, pa.int32())) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(pieces, pa.int32())],
                names=[*keys, "piece", "start", "end", "pieces"],
            )

    return rows.mapInArrow(run, schema)


def boundary_kind(text: str, end: int) -> int:
    """The level (index in ``LEVELS``) of the coarsest boundary at ``end``, or ``len(LEVELS)``."""
    for level, pattern in enumerate(LEVELS):
        ends = [m.end() for m in pattern.finditer(text)]
        at = bisect_left(ends, end)
        if at < len(ends) and ends[at] == end:
            return level
    return len(LEVELS)
