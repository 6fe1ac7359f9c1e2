"""From page texts to chunks with their shingle hashes.

Pages come as ``file, page, text``. A file is known by its id, a string; where an order of
files matters it is that of the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simweave.config import HEADER_CHARS, HEADER_PAGES, SKETCH_SIZE, AnalysisConfig
from simweave.functions.text import gram_hashes, hash60, normal_lines
from simweave.storage import written


def page_lines(pages: DataFrame) -> DataFrame:
    """``file, page, line_no, line``: the normalised lines that are not empty."""
    return pages.select("file", "page", F.posexplode(normal_lines(F.col("text"))).alias("line_no", "line")).where("line <> ''")


def line_frequency(page_line: DataFrame) -> DataFrame:
    """``file, line, pages``: on how many pages of its file a line stands."""
    return page_line.groupBy("file", "line").agg(F.count_distinct("page").alias("pages"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """``file, page, text, char_count`` without repeated headers and footers; every page stays.

    A page has one row. Lines are normalised once and stay with their page: only those short
    enough to be headers are counted, in files of at least ``HEADER_PAGES`` pages, as no line of
    others can repeat often enough; the repeated lines of a file then meet its pages.
    """
    normal = written(pages.select("file", "page", normal_lines(F.col("text")).alias("lines")), "lines")
    least = F.greatest(F.lit(HEADER_PAGES), F.expr("count(1) div 20")).alias("least")
    limits = normal.groupBy("file").agg(least, F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEADER_PAGES).select("file", "least")
    short = F.filter(F.array_distinct("lines"), lambda x: (x != "") & (F.length(x) <= HEADER_CHARS))
    counted = normal.join(limits, "file", "left_semi").select("file", F.explode(short).alias("line")).groupBy("file", "line").agg(F.count(F.lit(1)).alias("pages"))
    repeated = counted.join(limits, "file").where("pages >= least").groupBy("file").agg(F.collect_list("line").alias("repeated"))
    # at rest, so that adaptive execution can split the pages of a large file
    joined = normal.join(written(repeated, "headers"), "file", "left")
    kept = F.filter("lines", lambda x: (x != "") & ~F.coalesce(F.array_contains("repeated", x), F.lit(False)))
    return joined.select("file", "page", F.array_join(kept, " ").alias("text")).withColumn("char_count", F.length("text").cast("bigint"))


def chunk_pages(clean: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``file, chunk, page, start, end, text, text_hash``: overlapping windows of the long enough pages."""
    target, step = config.target_chunk_chars, config.target_chunk_chars - config.chunk_overlap_chars
    count = F.when(F.col("char_count") <= target, 1).otherwise(1 + F.ceil((F.col("char_count") - target) / step))
    long_enough = clean.where((F.col("char_count") >= config.min_chunk_chars) & (F.col("char_count") >= config.shingle_size))
    windows = long_enough.select("file", "page", "text", "char_count", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("i"))
    start = (F.col("i") * step).cast("bigint")
    cut = windows.select("file", "page", start.alias("start"), F.least(start + target, "char_count").alias("end"), "text")
    cut = cut.where(F.col("end") - F.col("start") >= config.shingle_size)
    cut = cut.withColumn("text", F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))"))
    order = W.partitionBy("file").orderBy("page", "start")
    return cut.select("file", (F.row_number().over(order) - 1).alias("chunk"), "page", "start", "end", "text", hash60(F.col("text")).alias("text_hash"))


#: Code points that are hashed at once.
_SLICE = 1 << 20


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The ascending distinct hashes of the runs of ``k`` characters of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hashes = gram_hashes(codes, k)
    row = np.repeat(np.arange(len(texts), dtype=np.uint16), sizes)[: len(hashes)]
    inside = np.arange(len(hashes)) + k <= np.cumsum(sizes)[row]
    hashes, row = hashes[inside], row[inside]
    order = np.argsort(hashes)
    order = order[np.argsort(row[order], kind="stable")]  # 16-bit numbers are sorted by their digits
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return np.split(hashes, np.searchsorted(row, np.arange(1, len(texts))))


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some ``_SLICE`` elements, and fewer than 2 ** 16 rows."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right"))
        to = min(max(to, at + 1), at + (1 << 16) - 1)
        yield at, to
        at = to


def with_shingles(chunks: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Chunks with ``shingles``, the ascending distinct hashes of their runs of ``shingle_size`` characters.

    A narrow map over Arrow batches: as JVM expressions the grams would be cut and hashed by an
    interpreted function, one at a time.
    """
    k = config.shingle_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(np.array([len(t) for t in texts], dtype=np.int64)):
                sets = shingle_sets(texts[a:b], k)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, made], names=[*batch.schema.names, "shingles"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, f"{schema}, shingles ARRAY<BIGINT>")


def sketches(chunks: DataFrame) -> DataFrame:
    """``file, chunk, h``: the least hashes of every chunk. Taken within the row, so nothing is ranked by a shuffle."""
    return chunks.select("file", "chunk", F.explode(F.slice("shingles", 1, SKETCH_SIZE)).alias("h"))


def simhashes(chunks: DataFrame) -> DataFrame:
    """``file, chunk, simhash``: 64 majority bits over the distinct hashes; a tie sets the bit. A narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            hashes = lists.flatten().to_numpy()
            done = []
            for a, b in _slices(sizes):
                own = hashes[ends[a] : ends[b]]
                bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, ends[a:b] - ends[a], axis=0, dtype=np.int32)
                done.append(np.packbits(ones * 2 >= sizes[a:b, None], axis=1, bitorder="little").view(np.int64).reshape(-1))
            made = pa.array(np.concatenate(done) if done else np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("chunk"), made], names=["file", "chunk", "simhash"])

    return chunks.where(F.size("shingles") > 0).select("file", "chunk", "shingles").mapInArrow(run, "file STRING, chunk INT, simhash BIGINT")


def file_summaries(files: DataFrame, clean: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file, page_count, total_text_chars, chunk_count``: one row for every file, failed ones too."""
    pages = clean.groupBy("file").agg(F.count(F.lit(1)).alias("page_count"), F.sum("char_count").alias("total_text_chars"))
    counts = chunks.groupBy("file").agg(F.count(F.lit(1)).alias("chunk_count"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("page_count", "total_text_chars", "chunk_count")]
    return files.select("file").distinct().join(pages, "file", "left").join(counts, "file", "left").select("file", *zero)
