"""Encoding a corpus with a public byte-level tokenizer by a global shuffle of distinct words.

The texts are cut into pre-tokens. Their positions are kept as codes of a block's own
dictionary, so a word leaves a block once however often it occurs there; the dictionaries'
words are shuffled by word, each distinct word is encoded once, its ids are joined back to the
blocks that have it, and every block reassembles its texts by position. Decoding joins the
table of the tokens' bytes.

A word has one row a block. Words are shuffled together with a range of 1,024 input partitions,
and encoded once in each, so a word that occurs everywhere makes no hot task at any size.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.storage import written

#: Where the vocabulary files lie, unless told otherwise.
TOKENIZERS = os.environ.get("SIMWEAVE_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a block, which is one task's unit of reassembly; a longer text is a block of its own.
BLOCK = 3_000_000


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@cache
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The file of a vocabulary; it has the same path on all machines."""
    return os.path.join(folder, f"{name}.tiktoken")


def _packed(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values, dtype=np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(1).compress(raw)


def _unpacked(blob: bytes, count: int) -> np.ndarray:
    raw = zstandard.decompress(blob, max_output_size=max(1, 4 * count))
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


def encode_corpus(df: DataFrame, row_id: str, text: str, vocabulary_file: str | None = None, counts: bool = False, block: int = BLOCK) -> DataFrame:
    """``row_id, ids``: the token ids of every text, without special tokens; with ``counts``, ``row_id, tokens``.

    Names of special tokens in a text are plain text. A null or empty text has an empty list
    (0 tokens). Every input row gives one row, also with a null or repeated id. Other columns
    are not read.
    """
    path = vocabulary_file or vocabulary()
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find = regex.compile(PATTERN).findall
        part = TaskContext.get().partitionId() << 32
        codes: dict[str, int] = {}
        ids: list = []
        lengths: list[int] = []
        positions: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = len(codes)
            kind = [part] * (n + 1)
            word = pa.array([*codes, None], pa.string())
            code = pa.array([*range(n), None], pa.int32())
            none = pa.nulls(n)
            docs = pa.concat_arrays([none.cast(pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64()))])
            size_of = pa.concat_arrays([none.cast(pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int32()))])
            blob = pa.concat_arrays([none.cast(pa.binary()), pa.array([_packed(np.array(positions, dtype=np.uint32))], pa.binary())])
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), word, code, docs, size_of, blob], names=["part", "word", "code", "docs", "lengths", "positions"])

        for batch in batches:
            for i, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ids and size + len(value or "") > block:
                    yield flush()
                    part += 1
                    codes, ids, lengths, positions, size = {}, [], [], [], 0
                words = find(value) if value else []
                positions += [codes.setdefault(w, len(codes)) for w in words]
                ids.append(i)
                lengths.append(len(words))
                size += len(value or "")
        if ids:
            yield flush()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their words: a word is encoded where it first occurs."""
        last, ids = None, b""
        one = _encoder(path).encode_ordinary
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last = word
                    found = one(word)
                    ids = len(found).to_bytes(4, "little") if counts else np.array(found, dtype=np.int32).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("code"), pa.array(out, pa.binary())], names=["part", "code", "ids"])

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = [("id", pa.int64()), ("tokens", pa.int64())] if counts else [("id", pa.int64()), ("ids", pa.list_(pa.int32()))]
        schema = pa.schema(kind)
        if not left.num_rows:
            return schema.empty_table()
        docs, lengths = left.column("docs").chunk(0).values, left.column("lengths").chunk(0).values.to_numpy()
        at = _unpacked(left.column("positions")[0].as_py(), int(lengths.sum())).astype(np.int64)
        order = np.argsort(right.column("code").to_numpy())
        entries = right.column("ids").combine_chunks().take(pa.array(order)) if right.num_rows else pa.array([], pa.binary())
        if isinstance(entries, pa.ChunkedArray):
            entries = entries.combine_chunks()
        offsets = np.frombuffer(entries.buffers()[1], dtype=np.int32)[entries.offset : entries.offset + len(entries) + 1].astype(np.int64) // 4 if len(entries) else np.zeros(1, dtype=np.int64)
        flat = np.frombuffer(entries.buffers()[2] or b"", dtype=np.int32) if len(entries) else np.empty(0, dtype=np.int32)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        if counts:
            sums = np.concatenate([[0], np.cumsum(flat[at] if len(at) else np.empty(0, dtype=np.int64), dtype=np.int64)])
            return pa.table([docs, pa.array(sums[begins[1:]] - sums[begins[:-1]])], schema=schema)
        width = (offsets[1:] - offsets[:-1])[at]
        ends = np.concatenate([[0], np.cumsum(width)])
        source = np.repeat(offsets[at] - ends[:-1], width) + np.arange(ends[-1])
        lists = pa.ListArray.from_arrays(pa.array(ends[begins].astype(np.int32)), pa.array(flat[source]))
        return pa.table([docs, lists], schema=schema)

    table = written(rows.mapInArrow(cut, "part BIGINT, word STRING, code INT, docs ARRAY<BIGINT>, lengths ARRAY<INT>, positions BINARY"), "tokens")
    words = table.where("code IS NOT NULL").select("part", "word", "code")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = words.repartition(n, "word", F.shiftright("part", 42)).sortWithinPartitions("word").mapInArrow(encode, "part BIGINT, code INT, ids BINARY")
    blocks = table.where("code IS NULL").select("part", "docs", "lengths", "positions")
    schema = "id BIGINT, tokens BIGINT" if counts else "id BIGINT, ids ARRAY<INT>"
    return blocks.groupBy("part").cogroup(encoded.groupBy("part")).applyInArrow(reassemble, schema).withColumnRenamed("id", row_id)


def decode_corpus(df: DataFrame, row_id: str, ids: str, vocabulary_file: str | None = None) -> DataFrame:
    """``row_id, text``: the text of each list of ids, by the table of the tokens' bytes.

    Null lists give null, empty ones an empty text. Bytes that are no UTF-8 by themselves (a
    list cut inside a character) come out as U+FFFD; an id outside the vocabulary is an error.
    """
    path = vocabulary_file or vocabulary()
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = sorted((rank, token) for token, rank in _ranks(path).items())
        table = pa.array([token for _, token in by_rank], pa.large_binary())
        for batch in batches:
            lists = batch.column("ids")
            tokens = table.take(lists.flatten())
            ends = np.frombuffer(tokens.buffers()[1], dtype=np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, dtype=np.int64)
            data = tokens.buffers()[2].to_pybytes() if len(tokens) else b""
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            begins = np.concatenate([[0], np.cumsum(sizes)])
            texts = [data[ends[a] : ends[b]].decode("utf-8", "replace") for a, b in zip(begins[:-1], begins[1:], strict=True)]
            texts = [t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, "id BIGINT, text STRING").withColumnRenamed("id", row_id)
