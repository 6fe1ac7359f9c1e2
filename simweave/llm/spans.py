"""Long exact spans shared between records, by seed and extend.

Every window of ``length`` characters has one winnowed anchor: the k-gram of least hash in it.
Consecutive windows with the same anchor form a segment, so a window's text lies in exactly one
segment, and equal windows of two records lie in segments with the same anchor. The records are
joined on their anchors; a task extends the matches of an anchor both ways over all segments
that share it at once, by rolling hashes of the windows around the anchor, checks equal hashes
against the characters, and keeps the maximal runs. This is linear in the rows of an anchor:
no pairs are formed, however many records share one.

Texts are known by a digest, whatever ids they stand under. A text leaves an input partition
under at most two ids, which is all it takes to tell whether its windows occur under more than
one, so a text that fills a third of the table leaves two rows a partition. Anchors with more
than ``hot_rows`` segments do not go to one task: their windows are grouped one by one, with
partial aggregation, which gives the same rows; windows and texts that very many rows have are
cut into pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simweave.operators.skew import Pieces, split_join
from simweave.storage import written

#: Characters of a winnowed anchor, at most ``length``.
ANCHOR = 40
#: Segments of one anchor that a task takes.
HOT_ROWS = 200_000
#: Code points that are worked on at once.
CHUNK = 1 << 21

# Odd multipliers of the rolling hash and its mixing.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(_MIX[0])
    x = (x ^ (x >> _U64(27))) * _U64(_MIX[1])
    return x ^ (x >> _U64(31))


def codes_of(texts: list[str]) -> np.ndarray:
    """The code points of all texts, one after another."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling(codes: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` codes, runs over the ends of texts included."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    inverse = pow(base, -1, 1 << 64)
    up = np.empty(len(codes), dtype=np.uint64)
    up[:1] = 1
    up[1:] = base
    down = up[:n].copy()
    down[1:] = inverse
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_mixed(codes.astype(np.uint64) + _U64(1)) * up, out=sums[1:])
    return _mixed((sums[width:] - sums[:n]) * down)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values."""
    done, span = values, 1
    while span * 2 <= width:
        done = np.minimum(done[:-span], done[span:])
        span *= 2
    return np.minimum(done[: len(values) - width + 1], done[width - span :][: len(values) - width + 1])


def segments(texts: list[str], length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text index, start, end, anchor hash)`` of the segments of all texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    empty = np.empty(0, dtype=np.int64)
    codes = codes_of(texts)
    if len(codes) < length:
        return empty, empty, empty, empty
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    grams = rolling(codes, anchor)
    bits = _U64(max(1, int(len(grams)).bit_length()))
    places = np.arange(len(grams), dtype=np.uint64)
    # the hash in the high bits, the place in the low ones: the least is the leftmost of the least
    best = _least((grams >> bits << bits) | places, length - anchor + 1) & ((_U64(1) << bits) - _U64(1))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(best)]
    at = np.arange(len(best))
    inside = at + length <= starts[owner] + sizes[owner]
    at, owner, best = at[inside], owner[inside], best[inside].astype(np.int64)
    first = np.ones(len(at), dtype=bool)
    first[1:] = (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(at)) - 1
    who = owner[heads]
    return who, at[heads] - starts[who], at[tails] + length - starts[who], grams[best[heads]].view(np.int64)


def _same_content(codes: np.ndarray, one: np.ndarray, other: np.ndarray, width: int) -> np.ndarray:
    """Whether the runs of ``width`` codes at ``one`` and ``other`` are equal."""
    same = np.ones(len(one), dtype=bool)
    views = np.lib.stride_tricks.sliding_window_view(codes, width)
    for i in range(0, len(one), 20_000):
        same[i : i + 20_000] = (views[one[i : i + 20_000]] == views[other[i : i + 20_000]]).all(axis=1)
    return same


def shared_windows(owners: np.ndarray, texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, offset)`` of every window of ``texts`` that also occurs in a row of another owner."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = codes_of(texts)
    hashes = rolling(codes, width)
    row = np.repeat(np.arange(len(texts)), sizes)[: len(hashes)]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.flatnonzero(np.arange(len(hashes)) + width <= starts[row] + sizes[row])
    order = at[np.argsort(hashes[at], kind="stable")]
    if not len(order):
        return order, order
    key, who = hashes[order], owners[row[order]]
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    run = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    several = np.minimum.reduceat(who, heads) != np.maximum.reduceat(who, heads)
    kept = several[run]
    order, run = order[kept], run[kept]
    lead = at[:0] if not len(order) else order[np.searchsorted(run, run)]
    same = _same_content(codes, order, lead, width)
    if not same.all():  # windows with one hash and different text: decide those by their text
        odd = np.isin(run, run[~same])
        by_text: dict[bytes, set] = {}
        content = [codes[i : i + width].tobytes() for i in order[odd]]
        for c, i in zip(content, order[odd], strict=True):
            by_text.setdefault(c, set()).add(owners[row[i]])
        good = ~odd
        good[odd] = [len(by_text[c]) > 1 for c in content]
        order = order[good]
    order = np.sort(order)
    return row[order], order - starts[row[order]]


def _runs(row: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, first, last)`` of the runs of consecutive offsets."""
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(row)) - 1 if len(row) else heads
    return row[heads], offset[heads], offset[tails]


def shared_spans(df: DataFrame, row_id: str, text: str, length: int = 120, anchor: int = ANCHOR, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``row_id, span_start, span_end``: where a row's text stands word for word in other rows.

    A character counts if it lies in a run of ``length`` characters that also occurs in the text
    of another id; a span is a longest unbroken run of counting characters, in code points, the
    end exclusive. An id with several texts has the spans of each, equal ones once; what its own
    texts share with each other does not count. A null, empty or shorter text has none, rows with
    a null id are left out, and rows that repeat id and text count once. Other columns are not read.
    """
    anchor = min(anchor, length)
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(
        F.col("id").isNotNull() & (F.length("text") >= length)
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: an id of a text (no anchor), and a segment of a text under an id."""
        seen: dict[bytes, int | None] = {}  # the text's first id here, None once it has left under a second one
        for batch in batches:
            digests, ids, texts, members = [], [], [], {}
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key = blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                members[key, i] = None
                known = seen.get(key, -1) if key in seen else i
                if key not in seen or (known is not None and known != i):
                    seen[key] = i if key not in seen else None
                    digests.append(key)
                    ids.append(i)
                    texts.append(t)
            none = [None] * len(members)
            yield _batch([k for k, _ in members], [i for _, i in members], none, none, none)
            at = 0
            while at < len(texts):
                to, total = at, 0
                while to < len(texts) and (to == at or total + len(texts[to]) <= CHUNK):
                    total += len(texts[to])
                    to += 1
                who, start, end, key = segments(texts[at:to], length, anchor)
                picked = [texts[at + w][s:e] for w, s, e in zip(who.tolist(), start.tolist(), end.tolist(), strict=True)]
                yield _batch([digests[at + w] for w in who.tolist()], np.array(ids[at:to], dtype=np.int64)[who] if len(who) else who, key, start, picked)
                at = to

    schema = "grp BINARY, id BIGINT, anchor BIGINT, start BIGINT, part STRING"
    table = written(rows.mapInArrow(cut, schema), "spans")
    parts = table.where("anchor IS NOT NULL").select("anchor", "grp", "id", "start", "part")
    # one partial aggregation; the anchors above the bound are few: at most rows / hot_rows
    hot = parts.groupBy("anchor").count().where(F.col("count") > hot_rows).select("anchor")
    hot = written(hot, "spans-hot")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their anchor; an anchor's rows may go on in the next batch."""

        def work(held: pa.Table) -> pa.RecordBatch:
            keys = held.column("anchor").to_numpy()
            new = np.ones(len(keys), dtype=bool)
            new[1:] = keys[1:] != keys[:-1]
            count = np.diff(np.append(np.flatnonzero(new), len(keys)))
            several = np.repeat(count > 1, count)
            held = held.filter(pa.array(several))
            start = held.column("start").to_numpy()
            row, first, last = _runs(*shared_windows(held.column("id").to_numpy(), held.column("part").to_pylist(), length))
            group = held.column("grp").take(pa.array(row)).combine_chunks()
            return pa.RecordBatch.from_arrays([group, pa.array(start[row] + first), pa.array(start[row] + last + length)], names=["grp", "start", "end"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("part").nbytes
            if size > CHUNK * 2:
                whole = pa.Table.from_batches(held)
                keys = whole.column("anchor").to_numpy()
                end = int(np.searchsorted(keys == keys[-1], True))
                if end:
                    yield work(whole.slice(0, end))
                    whole = whole.slice(end)
                held, size = whole.to_batches(), whole.column("part").nbytes
        if held:
            yield work(pa.Table.from_batches(held))

    usual = parts.join(hot, "anchor", "left_anti").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(extend, "grp BINARY, `start` BIGINT, `end` BIGINT")
    found = usual.unionByName(_hot_spans(parts.join(hot, "anchor", "left_semi"), length))
    # gaps and islands: a span begins where everything before it has ended
    order = W.partitionBy("grp").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    begun = found.distinct().withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    spans = begun.groupBy("grp", "island").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end")).drop("island")
    members = written(table.where("anchor IS NULL").select("grp", "id").distinct(), "span-members")
    placed = split_join(members, spans, ["grp"])
    return placed.select(F.col("id").alias(row_id), "span_start", "span_end").distinct()


def _batch(group, own, anchor, start, part) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in (own, anchor, start)]
    return pa.RecordBatch.from_arrays([pa.array(group, pa.binary()), *columns, pa.array(part, pa.string())], names=["grp", "id", "anchor", "start", "part"])


def _hot_spans(parts: DataFrame, length: int) -> DataFrame:
    """The same spans for the segments of hot anchors, window by window."""
    window = F.explode(F.sequence(F.lit(0), F.length("part") - length)).alias("o")
    windows = parts.select("grp", "id", "start", "part", window)
    text = F.expr(f"substring(part, o + 1, {length})")
    windows = windows.select("grp", "id", (F.col("start") + F.col("o")).alias("start"), F.xxhash64(text).alias("h"), F.md5(text).alias("d"))
    counts = written(windows.groupBy("h", "d").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")), "span-windows")
    pieces = Pieces.of(counts.select("h", "d", "n"))
    return pieces.join(windows, counts.where("a <> b").select("h", "d"), ["h", "d"], "left_semi").select("grp", "start", (F.col("start") + length).alias("end"))
