"""Filling fixed-capacity containers: best-fit decreasing with a segment tree.

Best fit only looks at sizes, and there are at most ``capacity + 1`` of them. So the items are
counted by size, and best-fit decreasing is run on the counts: containers with the same
remaining capacity form a class, a segment tree over the capacities finds the tightest class
that still fits a size, and a step fills many containers at once. The outcome is the plan that
the item-by-item procedure would make, in time that depends on the capacity and not on the
number of items. The items then look up their places in the plan by their rank within their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simweave.storage import written

#: Items that are ranked together; a size with more is ranked in as many buckets as it takes.
RANK_ROWS = 50_000


class TightestFit:
    """A segment tree over remaining capacities: the smallest one with containers that is at least ``size``."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.width)

    def set(self, remaining: int, some: bool) -> None:
        node = remaining + self.width
        self.some[node] = some
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def first(self, size: int) -> int | None:
        node = size + self.width
        if self.some[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """``(size, first rank, items, first container, items a container)`` of each run, and the number of containers.

    Sizes are 1 to ``capacity``. Items of a size are numbered from 0; those of a run fill
    consecutive containers, each with the given number of them.
    """
    tree = TightestFit(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    total = 0

    def put(remaining: int, begin: int, end: int) -> None:
        if begin < end:
            open_.setdefault(remaining, []).append((begin, end))
            tree.set(remaining, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            remaining = tree.first(size)
            if remaining is None:
                remaining = capacity
                each = capacity // size
                begin, end = total, total + -(-left // each)
                total = end
            else:
                each = remaining // size
                begin, end = open_[remaining].pop()
                if not open_[remaining]:
                    tree.set(remaining, False)
            full = min(end - begin, left // each)
            if full:
                runs.append((size, rank, full * each, begin, each))
                put(remaining - each * size, begin, begin + full)
                rank, left = rank + full * each, left - full * each
            begin += full
            if left and begin < end and left < each:
                runs.append((size, rank, left, begin, left))
                put(remaining - left * size, begin, begin + 1)
                begin, left = begin + 1, 0
            put(remaining, begin, end)
    return runs, total


def fill_containers(df: DataFrame, row_id: str, size: str, capacity: int) -> DataFrame:
    """``row_id, piece, start, end, container``: every item's place.

    An item larger than ``capacity`` is divided into pieces of ``capacity`` and a rest, and only
    such an item is; ``start`` and ``end`` are the piece's range within the item. Containers are
    numbered from 0 without gaps. Items of size 0, or with a null or negative size, which counts
    as 0, need no room and are spread evenly over the containers (over container 0 if there are
    none). Repeated rows are separate items. Other columns are not read.

    Items of one size are told apart by id, so the result is the same however the rows lie.
    """
    items = df.select(F.col(row_id).cast("bigint").alias("id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("whole"))
    last = F.greatest(F.ceil(F.col("whole") / capacity).cast("bigint") - 1, F.lit(0))
    pieces = items.select("id", "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = written(pieces.select("id", "piece", F.least(F.col("whole") - F.col("piece") * capacity, F.lit(capacity)).alias("size")), "items")
    sizes = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in sizes.collect()}  # at most capacity + 1 rows
    buckets = df.sparkSession.createDataFrame([(s, -(-n // RANK_ROWS)) for s, n in histogram.items()], "size BIGINT, buckets BIGINT")
    pieces = pieces.join(F.broadcast(buckets), "size").select("id", "piece", "size", F.pmod(F.xxhash64("id", "piece"), F.col("buckets")).alias("bucket"))
    counts = pieces.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram.pop(0, None)
    runs, total = best_fit_plan(histogram, capacity)
    runs.sort()
    plan = np.array(runs, dtype=np.int64).reshape(-1, 5)
    shared = df.sparkSession.sparkContext.broadcast(plan)  # its size follows from the capacity, not from the number of items

    before = W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(W.partitionBy("size", "bucket").orderBy("id", "piece")) - 1
    ranked = pieces.withColumn("place", within).join(offsets, ["size", "bucket"]).select("id", "piece", "size", (F.col("place") + F.col("offset")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            sizes, ranks, piece = (batch.column(c).to_numpy() for c in ("size", "rank", "piece"))
            container = ranks % max(1, total)
            some = sizes > 0
            if some.any():
                run = plan[np.searchsorted(keys, sizes[some] << 44 | ranks[some], "right") - 1]
                container = container.copy()
                container[some] = run[:, 3] + (ranks[some] - run[:, 1]) // run[:, 4]
            start = piece * capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(piece), pa.array(start), pa.array(start + sizes), pa.array(container)], names=["id", "piece", "start", "end", "container"]
            )

    return ranked.mapInArrow(place, "id BIGINT, piece BIGINT, `start` BIGINT, `end` BIGINT, container BIGINT").withColumnRenamed("id", row_id)
