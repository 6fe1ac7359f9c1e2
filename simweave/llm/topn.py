"""Top N rows within every group by merging sorted runs.

Every input partition becomes one sorted run, ordered by group and rank by a sort that spills,
and cut to N rows a group on its way to the disk; that is exact, since a row beyond N in its run
is beyond N overall. The runs are stored. A task then gets the runs of its groups, group by
group and run by run, merges the runs of a group with a loser tree, and after N rows goes on to
the next group. It holds the rows of one group and an Arrow batch at a time.

A group with a third of all rows leaves at most N rows a run. Where there are more than
``fan_in`` runs, they are merged within spans of ``fan_in`` runs first, so no task meets more
than N x fan_in rows of one group. How many runs there are is read from what was stored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.storage import drop_written, written

FAN_IN = 256
#: Stored rows that make a partition of a merge worth while.
PARTITION_ROWS = 1_000_000


class LoserTree:
    """A tournament over ``k`` sources of ascending keys; ``None`` marks an empty source."""

    def __init__(self, heads: list):
        self.k = max(1, len(heads))
        self.heads = list(heads) or [None]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = b
        return a

    def replace(self, head) -> None:
        """Give the winner's source its next key and replay its path to the root."""
        at, node = self.winner, (self.winner + self.k) // 2
        self.heads[at] = head
        while node >= 1 and self.k > 1:
            if self._beats(self.losers[node], at):
                self.losers[node], at = at, self.losers[node]
            node //= 2
        self.winner = at


def merge_runs(runs: list[tuple[list, list, list]]) -> Iterator[tuple[int, int]]:
    """``(run, row)`` of the first N rows of each group, in order, from sorted runs.

    A run is three lists: groups (ascending), rank keys (ascending within a group) and N.
    """
    position = [0] * len(runs)
    heads = [r[0][0] if r[0] else None for r in runs]
    groups = LoserTree(heads)
    while groups.heads[groups.winner] is not None:
        group = groups.heads[groups.winner]
        members = []
        while groups.heads[groups.winner] == group:
            run = groups.winner
            begin = position[run]
            end = bisect_right(runs[run][0], group, begin)  # the seek to the run's next group
            members.append((run, begin, end))
            position[run] = end
            groups.replace(runs[run][0][end] if end < len(runs[run][0]) else None)
        if len(members) == 1:
            run, begin, end = members[0]
            n = runs[run][2][begin]
            yield from ((run, i) for i in range(begin, min(end, begin + n)))
            continue
        n = max(runs[run][2][begin] for run, begin, _ in members)
        at = [begin for _, begin, _ in members]
        tree = LoserTree([runs[run][1][begin] for run, begin, _ in members])
        for _ in range(n):
            m = tree.winner
            if tree.heads[m] is None:
                break
            run, _, end = members[m]
            yield run, at[m]
            at[m] += 1
            tree.replace(runs[run][1][at[m]] if at[m] < end else None)


_RUN = "_run BIGINT, _group STRING, _score DOUBLE, _tie STRING, _id STRING, _n INT"
_NAMES = ["_run", "_group", "_score", "_tie", "_id", "_n"]


def _heads(column: pa.Array) -> np.ndarray:
    """Where a value begins that differs from the one before."""
    codes = column.dictionary_encode().indices.to_numpy() if pa.types.is_string(column.type) else column.to_numpy()
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, dtype=np.int64)


def _sorted_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of the run, cut to N a group; a group may go on in the next batch."""
    from pyspark import TaskContext

    run = TaskContext.get().partitionId()
    last, had = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("_group")
        heads = _heads(group)
        place = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
        if group[0].as_py() == last:
            place[: heads[1] if len(heads) > 1 else None] += had
        last, had = group[-1].as_py(), int(place[-1]) + 1
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(group), run)), *(batch.column(c) for c in _NAMES[1:])], names=_NAMES)
        yield whole.filter(pa.array(place < batch.column("_n").to_numpy()))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut only between groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("_group")
        at = int(_heads(group)[-1])
        if held and held[0].column("_group")[0] == group[-1]:
            held.append(batch)
            continue
        if at or held:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in the order of group and run, with the places of each group's first N, in order."""
    for part in _by_group(batches):
        part = part.combine_chunks()
        groups = part.column("_group").combine_chunks()
        begins, n = _heads(groups), part.column("_n").to_numpy()
        ends = np.append(begins[1:], len(groups))
        run = part.column("_run").to_numpy()
        single = run[begins] == run[ends - 1]
        picked: list[np.ndarray] = []
        for begin, end, one in zip(begins.tolist(), ends.tolist(), single.tolist(), strict=True):
            if one:
                picked.append(np.arange(begin, min(end, begin + int(n[begin]))))
                continue
            own = part.slice(begin, end - begin)
            keys = list(zip((-own.column("_score").to_numpy()).tolist(), own.column("_tie").to_pylist(), own.column("_id").to_pylist(), strict=True))
            bounds = [0, *(np.flatnonzero(np.diff(run[begin:end])) + 1).tolist(), end - begin]
            sizes = n[begin:end].tolist()
            runs = [([0] * (b - a), keys[a:b], sizes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            picked.append(np.array([begin + bounds[r] + i for r, i in merge_runs(runs)], dtype=np.int64))
        yield part, np.concatenate(picked)


def top_n(df: DataFrame, group: str, score: str, tie: str, row_id: str, n: str, fan_in: int = FAN_IN) -> DataFrame:
    """``group, row_id, rank``: the first ``n`` rows of each group.

    Rows are ordered by ``score`` descending, then ``tie`` ascending, then ``row_id`` ascending
    (strings by code point); ``rank`` starts at 1. ``n`` names a column that is the same in all
    rows of a group; where it differs, the best row of a run says how far the run is read, and
    the greatest of them holds. A group whose n is null or below 1 has no rows. Rows with a null
    group, tie or id, or a score that is null or NaN, do not compete. Equal rows are separate
    rows. Other columns are not read.
    """
    usable = F.col("_group").isNotNull() & F.col("_tie").isNotNull() & F.col("_id").isNotNull() & F.col("_score").isNotNull() & ~F.isnan("_score") & (F.col("_n") >= 1)
    rows = df.select(
        F.col(group).cast("string").alias("_group"),
        (F.col(score).cast("double") + 0.0).alias("_score"),
        F.col(tie).cast("string").alias("_tie"),
        F.col(row_id).cast("string").alias("_id"),
        F.col(n).cast("int").alias("_n"),
    ).where(usable)
    stored = written(rows.sortWithinPartitions("_group", F.desc("_score"), "_tie", "_id").mapInArrow(_sorted_run, _RUN), "runs")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gathered(table: DataFrame, span: str | None = None) -> DataFrame:
        """The runs of a group, or of a group and a span of runs, in one task: by group, and within it by run and rank."""
        keys = ["_group", *([F.expr(span)] if span else [])]
        needed = max(partitions, -(-rows_stored // PARTITION_ROWS))
        order = [*([F.expr(span)] if span else []), "_group", "_run", F.desc("_score"), "_tie", "_id"]
        return table.repartition(needed, *keys).sortWithinPartitions(*order)

    rows_stored, runs = stored.agg(F.count(F.lit(1)), F.coalesce(F.max("_run"), F.lit(0)) + 1).first()
    while runs > fan_in:

        def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def spans() -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
                for batch in batches:
                    number = batch.column("_run").to_numpy() // fan_in
                    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        if b > a:
                            yield int(number[a]), batch.slice(a, b - a)

            from itertools import groupby

            for number, parts in groupby(spans(), key=lambda x: x[0]):
                for part, picked in _merged(b for _, b in parts):
                    best = part.take(pa.array(picked)).set_column(0, "_run", pa.array(np.full(len(picked), number)))
                    yield from best.combine_chunks().to_batches()

        fewer = written(gathered(stored, f"_run div {fan_in}").mapInArrow(narrowed, _RUN), "runs")
        drop_written(stored)
        stored, runs = fewer, -(-runs // fan_in)
        rows_stored = stored.count()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, picked in _merged(batches):
            best = part.select(["_group", "_id"]).take(pa.array(picked)).combine_chunks()
            if not len(picked):
                continue
            names = best.column("_group").combine_chunks()
            heads = _heads(names)
            rank = np.arange(len(picked)) - np.repeat(heads, np.diff(np.append(heads, len(picked)))) + 1
            yield pa.RecordBatch.from_arrays([names, best.column("_id").combine_chunks(), pa.array(rank.astype(np.int32))], names=["_group", "_id", "rank"])

    found = gathered(stored).mapInArrow(ranked, "_group STRING, _id STRING, rank INT")
    return found.select(F.col("_group").alias(group), F.col("_id").alias(row_id), "rank")
