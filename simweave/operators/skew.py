"""Joins whose heavy keys are cut into pieces.

Adaptive execution splits a skewed join partition only where both sides come straight from a
shuffle; an aggregated or already partitioned side rules that out. Here the heavy keys are known
from counts: the rows of such a key are scattered over pieces by their hash, and the other
side's rows of it are repeated for each piece, so no task has more than a bounded part of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.storage import written

#: A key is heavy if more than one in so many of all rows has it, so there are at most so many heavy keys.
SHARE = 10_000
#: And if it has more rows than this, which any task can take.
LEAST_ROWS = 20_000


@dataclass(frozen=True)
class Pieces:
    """The heavy keys of a table with the number of their pieces; ``heavy`` is None where no key is."""

    keys: tuple[str, ...]
    heavy: DataFrame | None

    @classmethod
    def of(cls, counts: DataFrame, n: str = "n", least: int | None = None) -> Pieces:
        """From one row for each key: the key columns and the number ``n`` of its rows."""
        least = LEAST_ROWS if least is None else least
        keys = tuple(c for c in counts.columns if c != n)
        total, most = counts.agg(F.sum(n), F.max(n)).first()
        limit = max(least, (total or 0) // SHARE)
        if (most or 0) <= limit:
            return cls(keys, None)
        # at most SHARE rows, whatever the number of rows
        heavy = counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("_pieces"))
        return cls(keys, written(heavy, "heavy"))

    def _known(self, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        names = [F.col(k).alias(name) for k, name in zip(self.keys, keys, strict=True)]
        return df.join(F.broadcast(self.heavy.select(*names, "_pieces")), list(keys), "left")  # SHARE rows at most

    def scatter(self, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """The rows that make the keys heavy, each with the ``_piece`` that it belongs to."""
        if self.heavy is None:
            return df
        piece = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_pieces").cast("bigint")), F.lit(0)).cast("int")
        return self._known(df, keys).select(*df.columns, piece.alias("_piece"))

    def repeat(self, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """The rows of the other side, once for each piece of their key."""
        if self.heavy is None:
            return df
        each = F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
        return self._known(df, keys).select(*df.columns, each.alias("_piece"))

    def join(self, many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        """``many.join(one, keys, how)``, inner or left of either kind, whatever the keys of ``many`` weigh."""
        names = tuple(keys)
        on = keys if self.heavy is None else [*keys, "_piece"]
        return self.scatter(many, names).join(self.repeat(one, names), on, how).drop("_piece")


def split_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """:meth:`Pieces.join` with the keys of ``many`` counted first, by one partial aggregation.

    ``many`` is read twice, so it should be a table at rest. Null keys match nothing, as in any join.
    """
    return Pieces.of(many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))).join(many, one, keys, how)
