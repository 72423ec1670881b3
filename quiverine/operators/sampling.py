"""Drawing indices in proportion to their weights."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverine.errors import InvalidArgs
from quiverine.sources.tables import keep


class WeightedIndex:
    """Weights that can be changed together, and drawn from.

    A change that would leave a negative weight or no weight at all is refused
    as a whole.
    """

    def __init__(self, weights: Iterable[float]) -> None:
        self.weights = np.array(list(weights), float)
        if not len(self.weights):
            raise InvalidArgs("no weights")
        self._check(self.weights)

    @staticmethod
    def _check(weights: np.ndarray) -> None:
        if not np.isfinite(weights).all() or (weights < 0).any():
            raise InvalidArgs("weights must be finite and not negative")
        if weights.sum() <= 0:
            raise InvalidArgs("all weights are zero")

    def update(self, changes: Iterable[tuple[int, float]]) -> None:
        new = self.weights.copy()
        for index, weight in changes:
            if not 0 <= index < len(new):
                raise InvalidArgs(f"no weight has index {index}")
            new[index] = weight
        self._check(new)
        self.weights = new

    def get(self, index: int) -> float | None:
        return float(self.weights[index]) if 0 <= index < len(self.weights) else None

    @property
    def total(self) -> float:
        return float(self.weights.sum())

    def at(self, u: float) -> int:
        """The first index whose running total is over ``u``; the last one with a weight if rounding leaves none."""
        over = np.flatnonzero((np.cumsum(self.weights) > u) & (self.weights > 0))
        return int(over[0]) if len(over) else int(np.flatnonzero(self.weights)[-1])

    def sample(self, uniform: Callable[[float], float]) -> int:
        """An index drawn by ``uniform(total)``, a number from 0 to below the total."""
        return self.at(uniform(self.total))


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """``df``, written in the order of columns: ``__task`` numbers its stretches in that order, ``__at`` rises within one.

    Rows are dealt by the range of the columns, whatever their values' spread,
    so a stretch holds about its even share of the rows.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(dealt.withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))


def cumulative(df: DataFrame, order: str, weight: str, to: str = "cumulative") -> DataFrame:
    """``df`` with the running total of ``weight`` in the order of ``order``.

    Stretches of rows are summed first, one row each, so that no task runs
    over all rows.
    """
    value = F.col(weight).cast("double")
    parts = in_order(df, order)
    sums = parts.groupBy("__task").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__task", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__before"))
    own = Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn("__own", F.sum(value).over(own)).join(offsets, "__task")
    return summed.withColumn(to, F.col("__own") + F.col("__before")).select(*df.columns, to)


def sample_at(df: DataFrame, order: str, weight: str, u: Column | float) -> DataFrame:
    """The row that a draw of ``u`` picks: the first in order, of positive weight, whose running total is over ``u``."""
    u = u if isinstance(u, Column) else F.lit(float(u))
    return first_over(cumulative(df, order, weight), order, weight, u)


def first_over(totals: DataFrame, order: str, weight: str, u: Column) -> DataFrame:
    """The same of running totals at hand."""
    return totals.filter((F.col("cumulative") > u) & (F.col(weight) > 0)).orderBy(order).limit(1)
