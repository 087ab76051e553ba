"""Accumulators: an associative, commutative combination with an identity, and the priority of a pending change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Accumulator:
    """MIN and MAX have NULL as identity, SUM has 0; NULL also stands for a vertex that nothing has reached.

    ``custom`` makes others. What they combine has to be idempotent, associative and commutative, with NULL as identity;
    a change is sent if it changes what was sent before.
    """

    name: str
    own_combine: Callable[[Column, Column], Column] | None = None
    own_aggregate: Callable[[Column], Column] | None = None
    own_priority: Callable[[Column, Column], Column] | None = None

    @staticmethod
    def custom(
        name: str, combine: Callable[[Column, Column], Column], aggregate: Callable[[Column], Column],
        priority: Callable[[Column, Column], Column] | None = None,
    ) -> Accumulator:
        """``combine`` of two columns that aren't null, ``aggregate`` of one; ``priority`` of value and delta, 1 by default."""
        return Accumulator(name, combine, aggregate, priority or (lambda value, delta: F.lit(1.0)))

    @property
    def idempotent(self) -> bool:
        return self.name != "sum"

    @property
    def identity(self) -> Column:
        return F.lit(None).cast("double") if self.idempotent else F.lit(0.0)

    def combine(self, a: Column, b: Column) -> Column:
        """``a`` and ``b`` combined; NULL leaves the other unchanged."""
        if self.own_combine:
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(self.own_combine(a, b))
        if self.name == "min":
            return F.least(a, b)
        if self.name == "max":
            return F.greatest(a, b)
        return F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))

    def aggregate(self, column: Column) -> Column:
        if self.own_aggregate:
            return self.own_aggregate(column)
        return {"min": F.min, "max": F.max, "sum": F.sum}[self.name](column)

    def better(self, a: Column, b: Column) -> Column:
        """Whether ``a`` would change ``b`` under MIN or MAX."""
        if self.own_combine:
            return b.isNull() | ~self.combine(b, a).eqNullSafe(b)
        return b.isNull() | (a < b if self.name == "min" else a > b)

    def priority(self, value: Column, delta: Column) -> Column:
        """How far ``delta`` would move ``value``: the gain for MIN and MAX, the change itself for SUM."""
        if self.own_priority:
            return self.own_priority(value, delta)
        if self.name == "sum":
            return delta
        gain = value - F.least(value, delta) if self.name == "min" else F.greatest(value, delta) - value
        return F.when(value.isNull() & delta.isNotNull(), F.lit(float("inf"))).otherwise(gain)

    def active(self, delta: Column, best_sent: Column | None = None) -> Column:
        """Whether a pending change has to be sent: SUM sends what isn't 0, MIN and MAX what beats all sent before."""
        if self.name == "sum":
            return delta != 0
        pending = delta.isNotNull()
        return pending if best_sent is None else pending & self.better(delta, best_sent)


MIN, MAX, SUM = Accumulator("min"), Accumulator("max"), Accumulator("sum")
