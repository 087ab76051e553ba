"""Which active vertices a round sends: all, a share by priority, the top k changes, or changes above a minimum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_SIZE = 1000
CUTS, FEW = 32, 10_000


def nth_largest(rows: DataFrame, column: str, place: int) -> float | None:
    """The value of ``column`` at ``place``, counted from 0, in falling order; None where there are fewer values.

    The values are narrowed down to those between two neighbouring quantiles of a sketch, by counting, until few enough
    are left to be read: every step is one aggregation, and no task or driver gets more than FEW rows. Nulls are no values.
    """
    inside = rows.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    above = 0  # values above those inside
    while True:
        told = inside.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", [i / CUTS for i in range(CUTS + 1)], 10_000).alias("cuts")).first()
        if place - above >= told.n:
            return None
        if told.n <= FEW:
            return sorted((r.x for r in inside.collect()), reverse=True)[place - above]
        cuts = sorted(set(told.cuts), reverse=True)
        counts = inside.agg(*[c for i, x in enumerate(cuts) for c in (F.count_if(F.col("x") > x).alias(f"a{i}"), F.count_if(F.col("x") >= x).alias(f"b{i}"))]).first()
        high, high_above = None, 0  # the values still in question are below ``high``
        for i, x in enumerate(cuts):
            if place - above < counts[f"a{i}"]:
                inside = inside.filter(F.col("x") > x)
                break
            if place - above < counts[f"b{i}"]:
                return x
            high, high_above = x, counts[f"b{i}"]
        if high is not None:
            inside, above = inside.filter(F.col("x") < high), above + high_above


def portion_threshold(rows: DataFrame, portion: float, exact: bool = False, seed: int | None = None) -> tuple[float | None, bool]:
    """(threshold, inclusive) of the ``portion`` with the highest ``prio`` among ``rows``.

    The threshold is the priority at place floor(n * portion), counted from 0, in falling order; rows above it are
    scheduled, and rows equal to it too if that place is the first or nothing is above it. ``exact`` finds that place
    by counting (``nth_largest``); otherwise a quantile sketch of bounded size is used. With a ``seed``, SAMPLE_SIZE rows
    drawn with replacement stand for all.
    """
    if seed is not None:
        n = rows.count()
        rows = rows.sample(withReplacement=True, fraction=min(1e6, SAMPLE_SIZE / max(1, n)), seed=seed)
    if exact:
        told = rows.agg(F.count(F.lit(1)).alias("n"), F.max("prio").alias("top")).first()
        place = int(told.n * portion)
        if told.n == 0:
            return None, True
        t, top = nth_largest(rows, "prio", min(place, told.n - 1)), told.top
    else:
        t, top = rows.agg(F.percentile_approx("prio", 1.0 - portion, 10_000), F.max("prio")).first()
        place = 1
    return t, place == 0 or t == top


@dataclass(frozen=True)
class All:
    def select(self, rows: DataFrame) -> Column:
        """A condition on ``rows`` (prio, delta, active) for those to send."""
        return F.col("active")


@dataclass(frozen=True)
class Portion:
    """The share ``portion`` of all rows with the highest priority; tables of SAMPLE_SIZE rows at most send everything."""

    portion: float
    exact: bool = False
    seed: int | None = None
    small: int = SAMPLE_SIZE
    always = True  # sends something while something is active: the rows above the threshold, or the highest

    def select(self, rows: DataFrame) -> Column:
        if self.portion >= 1 or self.small and len(rows.take(self.small + 1)) <= self.small:
            return F.col("active")
        # inactive rows have nothing to gain
        prio = rows.select(F.when(F.col("active"), F.col("prio")).otherwise(float("-inf")).alias("prio"))
        t, inclusive = portion_threshold(prio, self.portion, self.exact, self.seed)
        if t is None or t == float("-inf"):
            return F.col("active")
        return F.col("active") & (F.col("prio") >= t if inclusive else F.col("prio") > t)


def topk_threshold(rows: DataFrame, k: int) -> float | None:
    """The k-th largest delta, or the least one if there are fewer."""
    if k <= FEW:
        return rows.orderBy(F.desc_nulls_last("delta")).limit(k).agg(F.min("delta")).first()[0]
    t = nth_largest(rows, "delta", k - 1)
    return rows.agg(F.min("delta")).first()[0] if t is None else t


@dataclass(frozen=True)
class TopK:
    """Active rows whose change is at least the ``k``-th largest."""

    k: int
    always = True  # the threshold is a change of an active row

    def select(self, rows: DataFrame) -> Column:
        t = topk_threshold(rows.filter("active"), self.k)
        return F.col("active") if t is None else F.col("active") & (F.col("delta") >= t)


@dataclass(frozen=True)
class MinDelta:
    """Active rows whose change is at least ``least`` in size; smaller ones stay pending."""

    least: float

    def select(self, rows: DataFrame) -> Column:
        return F.col("active") & (F.abs("delta") >= self.least)
