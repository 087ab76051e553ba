"""The ready programs. Each takes a graph and the loop's options and returns a ``Result``."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.operators.accumulate import MAX, MIN, SUM
from undertow.operators.graph import Graph
from undertow.plans.engine import Program, Result, run


PROGRAMS: dict[str, Callable[..., Result]] = {}


def program(f: Callable[..., Result]) -> Callable[..., Result]:
    """Registers a program under its name."""
    PROGRAMS[f.__name__] = f
    return f


@program
def pagerank(graph: Graph, damping: float = 0.8, **options) -> Result:
    """Ranks that aren't normalised: their sum tends to the number of vertices. Vertices without links lose their mass."""
    rest = float(1 - Decimal(str(float(damping))))  # 0.2, where 1 - 0.8 is a little less and may fall below min_message
    return run(graph, Program(SUM, F.lit(0.0), F.lit(rest), F.lit(damping) / F.col("degree")), **options)


@program
def shortest_path(graph: Graph, source, unweighted: bool = False, **options) -> Result:
    """Distances from ``source`` over links of non-negative weight; NULL where none leads."""
    start = F.when(F.col("k") == source, 0.0)
    return run(graph, Program(MIN, F.lit(None), start, F.lit(1.0) if unweighted else F.col("weight")), **options)


@program
def adsorption(graph: Graph, starts: int = 100, damping: float = 0.1, mass: float = 10.0, **options) -> Result:
    """Label mass sent from the vertices below ``starts`` along weighted links."""
    start = F.when(F.col("k") < starts, mass).otherwise(0.0)
    return run(graph, Program(SUM, F.lit(0.0), start, F.lit(damping) * F.col("weight")), **options)


@program
def katz(graph: Graph, source=0, beta: float = 0.1, seed: float | None = None, double_seed: bool = False, **options) -> Result:
    """The Katz measure from ``source``; ``seed`` is the number of vertices by default, ``double_seed`` counts it twice."""
    if seed is None:
        graph = graph.stored()
        seed = float(graph.vertices.count())
    start = F.when(F.col("k") == source, float(seed)).otherwise(0.0)
    return run(graph, Program(SUM, start if double_seed else F.lit(0.0), start, F.lit(beta)), **options)


@program
def max_value(graph: Graph, source=None, **options) -> Result:
    """The largest id among a vertex and those that lead to it; ``source`` doesn't send its own id."""
    own = F.col("k").cast("double")
    start = own if source is None else F.when(F.col("k") == source, 0.0).otherwise(own)
    return run(graph, Program(MAX, own, start, F.lit(0.0)), **options)


@program
def components(graph: Graph, **options) -> Result:
    """The largest id of each vertex's connected component."""
    return max_value(graph.symmetric(), **options)


def top_k(values: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``values`` (k, value) with the highest values, ties by id."""
    return values.select("k", "value").orderBy(F.desc_nulls_last("value"), "k").limit(n)
