"""Presets, and a grid of runs with the time of each phase."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from undertow.lineage import delete, shared_dir
from undertow.operators.graph import Graph
from undertow.operators.schedule import All, Portion
from undertow.plans import programs
from undertow.sources import adjacency, generate

#: Fixed values of the usual runs: vertices, source vertex, change of progress that ends the run, share sent per round.
PRESETS = {
    "pagerank": {"nodes": 4_800_000, "eps": 0.1, "portion": 0.1},
    "katz": {"nodes": 5_200_000, "source": 0, "eps": 0.1, "portion": 0.1},
    "max_value": {"nodes": 1_300_000, "source": 0, "eps": 0.0, "portion": 0.1},
    "shortest_path": {"nodes": 400_000, "source": 0, "eps": 0.0, "portion": 0.05},
}
#: Fixed values of generated graphs: logarithmic mean and deviation of degrees and weights.
GRAPH = {"degree_m": -0.5, "degree_s": 2.3, "weight_m": 0.0, "weight_s": 1.0}
#: Vertices of the graphs of a series: 100k to 1.3 M for one worker, twice that for two, four times for four.
SIZES = {workers: [workers * 100_000 * i for i in range(1, 14)] for workers in (1, 2, 4)}
COLUMNS = "program string, vertices long, portion double, eps double, load double, iterate double, dump double, rounds long, progress double"


def generated(spark: SparkSession, nodes: int, program: str, seed: int = 42) -> Graph:
    """A graph of the usual shape for ``program``: weighted where it reads weights."""
    edges = generate.generate(spark, nodes, weighted=program in ("shortest_path", "adsorption"), seed=seed, **GRAPH)
    return Graph.of(edges, spark.range(nodes).withColumnRenamed("id", "k"))


def timed(spark: SparkSession, program: str, graph: Graph, portion: float = 1.0, eps: float | None = None, **options) -> dict:
    """Loads, runs and dumps once. ``portion`` 1 sends every active vertex; without ``eps`` the run ends when none is active."""
    began = time.monotonic()
    graph = graph.stored()
    vertices = graph.vertices.count()
    loaded = time.monotonic()
    done = programs.PROGRAMS[program](graph, eps=eps, schedule=All() if portion >= 1 else Portion(portion), **options)
    ran = time.monotonic()
    path = f"{shared_dir(spark)}/undertow/dump-{uuid.uuid4().hex}"
    adjacency.result_lines(done.final()).select("line").write.text(path)
    dumped = time.monotonic()
    delete(spark, path)
    progress = done.metrics[-1]["progress"] if done.metrics else None
    return {
        "program": program, "vertices": vertices, "portion": float(portion), "eps": eps, "load": loaded - began, "iterate": ran - loaded,
        "dump": dumped - ran, "rounds": done.rounds, "progress": progress,
    }


def grid(
    spark: SparkSession, names: Iterable[str], graphs: Iterable[Callable[[str], Graph]], portions: Iterable[float] = (1.0,),
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """A row (see COLUMNS) for every program, graph (made for the program's name) and portion.

    ``options`` are those of each program, by default its preset without size and portion.
    """
    rows = []
    for name, graph, portion in itertools.product(names, graphs, portions):
        own = {k: v for k, v in PRESETS.get(name, {}).items() if k not in ("nodes", "portion")} if options is None else options.get(name, {})
        rows.append(timed(spark, name, graph(name), portion, **own))
    return spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)
