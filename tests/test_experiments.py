"""Presets, generated series and the grid of runs."""

from pyspark.sql import functions as F

from undertow.functions import measures
from undertow.plans import experiments, programs


def test_presets_name_programs():
    assert set(experiments.PRESETS) <= set(programs.PROGRAMS)
    assert experiments.SIZES[1][0] == 100_000 and experiments.SIZES[4][-1] == 5_200_000


def test_grid(spark):
    rows = experiments.grid(
        spark, ["pagerank", "shortest_path"], [lambda name: experiments.generated(spark, 60, name)], options={"pagerank": {"eps": 0.5}, "shortest_path": {"source": 0}}
    ).collect()
    assert [(r.program, r.vertices) for r in rows] == [("pagerank", 60), ("shortest_path", 60)]
    assert all(min(r.load, r.iterate, r.dump) > 0 and r.rounds >= 1 for r in rows) and 0 < rows[0].progress <= 60


def test_own_program_and_sharder(spark):
    @programs.program
    def halves(graph, **options):
        return programs.pagerank(graph, damping=0.5, **options)

    try:
        graph = experiments.generated(spark, 20, "halves")
        assert experiments.timed(spark, "halves", graph, rounds=1)["rounds"] == 1
    finally:
        del programs.PROGRAMS["halves"]
    sizes = measures.part_sizes(spark.range(100).select(F.col("id").cast("string").alias("k")), 7, measures.hash_part).collect()
    assert sum(r.n for r in sizes) == 100 and {r.part for r in sizes} <= set(range(7))


def test_histogram_summary(spark):
    buckets = measures.log_histogram(spark.createDataFrame([(0.0,), (2.0,), (2.0,)], "x double"), "x")
    lines = sorted(r.line for r in measures.histogram_summary(buckets).collect())
    assert len(lines) == 2 and lines[0].startswith("0.0") and lines[0].endswith(": 1") and lines[1].endswith(": 2")
