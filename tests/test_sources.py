import pytest
from pyspark.sql import functions as F

from undertow.functions import measures
from undertow.operators import relabel
from undertow.operators.accumulate import MAX, SUM
from undertow.operators.graph import Graph
from undertow.plans import programs
from undertow.plans.engine import Program
from undertow.sources import adjacency, generate
from undertow.streaming import incremental


def edges_of(spark, rows, weighted=True):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def test_text_round_trip(spark, tmp_path):
    rows = [(0, 1, 1.0), (0, 2, 2.5), (2, 0, 3.0), (-4, 0, 1.0)]
    path = str(tmp_path / "g")
    adjacency.write_adjacency(edges_of(spark, rows), path, parts=3, weighted=True)
    vertices, back = adjacency.read_adjacency(spark, path, weighted=True, strict=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert sorted(r.k for r in vertices.collect()) == [-4, 0, 2]


def test_lines(spark):
    lines = spark.createDataFrame([("3\t1 2 ",), ("4\t",), ("5\t7  8",), ("6\t1:9 ",), ("bad",)], "value string")
    got = adjacency.parse_lines(lines)
    assert sorted(((r.src, r.dst) for r in got.collect()), key=str) == sorted([(3, 1), (3, 2), (4, None), (5, 7), (5, 8), (6, 9)], key=str)
    with pytest.raises(Exception, match="not an adjacency line"):
        adjacency.parse_lines(lines, strict=True).collect()


def test_repeated_vertices_are_an_error(spark, tmp_path):
    (tmp_path / "part0").write_text("1\t2 \n1\t3 \n")
    with pytest.raises(ValueError, match="vertex 1"):
        adjacency.read_adjacency(spark, str(tmp_path))


def test_result_round_trip(spark, tmp_path):
    state = spark.createDataFrame([(1, 2.0, 0.5), (2, None, None)], "k long, value double, delta double")
    adjacency.write_result(state, str(tmp_path / "r"), text=True)
    back = adjacency.read_result(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, back.collect())) == [(1, 2.0, 0.5), (2, None, None)]


def test_generated_graphs(spark):
    one, two = (generate.generate(spark, 300, seed=3, partitions=4).orderBy("src", "dst").collect() for _ in range(2))
    assert one == two
    assert all(r.src != r.dst and 0 <= r.dst < 300 for r in one) and len({tuple(r) for r in one}) == len(one)
    assert len({r.src for r in one}) == 300
    weights = generate.generate(spark, 50, weighted=True, weight_method=2, partitions=2)
    assert weights.filter("weight <= 0").count() == 0


def test_relabel(spark, monkeypatch):
    monkeypatch.setattr(relabel, "ROWS_A_RANGE", 7)
    vertices = spark.range(0, 50, 2).withColumnRenamed("id", "k")
    names = relabel.uneven_map(vertices, [20, 80]).orderBy("old").collect()
    assert [r.part for r in names] == [0] * 5 + [1] * 20
    assert [r.new for r in names] == [2 * i for i in range(5)] + [2 * i + 1 for i in range(20)]


def test_histogram(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (1.05,), (50.0,)], "x double")
    got = {r.bucket: r.n for r in measures.log_histogram(rows, "x").collect()}
    assert sum(got.values()) == 4 and got[0] == 1
    stats = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "name string, value double")
    assert {r.name: r.total for r in measures.merged_stats(stats).collect()} == {"a": 3.0, "b": 1.0}


def test_parts_of_negative_keys(spark):
    assert [r[0] for r in spark.range(-3, 3).select(measures.mod_part(F.col("id"), 4)).collect()] == [1, 2, 3, 0, 1, 2]


@pytest.mark.parametrize("accumulator", [SUM, MAX])
def test_streamed_changes_give_the_state_of_one_run(spark, tmp_path, accumulator):
    edges = edges_of(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)])
    graph = Graph.of(edges)
    start = F.lit(0.0) if accumulator is SUM else F.lit(None)
    program = Program(accumulator, start, start, F.lit(0.5) if accumulator is SUM else F.lit(0.0))
    changes = [[(0, 8.0)], [(1, 4.0), (0, 2.0)], [(3, 1.0), (99, 5.0)]]
    source = tmp_path / "in"
    for i, rows in enumerate(changes):
        spark.createDataFrame(rows, "k long, m double").coalesce(1).write.parquet(str(source / f"b={i}"))
    stream = spark.readStream.schema("k long, m double, b int").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = incremental.follow(stream.select("k", "m"), graph, program, str(tmp_path / "state"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = {r.k: r.value for r in incremental.latest(spark, str(tmp_path / "state")).collect()}
    want = {0: 10.0, 1: 9.0, 2: 4.5, 3: 3.25} if accumulator is SUM else {0: 8.0, 1: 8.0, 2: 8.0, 3: 8.0}
    assert got == want


def test_top_k(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, 2.0), (4, 5.0)], "k long, value double")
    assert [r.k for r in programs.top_k(rows, 3).collect()] == [4, 1, 3]
