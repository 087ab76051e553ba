"""The loop runs until it has settled, or says that it hasn't."""

import pytest
from pyspark.sql import functions as F

from undertow.lineage import cut
from undertow.operators.accumulate import SUM
from undertow.operators import graph as g
from undertow.operators.graph import Graph
from undertow.operators.schedule import TopK
from undertow.plans import catalog, engine, programs


def chain(spark, n):
    """0 -> 1 -> ... -> n - 1, every link of weight 1."""
    return Graph.of(spark.range(n - 1).selectExpr("id as src", "id + 1 as dst", "cast(1 as double) as weight"))


def test_reaching_max_rounds_raises(spark):
    with pytest.raises(RuntimeError, match="max_rounds=3"):
        programs.shortest_path(chain(spark, 8), source=0, schedule=TopK(1), max_rounds=3)
    with pytest.raises(RuntimeError, match="max_rounds=3"):
        programs.pagerank(chain(spark, 8), eps=0.0, max_rounds=3)


def test_max_rounds_that_suffice(spark):
    done = programs.shortest_path(chain(spark, 8), source=0, schedule=TopK(1), max_rounds=8)
    assert done.rounds == 8 and {r.k: r.value for r in done.final().collect()} == {k: float(k) for k in range(8)}


@pytest.mark.parametrize("name", ["topk_equals_full", "portion_equals_full"])
def test_queries_set_no_bound(spark, monkeypatch, name):
    """605 rounds of TopK(500) lead to the fixpoint on sf0.1, too many for a test."""
    given = {}

    def shortest_path(graph, **options):
        given.update(options)
        return real(graph, **options)

    real = programs.shortest_path
    monkeypatch.setattr(programs, "shortest_path", shortest_path)
    monkeypatch.setattr(catalog, "_parts", lambda spark, sf_dir: chain(spark, 4))
    assert {r.k: r.value for r in catalog.QUERIES[name](spark, "").collect()} == {k: float(k) for k in range(4)}
    assert given.get("rounds") is None and given.get("max_rounds") is None


def test_links_lie_in_as_many_partitions_as_they_fill(spark, monkeypatch):
    """Every round starts a task for each of them, however many shuffle partitions the session asks for."""
    graph, program = chain(spark, 9).stored(), engine.Program(SUM, F.lit(0.0), F.lit(1.0), F.lit(0.5))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for each, want in ((100, 1), (4, 2), (1, 8)):
            monkeypatch.setattr(engine, "LINKS_EACH", each)
            links, _ = engine._links(graph, program)
            assert links.rdd.getNumPartitions() == want and links.count() == 8
            links.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_round_reads_its_state_once(spark, monkeypatch):
    """What decides on the next round is counted while the state is written, so no round needs a job for that."""
    seen = []
    monkeypatch.setattr(engine, "cut", lambda df: seen.append("CollectMetrics" in df._jdf.queryExecution().analyzed().toString()) or cut(df))
    done = programs.pagerank(chain(spark, 4), eps=1e-3)
    assert [r["n_sent"] for r in done.metrics][:4] == [4, 3, 2, 1]
    assert sum(seen) == done.rounds + 1


@pytest.mark.parametrize("name", ["topk_equals_full", "portion_equals_full"])
def test_paths_have_as_many_links_as_in_the_sql(spark, monkeypatch, name):
    """A chain of 15 links, and a dear link to its 3rd vertex that lets paths of 12 links reach two vertices more."""
    edges = [(i, i + 1, 1.0) for i in range(15)] + [(0, 3, 9.0)]
    graph = Graph.of(spark.createDataFrame(edges, "src long, dst long, weight double"))
    monkeypatch.setattr(catalog, "_parts", lambda spark, sf_dir: graph)
    got = {r.k: r.value for r in catalog.QUERIES[name](spark, "").collect()}
    assert got == {k: float(k) for k in range(13)} | {13: 19.0, 14: 20.0, 15: None}


def test_a_bound_on_links_is_for_whole_runs_of_idempotent_programs(spark):
    for run in (lambda: programs.pagerank(chain(spark, 4), links=2), lambda: programs.shortest_path(chain(spark, 4), source=0, links=2, rounds=2)):
        with pytest.raises(ValueError):
            run()


@pytest.mark.parametrize("each", [1, 7, 1000])
def test_successors_over_ranges(spark, monkeypatch, each):
    """The next row by order, over the borders of ranges too."""
    monkeypatch.setattr(g, "RANGE_ROWS", each)
    order = [(i * 37) % 101 * 3 for i in range(101)]
    rows = spark.createDataFrame([(at, None if at == 30 else at % 11) for at in order], "at long, x long")
    by = {r.at: r.x for r in rows.collect()}
    want = sorted(((by[a], by.get(b)) for a, b in zip(sorted(by), [*sorted(by)[1:], None])), key=str)
    assert sorted(((r.src, r.dst) for r in g.successors(rows, "at", "x").collect()), key=str) == want
    assert g.successors(rows.limit(0), "at", "x").count() == 0


def test_no_window_orders_a_whole_table(spark, monkeypatch):
    monkeypatch.setattr(g, "RANGE_ROWS", 50)
    told = []
    monkeypatch.setattr(g, "cut", lambda df: told.append(df) or cut(df))
    edges = catalog._user_edges(spark, "/root/testdata/sf0.001")
    sizes = told[0].groupBy("part").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 100
    assert edges.exceptAll(catalog._sql(spark, "/root/testdata/sf0.001", catalog.USER_EDGES)).count() == 0
    assert edges.count() == catalog._sql(spark, "/root/testdata/sf0.001", catalog.USER_EDGES).count()


def test_shortcuts_lead_to_the_ends_of_paths(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 400), (450, 500), (600, 450), (7, 7)]
    got = {(r.src, r.dst) for r in g.shortcuts(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(i, 300) for i in range(300)} | {(400, 500), (450, 600)}  # 500 is larger than its neighbours 400 and 450
    assert g.shortcuts(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """A chain of 5000 links; shortcuts over 1024 of them at most would still leave a round for every 1024."""
    rounds, real = [], programs.components

    def components(graph, **options):
        done = real(graph, **options)
        rounds.append(done.rounds)
        return done

    monkeypatch.setattr(programs, "components", components)
    monkeypatch.setattr(catalog, "_chains", lambda spark, sf_dir: chain(spark, 5000))
    got = catalog.QUERIES["components"](spark, "").collect()
    assert len(got) == 5000 and {r.value for r in got} == {4999.0} and rounds[0] <= 4


@pytest.fixture
def stores(spark, monkeypatch):
    """The times that links which no files hold yet are written."""
    seen, real = [], Graph.stored

    def stored(graph):
        seen.append(graph.files)
        return real(graph)

    monkeypatch.setattr(Graph, "stored", stored)
    monkeypatch.setattr(catalog, "_parts", lambda spark, sf_dir: chain(spark, 6))
    return lambda: seen.count(False)


def test_resuming_derives_the_links_once(spark, stores):
    assert catalog.QUERIES["resume_equals_straight"](spark, "").count() == 6 and stores() == 1


def test_a_grid_derives_the_links_once(spark, stores):
    assert catalog.QUERIES["experiment_grid"](spark, "").count() == 4 and stores() == 1
