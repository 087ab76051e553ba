"""The loop on a graph of five vertices whose results are known, and its invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from undertow.operators.graph import Graph
from undertow.operators.schedule import MinDelta, Portion, TopK
from undertow.operators import schedule
from undertow.plans import catalog, engine, programs
from undertow.plans.engine import Program, load_state, run, save_state
from undertow.operators.accumulate import SUM, Accumulator

EDGES = [(0, 1, 1.0), (0, 2, 4.0), (1, 2, 2.0), (2, 0, 1.0), (2, 3, 1.0), (3, 3, 5.0)]


@pytest.fixture(scope="module")
def tiny(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long, weight double")
    return Graph.of(edges, spark.range(5).withColumnRenamed("id", "k"))


def values(frame):
    return [None if r.value is None else round(r.value, 6) for r in frame.orderBy("k").collect()]


def test_pagerank(tiny):
    assert values(programs.pagerank(tiny, rounds=2).final()) == [0.376, 0.312, 0.536, 0.728, 0.2]


def test_shortest_path(tiny):
    assert values(programs.shortest_path(tiny, source=0).final()) == [0, 1, 3, 4, None]


def test_max_value(tiny):
    assert values(programs.max_value(tiny).final()) == [2, 2, 2, 3, 4]


def test_max_value_passes_smaller_ids_through_a_silent_source(tiny):
    assert values(programs.max_value(tiny, source=2).final()) == [1, 1, 2, 3, 4]


def test_katz(tiny):
    assert values(programs.katz(tiny, beta=0.1, seed=5.0, rounds=2).final()) == [5.05, 0.5, 0.55, 0.05, 0]
    twice = values(programs.katz(tiny, beta=0.1, seed=5.0, double_seed=True, rounds=2).final())
    assert twice[0] == 10.05


def test_adsorption(tiny):
    assert values(programs.adsorption(tiny, starts=1, damping=0.1, rounds=2).final()) == [10.4, 1.0, 4.2, 0.4, 0]


def test_components(tiny):
    assert values(programs.components(tiny).final()) == [3, 3, 3, 3, 4]


@pytest.mark.parametrize("schedule", [Portion(0.5, exact=True, small=0), Portion(0.1, small=0), Portion(0.5, small=0, seed=1), TopK(1)])
def test_schedules_reach_the_same_fixpoint(tiny, schedule):
    assert values(programs.shortest_path(tiny, source=0, schedule=schedule, max_rounds=50).final()) == [0, 1, 3, 4, None]


def test_min_delta_leaves_small_changes_pending(tiny):
    done = programs.katz(tiny, beta=0.1, seed=5.0, schedule=MinDelta(0.3), rounds=4)
    kept = done.pending().agg(F.sum("value"), F.sum("delta")).first()
    assert kept[0] > 0 and kept[1] > 0


def test_resume(tiny, tmp_path):
    half = programs.pagerank(tiny, rounds=1)
    save_state(half.state, str(tmp_path / "state"))
    again = load_state(tiny.vertices.sparkSession, str(tmp_path / "state"))
    assert values(programs.pagerank(tiny, rounds=2, start=again, done_rounds=1).final()) == [0.376, 0.312, 0.536, 0.728, 0.2]


def test_states_are_saved(tiny, tmp_path):
    programs.pagerank(tiny, rounds=2, save_to=str(tmp_path), save_every=1)
    assert {p.name for p in tmp_path.iterdir()} == {"round=1", "round=2"}


def test_metrics_and_stop(tiny):
    done = programs.pagerank(tiny, eps=1e-3, max_rounds=99)
    told = done.metrics_frame().orderBy("round").collect()
    assert done.rounds == len(told) and told[0].n_active == 5 and told[0].progress == 0
    assert math.fabs(told[-1].progress - told[-2].progress) < 0.2


def test_values_that_are_not_finite_stop_the_loop(tiny):
    program = Program(SUM, F.lit(0.0), F.lit(1e308), F.lit(100.0))
    with pytest.raises(ArithmeticError):
        run(tiny, program, max_rounds=9)


def test_empty_graph(spark):
    empty = Graph.of(spark.createDataFrame([], "src long, dst long"))
    assert values(programs.pagerank(empty, rounds=2).final()) == []


def test_partition_count_does_not_matter(spark, tiny):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert values(programs.pagerank(tiny, rounds=2).final()) == [0.376, 0.312, 0.536, 0.728, 0.2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_sources_are_spread(spark, tiny, monkeypatch):
    """Every source with more than one link is hot, so their links lie in several partitions."""
    monkeypatch.setattr(engine, "HOT_DEGREE", 1)
    assert values(programs.pagerank(tiny, rounds=2).final()) == [0.376, 0.312, 0.536, 0.728, 0.2]
    monkeypatch.setattr(engine, "HOT_ROWS", 0)
    assert values(programs.shortest_path(tiny, source=0).final()) == [0, 1, 3, 4, None]


def test_min_message_is_for_sums_only(tiny):
    with pytest.raises(ValueError):
        programs.shortest_path(tiny, source=0, min_message=0.1)
    # 0.08 is dropped wherever a vertex has two links
    assert values(programs.pagerank(tiny, rounds=2, min_message=0.1).final()) == [0.2, 0.2, 0.36, 0.488, 0.2]



def test_a_message_of_the_least_size_is_kept(spark):
    """0.2 * 0.8 / 40 is 0.004; with 1 - 0.8 for 0.2 it is a little less."""
    star = Graph.of(spark.range(1, 41).selectExpr("cast(0 as long) as src", "id as dst"))
    got = values(programs.pagerank(star, rounds=1, min_message=0.004).final())
    assert got == [0.2] + [0.204] * 40


def test_own_accumulator(tiny):
    """The last digit decides which id is the largest."""
    def larger(a, b):
        return F.when((a % 4) * 10 + a >= (b % 4) * 10 + b, a).otherwise(b)

    own = Accumulator.custom("last digit", larger, lambda m: F.max_by(m, (m % 4) * 10 + m))
    k = F.col("k").cast("double")
    done = run(tiny, Program(own, F.lit(None), k, F.lit(0.0)))
    assert values(done.final()) == [2, 2, 2, 3, 4]


def test_own_report_and_end(tiny):
    seen = []

    def until(before, now, rounds):
        seen.append((before, now, rounds))
        return now >= 4

    done = programs.pagerank(tiny, report=F.count_if(F.col("value") > 0), until=until)
    assert done.rounds == 1 and [x[1] for x in seen] == [0, 5]


def test_trigger_sees_every_change(tiny):
    done = programs.shortest_path(tiny, source=0, trigger=lambda k, value, new: F.when(k == 2, new + 100).otherwise(new))
    # vertex 2 is reached at 4 (kept as 104) and then at 3, which the first value doesn't hold back
    assert [r.value for r in done.state.orderBy("k").collect()] == [0, 1, 103, 4, None]


def test_trigger_sees_the_last_change(spark):
    """A chain longer than the rounds: the change that the last round sends is folded at the end."""
    chain = Graph.of(spark.range(9).selectExpr("id as src", "id + 1 as dst", "cast(1.5 as double) as weight"))
    done = programs.shortest_path(chain, source=0, rounds=3, trigger=lambda k, value, new: F.floor(new))
    assert values(done.final()) == [0, 1, 3, 4] + [None] * 6


def test_trigger_query_on_deep_links(spark, monkeypatch):
    """The query's SQL has paths of 12 links, and the 12th round's changes are still pending after 12 rounds."""
    chain = Graph.of(spark.range(20).selectExpr("id as src", "id + 1 as dst", "cast(1.5 as double) as weight"))
    monkeypatch.setattr(catalog, "_parts", lambda spark, sf_dir: chain)
    got = {r.k: r.value for r in catalog.QUERIES["trigger_floors_values"](spark, "").collect()}
    assert got == {k: math.floor(1.5 * k) if k <= 12 else None for k in range(21)}


def test_old_states_are_deleted(tiny, monkeypatch):
    kept = []
    monkeypatch.setattr(engine, "forget", kept.append)
    done = programs.pagerank(tiny, rounds=4)
    assert len({id(x) for x in kept if x is not None}) == 4 and all(x is not done.state for x in kept)


@pytest.mark.parametrize("few", [0, 7, 10_000])
def test_nth_largest(spark, monkeypatch, few):
    monkeypatch.setattr(schedule, "FEW", few)
    monkeypatch.setattr(schedule, "CUTS", 4)
    rng = random.Random(few)
    values = [float(rng.choice([1, 2, 2.5, rng.randrange(300)])) for _ in range(500)] + [float("inf"), float("-inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").coalesce(2)
    order = sorted(values, reverse=True)
    for place in (0, 1, 7, 250, 499, 502, 503):
        assert schedule.nth_largest(df, "x", place) == (order[place] if place < 503 else None)
    assert schedule.nth_largest(df.limit(0), "x", 0) is None
