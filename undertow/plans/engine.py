"""The delta-accumulative loop.

Every vertex has a value and a pending change. A round takes the scheduled vertices, folds their change into their
value, sends g(change) along their links, and combines what arrives with what is still pending. Because combining is
associative and commutative and g distributes over it, rounds and schedules reach the same fixpoint.

Edges are written once; links are kept in memory partitioned by their source and come back from those files where an
executor is lost. Links of a source with more than HOT_DEGREE of them are spread over several partitions, each of which
gets the source's change. There are as many of these partitions as the links fill, LINKS_EACH in one. Per round there
is one join of the sending vertices with the links, hashed on the side of the vertices, and one aggregation over state
and messages together: state rows and messages meet in a single shuffle by vertex, with messages combined on the map
side. The new state is written to the shared folder, so plans don't grow and lost executors cost one round at most; the
state before the last is deleted. What decides on the next round is counted while the state is written.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from undertow.lineage import cut, forget
from undertow.operators.accumulate import Accumulator
from undertow.operators.graph import Graph
from undertow.operators.schedule import All


HOT_DEGREE = 1_000_000
HOT_ROWS = 200_000  # of 12 bytes, that are broadcast
LINKS_EACH = 250_000  # links of a partition in memory


@dataclass(frozen=True)
class Program:
    """``init_value`` and ``init_delta`` are expressions of k; ``coefficient`` of weight and degree, fixed per link.

    A message is ``delta * coefficient`` for SUM and ``delta + coefficient`` for MIN and MAX, unless ``message`` says
    otherwise as a function of the columns delta and coefficient.
    """

    accumulator: Accumulator
    init_value: Column
    init_delta: Column
    coefficient: Column
    message: Callable[[Column, Column], Column] | None = None

    def send(self, delta: Column, coefficient: Column) -> Column:
        if self.message:
            return self.message(delta, coefficient)
        return delta + coefficient if self.accumulator.idempotent else delta * coefficient


@dataclass
class Result:
    state: DataFrame  # k, value, delta, best_sent
    accumulator: Accumulator
    rounds: int
    metrics: list[dict] = field(default_factory=list)
    trigger: Callable[[Column, Column, Column], Column] | None = None

    def final(self) -> DataFrame:
        """(k, value, delta) with the pending change folded into the value, as a round would fold it: the trigger sees it."""
        value = _folded(self.accumulator, self.trigger)
        return self.state.select("k", value.alias("value"), F.lit(None).cast("double").alias("delta"))

    def pending(self) -> DataFrame:
        """(k, value, delta) as the loop left it."""
        return self.state.select("k", "value", "delta")

    def metrics_frame(self) -> DataFrame:
        schema = "round long, n_active long, n_sent long, sent_delta double, progress double, seconds double"
        return self.state.sparkSession.createDataFrame(self.metrics, schema)


def progress(value: Column, accumulator: Accumulator) -> Column:
    """The sum of the values that aren't the identity."""
    there = value.isNotNull() if accumulator.idempotent else value != 0
    return F.coalesce(F.sum(F.when(there, value)), F.lit(0.0))


def run(
    graph: Graph,
    program: Program,
    rounds: int | None = None,
    eps: float | None = None,
    schedule=None,
    max_rounds: int | None = None,
    start: DataFrame | None = None,
    done_rounds: int = 0,
    save_to: str | None = None,
    save_every: int = 0,
    metrics: bool = False,
    min_message: float = 0.0,
    report: Column | None = None,
    until: Callable[[float | None, float, int], bool] | None = None,
    trigger: Callable[[Column, Column, Column], Column] | None = None,
    links: int | None = None,
) -> Result:
    """Runs ``program``: exactly ``rounds`` rounds (fewer if nothing is left to send), or until progress settles.

    Without ``rounds``, the loop stops when nothing is active or, with ``eps``, when progress changes by no more than
    ``eps`` between two rounds, however many rounds that takes; if ``max_rounds`` is given and the loop would need more,
    it raises instead of returning an unfinished state. ``start`` resumes from a state (see ``load_state``); ``save_every`` writes the state to
    ``save_to`` that often. Messages below ``min_message`` in size are dropped, which loses their mass; the default keeps
    all (``MinDelta`` holds small changes back without loss), and only SUM can do without small messages: to MIN and MAX
    they may be the ones that count, so there it is an error. A value that isn't finite stops the loop with an error.

    Progress is ``report``, an aggregate over the state's k, value and delta, by default the sum of values. ``until``
    decides from the progress before (None at first), the progress now and the rounds done whether that was enough, in
    place of ``eps``. ``trigger`` sees every vertex whose value a round changes, as the columns k, value and new value,
    and gives the value that it gets instead.

    ``links`` bounds the paths that changes take (MIN, MAX and custom accumulators): what a vertex receives is kept as
    ``later`` until every change of as many links as before has been sent, in as many rounds as the schedule takes for
    it. So the end is that of ``links`` rounds that send everything, whatever the schedule. It goes with neither
    ``rounds`` nor ``start``.
    """
    acc, schedule = program.accumulator, schedule or All()
    if links is not None and not (acc.idempotent and rounds is None and start is None):
        raise ValueError("a bound on links is for the whole run of an idempotent program")
    longest, taken = links, 0
    if min_message and acc.idempotent:
        raise ValueError("only a sum can do without small messages")
    graph = graph.stored()
    links, salts = _links(graph, program)
    if start is None:
        state = graph.vertices.select(
            "k", program.init_value.cast("double").alias("value"), program.init_delta.cast("double").alias("delta"),
            F.lit(None).cast("double").alias("best_sent"),
        )
    else:
        state = start.select("k", "value", "delta", "best_sent")
    told, last, done, older = [], None, done_rounds, None
    active = acc.active(F.col("delta"), F.col("best_sent") if acc.idempotent else None)
    watch = metrics or rounds is None or not isinstance(schedule, All)
    if longest is not None:
        state = state.withColumn("later", acc.identity)
    counted = [] if longest is None else [
        F.count_if(acc.active(F.col("later"), F.col("best_sent"))).alias("n_later"),
        F.coalesce(F.sum(F.when(acc.active(F.col("later"), F.col("best_sent")), F.col("later"))), F.lit(0.0)).alias("later_delta"),
    ]
    counted += [
        F.count_if(active).alias("n_active"),
        F.coalesce(F.sum(F.when(active, F.col("delta"))), F.lit(0.0)).alias("sent_delta"),
        (progress(F.col("value"), acc) if report is None else report).alias("progress"),
    ]
    state, now = _written(state, counted if watch else [], report is None)
    try:
        while rounds is None or done < rounds:
            began = time.monotonic()
            if longest is not None:
                n_later, later_delta = now.pop("n_later"), now.pop("later_delta")
                if not now["n_active"]:  # all that came over ``taken`` links is sent; what it caused is next
                    state, taken = _next(state, acc), taken + 1
                    now |= {"n_active": n_later, "sent_delta": later_delta}
                if taken >= longest:
                    break
            rows = state.withColumn("active", active).withColumn("prio", acc.priority(F.col("value"), F.col("delta")))
            if watch:
                if not math.isfinite(now["progress"]):
                    raise ArithmeticError(f"the values stopped being finite after {done} rounds")
                if not now["n_active"]:
                    break
                if rounds is None and until is not None and until(last, now["progress"], done):
                    break
                if rounds is None and until is None and eps is not None and last is not None and done > 1 and math.fabs(now["progress"] - last) <= eps:
                    break
                last = now["progress"]
            if rounds is None and max_rounds is not None and done >= max_rounds:
                raise RuntimeError(f"not settled after max_rounds={max_rounds} rounds: {now['n_active']} vertices are still active")
            chosen = schedule.select(rows)
            seen = None if isinstance(schedule, All) else Observation()
            if seen and not getattr(schedule, "always", False) and rows.filter(chosen).isEmpty():
                chosen = F.col("active")  # never stand still while something is active
            before = state
            after = _round(rows.withColumn("sent", chosen), links, salts, program, min_message, trigger, seen)
            shown, (state, now) = now, _written(after, counted if watch else [], report is None)
            forget(older)
            older, done = before, done + 1
            if seen:
                shown |= seen.get
            if watch:
                told.append({"round": done, "n_sent": shown["n_active"], **shown, "seconds": time.monotonic() - began})
            if save_to and save_every and done % save_every == 0:
                save_state(state, f"{save_to}/round={done}")
    finally:
        links.unpersist()
        forget(older)
    if longest is not None:
        state = _same_files(state, state.drop("later"))
    return Result(state, acc, done, told, trigger)


def _written(df: DataFrame, told: list[Column], observed: bool) -> tuple[DataFrame, dict]:
    """``df`` written, and the aggregates ``told`` of its rows: taken in the same job, or in one of its own (a caller's
    aggregates may be of a kind that can't be observed)."""
    if not told:
        return cut(df), {}
    if not observed:
        out = cut(df)
        return out, out.agg(*told).first().asDict()
    seen = Observation()
    out = cut(df.observe(seen, *told))
    return out, dict(seen.get)


def _links(graph: Graph, program: Program) -> tuple[DataFrame, DataFrame | None]:
    """Links (src, salt, dst, coefficient) in memory by source, and the salts (hot, salts) of hot sources if there are any."""
    spark = graph.edges.sparkSession
    degree = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    degree = cut(degree)
    salts, salt = F.ceil(F.col("degree") / HOT_DEGREE).cast("int"), F.lit(0)
    hot = degree.filter(F.col("degree") > HOT_DEGREE).select(F.col("src").alias("hot"), salts.alias("salts"))
    n_hot = hot.count()
    if n_hot:
        salt = F.pmod(F.xxhash64("dst"), salts).cast("int")
    links = graph.edges.join(degree, "src").select("src", salt.alias("salt"), "dst", program.coefficient.cast("double").alias("coefficient"))
    # a number keeps them from being merged into few; it goes with the links, as every round starts a task for each
    n = max(1, math.ceil((degree.agg(F.sum("degree")).first()[0] or 0) / LINKS_EACH))
    links = links.repartition(n, "src", "salt").persist(StorageLevel.MEMORY_AND_DISK)
    if not n_hot:
        return links, None
    return links, F.broadcast(hot) if n_hot <= HOT_ROWS else hot


def _folded(acc: Accumulator, trigger: Callable[[Column, Column, Column], Column] | None) -> Column:
    """The value with the pending change folded in, or what ``trigger`` makes of it where that changes the value."""
    value = acc.combine(F.col("value"), F.col("delta"))
    if trigger is None:
        return value
    return F.when(value.eqNullSafe(F.col("value")), value).otherwise(trigger(F.col("k"), F.col("value"), value).cast("double"))


def _round(
    rows: DataFrame, links: DataFrame, salts: DataFrame | None, program: Program, min_message: float = 0.0,
    trigger: Callable[[Column, Column, Column], Column] | None = None, seen: Observation | None = None,
) -> DataFrame:
    acc = program.accumulator
    sending = rows.filter("sent").select("k", "delta", F.lit(0).alias("part"))
    if salts is not None:
        every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        sending = sending.join(salts, F.col("k") == F.col("hot"), "left").select("k", "delta", F.explode(every).alias("part"))
    messages = sending.hint("shuffle_hash").join(links, (sending.k == links.src) & (sending.part == links.salt)).select(
        F.col("dst").alias("k"), program.send(F.col("delta"), F.col("coefficient")).alias("m")
    )
    if min_message:
        messages = messages.filter(F.abs("m") >= min_message)
    spent = F.col("sent") | ~F.col("active") if acc.idempotent else F.col("sent")
    value = _folded(acc, trigger)
    told = [F.count_if("sent").alias("n_sent"), F.coalesce(F.sum(F.when(F.col("sent"), F.col("delta"))), F.lit(0.0)).alias("sent_delta")]
    kept = (rows.observe(seen, *told) if seen else rows).select(
        "k",
        F.when(F.col("sent"), value).otherwise(F.col("value")).alias("value"),
        F.when(F.col("sent"), acc.combine(F.col("best_sent"), F.col("delta"))).otherwise(F.col("best_sent")).alias("best_sent"),
        F.when(spent, acc.identity).otherwise(F.col("delta")).alias("m"),
        *[c for c in rows.columns if c == "later"],
    )
    none = F.lit(None).cast("double")
    if "later" in kept.columns:
        messages = messages.withColumnRenamed("m", "later")
    meet = kept.unionByName(messages.select(*[c if c in messages.columns else none.alias(c) for c in kept.columns]))
    return meet.groupBy("k").agg(
        F.max("value").alias("value"), acc.aggregate(F.col("m")).alias("delta"), F.max("best_sent").alias("best_sent"),
        *[acc.aggregate(F.col(c)).alias(c) for c in kept.columns if c == "later"],
    )


def _next(state: DataFrame, acc: Accumulator) -> DataFrame:
    """``state`` with what came later as the pending changes; those before are sent, or beaten by others that were."""
    return _same_files(state, state.select("k", "value", F.col("later").alias("delta"), "best_sent", acc.identity.alias("later")))


def _same_files(state: DataFrame, out: DataFrame) -> DataFrame:
    """``out``, which reads the files of ``state``, for ``forget``."""
    out._undertow_path = getattr(state, "_undertow_path", None)
    return out


def save_state(state: DataFrame, path: str) -> None:
    """Writes a whole state; the files count once Spark has committed them."""
    state.write.mode("overwrite").parquet(path)


def load_state(spark, path: str) -> DataFrame:
    return spark.read.schema("k long, value double, delta double, best_sent double").parquet(path)
