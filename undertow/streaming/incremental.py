"""Incremental runs: changes that arrive on a stream are folded into a stored state.

A cyclic dataflow is not a streaming query, so each micro-batch of new changes (k, m) is combined with the stored
pending changes and the loop runs on from there. SUM programs are linear and MIN and MAX programs monotone, so the
state after any number of batches is that of one run over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from undertow.lineage import delete, forget
from undertow.operators.graph import Graph
from undertow.plans.engine import Program, load_state, run, save_state


def absorb(state: DataFrame, changes: DataFrame, program: Program) -> DataFrame:
    """``state`` with ``changes`` (k, m) added to what is pending; changes for unknown vertices are left out."""
    acc = program.accumulator
    summed = changes.groupBy("k").agg(acc.aggregate(F.col("m").cast("double")).alias("m"))
    return state.join(summed, "k", "left").select("k", "value", acc.combine(F.col("delta"), F.col("m")).alias("delta"), "best_sent")


def follow(changes: DataFrame, graph: Graph, program: Program, path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts a query that absorbs each micro-batch of ``changes`` and writes the new state under ``path``.

    Batch ``i`` reads the state of batch ``i - 1`` and writes ``path/batch=i``, so a batch that is run again after a
    failure gives the same state; the state of batch ``i - 2`` is then deleted.
    """
    spark, graph = graph.vertices.sparkSession, graph.stored()

    def batch(rows: DataFrame, number: int) -> None:
        if number == 0:
            none = program.accumulator.identity
            state = graph.vertices.select("k", program.init_value.cast("double").alias("value"), none.alias("delta"), F.lit(None).cast("double").alias("best_sent"))
        else:
            state = load_state(spark, f"{path}/batch={number - 1}")
        done = run(graph, program, start=absorb(state, rows, program), **options)
        save_state(done.state, f"{path}/batch={number}")
        forget(done.state)
        if number > 1:
            delete(spark, f"{path}/batch={number - 2}")

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark, path: str) -> DataFrame:
    """The newest state under ``path``."""
    whole = spark.read.option("basePath", path).parquet(path)
    newest = whole.agg(F.max("batch")).first()[0]
    return load_state(spark, f"{path}/batch={newest}")
