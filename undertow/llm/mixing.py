"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size. Sources are clamped at ``max_epochs`` times their size; what they cannot
take is shared among the others in proportion to their weights until no source is above its cap. A source whose
target is ``e`` times its size gives every document ``floor(e)`` times, and the documents that come first in a
seeded order once more, up to the remaining fraction.

At scale: one pass reads texts and writes (id, source, size) rows to the shared folder. The seeded order is never
sorted: sizes are summed per source and slice of the 64-bit order, only the one slice that holds a source's
boundary is cut finer, by the order's bits and then by those of a row number, until it is small enough to be ranked. Only the table of sources, one row each,
is joined to the rows. The clamping loop collects one row of sums a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.llm.common import cut, read, word_count

SEED, MAX_EPOCHS, BITS = 20_231, 3, 10
LEVELS = -(-63 // BITS)


def water_fill(sources: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target`` double.

    ``total`` is shared by weight, clamped at ``max_epochs * source_size``. Sources without size get 0; if all caps
    together are below ``total``, every source gets its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight").cast("double"))).alias("weights"),
            F.count(F.when(over, True)).alias("clamped"),
        ).first()
        if row.clamped == clamped or not row.weights:
            break
        clamped, level = row.clamped, max(0.0, (total - row.taken) / row.weights)
    target = F.least(F.col("weight") * F.lit(level), cap) if level is not None else cap
    return sources.withColumn("target", target)


def _place() -> Column:
    return F.struct("order", "id", "size", "row")


def _boundary(rows: DataFrame, shares: DataFrame, small: int = 4096) -> DataFrame:
    """Per source the places (order, id, size, row) of the last row taken once more and of the first that is not.

    ``shares`` (source, part): sizes to take. One of the two places can be null; both lie in the slice of the order
    in which the running sum of sizes reaches ``part``, so one of them decides for every row.
    """
    inside = rows.join(
        shares.select(F.col("source").alias("e_source"), F.col("part").alias("left")),
        F.col("source").eqNullSafe(F.col("e_source")),
    ).drop("e_source")
    level = 0
    while True:
        used = BITS * (level + 1)
        name, shift = ("order", 63 - used) if used < 63 + BITS else ("row", 63 - used + LEVELS * BITS)
        sliced = inside.withColumn("slice", F.shiftright(name, max(0, shift)).bitwiseAND(2**BITS - 1))
        sums = sliced.groupBy("source", "left", "slice").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c"))
        before = F.sum("s").over(Window.partitionBy("source").orderBy("slice")) - F.col("s")
        at = cut(
            sums.withColumn("before", before)
            .filter("before <= left")
            .groupBy("source")
            .agg(F.max(F.struct("slice", "before", "c", "left")).alias("b"))
            .select("source", "b.slice", (F.col("b.left") - F.col("b.before")).alias("left"), F.col("b.c").alias("c"))
        )
        a = at.select(F.col("source").alias("a_source"), F.col("slice").alias("a_slice"), "left")
        inside = (
            sliced.drop("left")
            .join(a, F.col("source").eqNullSafe(F.col("a_source")) & (F.col("slice") == F.col("a_slice")))
            .select("source", "order", "id", "size", "row", "left")
        )
        level += 1
        if level == 2 * LEVELS or (at.agg(F.max("c")).first()[0] or 0) <= small:
            break
        inside = cut(inside)
    upto = F.sum("size").over(
        Window.partitionBy("source").orderBy("order", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    )
    more = F.col("upto") - F.col("size") / 2 <= F.col("left")
    return (
        inside.withColumn("upto", upto)
        .groupBy("source")
        .agg(F.max(F.when(more, _place())).alias("last"), F.min(F.when(~more, _place())).alias("first_not"))
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, repeats, taken``.

    ``size`` counts words (null text: 0). Sources in code-point order, null last and a source of its own, get
    ``weights`` in turn and share the words of all rows. ``repeats`` is how often the mix holds the row, ``taken``
    its words in the mix. The order is a hash of ``seed`` and the id, so runs agree; of rows with the same id and
    size, which run alike, some may go by a row number. A source's taken words differ from its target by half a document
    at most. Null ids hash like any other value. ``row_col`` may name a column of distinct numbers: the result then
    begins with it and it is that row number. An empty table gives an empty result.
    """
    rows = cut(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                    (F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()).alias("row"))
        .withColumn("order", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 1))
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # over one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = (
        water_fill(sources, float(total), max_epochs)
        .withColumn("whole", F.floor(F.least(epochs, F.lit(float(max_epochs)))))
        .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    edge = _boundary(rows, sources.filter("part > 0").select("source", "part")).withColumnRenamed("source", "b_source")
    marks = cut(
        sources.join(edge, F.col("source").eqNullSafe(F.col("b_source")), "left").select(
            F.col("source").alias("s_source"), "source_size", "target", "whole", "last", "first_not"
        )
    )
    more = F.coalesce(_place() < F.col("first_not"), _place() <= F.col("last"), F.lit(False))
    return (
        rows.join(marks, F.col("source").eqNullSafe(F.col("s_source")))
        .withColumn("repeats", F.col("whole") + more.cast("long"))
        .select(
            *([F.col("row").alias(row_col)] if row_col else []), F.col("id").alias(id_col), "size", "source_size", "target", "repeats",
            (F.col("repeats") * F.col("size")).alias("taken"),
        )
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("repeats")
