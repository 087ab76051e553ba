"""Uneven splits: vertices dealt to parts by percentages, and renamed so that ``new % parts`` is their part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.lineage import cut

ROWS_A_RANGE = 1_000_000


def numbered(vertices: DataFrame) -> DataFrame:
    """``vertices`` (k) with ``place``, 0, 1, ... by k: ranks inside ranges of keys, and the counts of the ranges before."""
    n = vertices.count()
    dealt = vertices.select("k").repartitionByRange(max(1, -(-n // ROWS_A_RANGE)), "k").withColumn("_p", F.spark_partition_id())
    dealt = cut(dealt)  # ranges are sampled, so both uses below must see the same ones; their ids rise with the keys
    local = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("k")))
    starts = local.groupBy("_p").agg(F.max("_i").alias("_n"))
    starts = starts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    return local.join(F.broadcast(starts), "_p").select("k", (F.col("_start") + F.col("_i") - 1).cast("long").alias("place"))


def uneven_map(vertices: DataFrame, percents: list[int]) -> DataFrame:
    """(old, new, part): the first ceil(n * percent / 100) vertices by key go to part 0, and so on; the rest go to the last.

    ``new = index within the part * parts + part``.
    """
    parts, n = len(percents), vertices.count()
    edges, at = [], 0
    for p in percents:
        at = min(n, at - (-n * p // 100))
        edges.append(at)
    part, start = F.lit(parts - 1), F.lit(edges[-2] if parts > 1 else 0)
    for i in range(parts - 2, -1, -1):
        part = F.when(F.col("place") < edges[i], i).otherwise(part)
        start = F.when(F.col("place") < edges[i], edges[i - 1] if i else 0).otherwise(start)
    rows = numbered(vertices).withColumn("part", part)
    return rows.select(F.col("k").alias("old"), ((F.col("place") - start) * parts + F.col("part")).cast("long").alias("new"), "part")


def relabel_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``edges`` with both ends renamed by ``names`` (old, new)."""
    a = names.select(F.col("old").alias("src"), F.col("new").alias("_src"))
    b = names.select(F.col("old").alias("dst"), F.col("new").alias("_dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)


def unrelabel(result: DataFrame, names: DataFrame) -> DataFrame:
    """``result`` (k, ...) of a renamed graph under the old names."""
    back = names.select(F.col("new").alias("k"), "old")
    return result.join(back, "k").select(F.col("old").alias("k"), *[c for c in result.columns if c != "k"])
