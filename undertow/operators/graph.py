"""Graphs as two DataFrames: ``vertices`` (k) and ``edges`` (src, dst, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.lineage import cut, forget

RANGE_ROWS = 500_000  # rows in a row that one window orders


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    given: DataFrame | None = None  # vertices before the ends of edges were added
    closed: bool = False  # whether they were
    files: bool = False

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None, weight: Column | None = None) -> Graph:
        """Edges with columns src, dst and perhaps weight; the vertices are those given and all ends of edges."""
        if weight is None:
            weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
        edges = edges.select("src", "dst", weight.cast("double").alias("weight"))
        return Graph(vertex_closure(edges, vertices), edges, vertices, True)

    def stored(self) -> Graph:
        """The graph with its edges written once, and its vertices made from these."""
        if self.files:
            return self
        edges = cut(self.edges)
        return Graph(vertex_closure(edges, self.given) if self.closed else self.vertices, edges, self.given, self.closed, True)

    def symmetric(self) -> Graph:
        return Graph(self.vertices, symmetrize(self.edges))


def vertex_closure(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """All vertices: the given ones (column k) and both ends of every edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("k"))
    return (ends if vertices is None else vertices.select("k").unionByName(ends)).distinct()


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back).distinct()


def successors(rows: DataFrame, order: str, column: str) -> DataFrame:
    """(src, dst): ``column`` of every row, and of the next row by ``order``; NULL after the last. Nulls come last.

    Rows are cut into ranges of about RANGE_ROWS at quantiles of ``order``, each of which is a window of its own, and the
    first row of a range follows the last of the range before. Only these reach one task together.
    """
    rows = rows.select(F.col(order).alias("at"), F.col(column).alias("x"))
    n = rows.count()
    cuts = []
    if n > RANGE_ROWS:
        parts = -(-n // RANGE_ROWS)
        cuts = sorted(set(rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or ()))
    found = F.lit(0)
    if cuts:  # the range of a row is the number of cuts below it
        held = rows.sparkSession.createDataFrame([(cuts,)], f"cuts array<{rows.schema['at'].dataType.simpleString()}>")
        rows = rows.crossJoin(F.broadcast(held))
        found = F.when(F.col("at").isNull(), len(cuts)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("at"))))
    rows = rows.select("at", "x", found.alias("part"))
    own = Window.partitionBy("part").orderBy(F.col("at").asc_nulls_last())
    told = rows.select("x", "part", F.lead("x").over(own).alias("dst"), F.lead(F.lit(True)).over(own).isNull().alias("last"), (F.row_number().over(own) == 1).alias("first"))
    if not cuts:
        return told.select(F.col("x").alias("src"), "dst")
    told = cut(told)
    ends = Window.orderBy("part")
    heads = told.filter("first").select(F.col("x").alias("head"), (F.lag("part").over(ends)).alias("part"), F.lit(True).alias("last"))
    joined = told.join(F.broadcast(heads), ["part", "last"], "left")
    return joined.select(F.col("x").alias("src"), F.when(F.col("last"), F.col("head")).otherwise(F.col("dst")).alias("dst"))


def shortcuts(edges: DataFrame) -> DataFrame:
    """A link from every vertex to the end of the path that leads from it to ever larger neighbours.

    Every vertex points to its largest neighbour if that is larger than itself, and pointers are doubled until all point
    to ends: as many steps as the logarithm of the longest path, each one join of those that don't yet with all pointers.
    The links join what was joined already, so components stay as they are.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = both.groupBy("src").agg(F.max("dst").alias("dst")).filter("dst > src")
    pointers, before = cut(found.withColumn("done", F.lit(False))), None
    while True:
        far = pointers.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        jumped = pointers.filter("NOT done").join(far, "dst", "left")
        after = jumped.select("src", F.coalesce("far", "dst").alias("dst"), F.col("far").isNull().alias("done"))
        forget(before)
        before, pointers = pointers, cut(after.unionByName(pointers.filter("done")))
        if pointers.filter("NOT done").isEmpty():
            forget(before)
            return pointers.select("src", "dst")


def dedup_links(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def out_degree(edges: DataFrame) -> DataFrame:
    """(k, degree) of vertices with links; parallel links count."""
    return edges.groupBy(F.col("src").alias("k")).agg(F.count(F.lit(1)).alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("k")).agg(F.count(F.lit(1)).alias("degree"))


def normalised(edges: DataFrame) -> DataFrame:
    """Weights divided by their sum over each vertex's links."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("_total"))
    return edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("_total")).alias("weight"))


def expand(active: DataFrame, edges: DataFrame, message: Column) -> DataFrame:
    """Messages (k, m): every active row (k, delta) sent along its links (src, dst, ...)."""
    return active.join(edges, active.k == edges.src).select(F.col("dst").alias("k"), message.alias("m"))


def apply_messages(state: DataFrame, messages: DataFrame, accumulator) -> DataFrame:
    """``state`` (k, value, delta) with the combined messages (k, m) of each vertex added to its pending change."""
    summed = messages.groupBy("k").agg(accumulator.aggregate(F.col("m")).alias("m"))
    return state.join(summed, "k", "left").select("k", "value", accumulator.combine(F.col("delta"), F.col("m")).alias("delta"))
