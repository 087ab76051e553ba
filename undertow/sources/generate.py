"""Seeded synthetic graphs with lognormal degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEGREE = 10_000


def generate(
    spark: SparkSession, n: int, weighted: bool = False, degree_m: float = 0.0, degree_s: float = 2.0,
    weight_m: float = 0.0, weight_s: float = 1.0, weight_method: int = 1, seed: int = 42, partitions: int | None = None,
) -> DataFrame:
    """(src, dst[, weight]): each of ``n`` vertices has ceil(lognormal) links, MAX_DEGREE at most, to uniform others.

    Unweighted links of a vertex are distinct; weighted ones may be parallel, with weight log(1 + lognormal), or
    1 / lognormal with ``weight_method`` 2. Links are drawn per partition of the range, without a shuffle but for the
    removal of repeated ones, so equal ``seed`` and ``partitions`` give equal graphs.
    """
    nodes = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism)
    degree = F.least(F.ceil(F.exp(degree_m + degree_s * F.randn(seed))), F.lit(MAX_DEGREE)).cast("int")
    links = nodes.select(F.col("id").alias("src"), degree.alias("degree")).select("src", F.explode(F.sequence(F.lit(1), "degree")).alias("i"))
    # a place among the n - 1 others, moved past the vertex itself
    other = F.floor(F.rand(seed + 1) * (n - 1)).cast("long")
    links = links.withColumn("other", other).filter(F.lit(n > 1))
    links = links.withColumn("dst", F.col("other") + (F.col("other") >= F.col("src")).cast("long"))
    if not weighted:
        return links.select("src", "dst").dropDuplicates()
    x = F.exp(weight_m + weight_s * F.randn(seed + 2))
    weight = F.log1p(x) if weight_method == 1 else 1 / x
    return links.select("src", "dst", weight.alias("weight"))
