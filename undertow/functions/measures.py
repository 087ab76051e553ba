"""Histograms and partition measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base and least value of the logarithmic buckets.
BASE, LEAST = 1.1, 1e-9


def log_bucket(x: Column) -> Column:
    """The bucket of a value: 0 below LEAST, then by powers of BASE."""
    return F.when(x < LEAST, 0).otherwise(F.floor(F.log(x / LEAST + BASE) / F.log(F.lit(BASE))) + 1).cast("long")


def bucket_value(bucket: Column) -> Column:
    """A value that falls into ``bucket``."""
    return F.when(bucket == 0, 0.0).otherwise(F.pow(F.lit(BASE), bucket - 1) * LEAST)


def log_histogram(rows: DataFrame, column: str) -> DataFrame:
    """(bucket, n) of the values of ``column``."""
    return rows.groupBy(log_bucket(F.col(column)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_summary(buckets: DataFrame) -> DataFrame:
    """(line) per bucket: its least value and its count, for people to read."""
    value = F.format_string("%.6g", bucket_value(F.col("bucket")))
    return buckets.select(F.concat(value, F.lit(": "), F.col("n").cast("string")).alias("line"))


def mod_part(k: Column, parts: int) -> Column:
    """The part 0..parts-1 that a vertex is dealt to, for negative keys too."""
    return F.pmod(k, F.lit(parts))


def hash_part(k: Column, parts: int) -> Column:
    """The part of a key of any type, by its hash."""
    return F.pmod(F.xxhash64(k), F.lit(parts)).cast("int")


Sharder = Callable[[Column, int], Column]


def part_sizes(vertices: DataFrame, parts: int, sharder: Sharder = mod_part) -> DataFrame:
    return vertices.groupBy(sharder(F.col("k"), parts).alias("part")).agg(F.count(F.lit(1)).alias("n"))


def self_link_count(edges: DataFrame, parts: int, sharder: Sharder = mod_part) -> DataFrame:
    """(k, n): links of each vertex that stay in its part."""
    own = sharder(F.col("src"), parts) == sharder(F.col("dst"), parts)
    return edges.groupBy(F.col("src").alias("k")).agg(F.count_if(own).alias("n"))


def edge_cut(edges: DataFrame, parts: int, sharder: Sharder = mod_part) -> DataFrame:
    """(src_part, dst_part, n): links between parts."""
    return edges.groupBy(sharder(F.col("src"), parts).alias("src_part"), sharder(F.col("dst"), parts).alias("dst_part")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merged_stats(stats: DataFrame) -> DataFrame:
    """(name, total) of the counters (name, value) of any number of workers."""
    return stats.groupBy("name").agg(F.sum("value").alias("total"))
