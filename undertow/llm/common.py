"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.lineage import cut, forget, shared_dir

__all__ = ["WORD", "WS", "code_points", "cut", "forget", "is_empty", "read", "shared_dir", "spread", "utf8", "word_count"]

#: The ASCII white space that separates words in every contract here.
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPREAD_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def code_points(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out over all cores where what it reads is small: a small file is one partition, however costly its rows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
