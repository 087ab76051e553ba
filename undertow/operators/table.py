"""Keyed tables as DataFrames: a new table for every change, joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(table: DataFrame, rows: DataFrame, order: Column) -> DataFrame:
    """``table`` (k, ...) with ``rows`` of the same columns inserted or replacing rows of their key.

    Of several rows with one key the last by ``order``, an expression of ``rows``, counts; they are combined before the
    shuffle, so a key that is put very often costs one row per task.
    """
    rest = [c for c in table.columns if c != "k"]
    newest = rows.groupBy("k").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("k", *[F.col(f"_row.{c}").alias(c) for c in rest])
    return remove(table, newest.select("k")).unionByName(newest)


def update(table: DataFrame, rows: DataFrame, field: str) -> DataFrame:
    """``table`` with ``field`` overwritten by ``rows`` (k, field); keys the table doesn't have are left out."""
    new = rows.select("k", F.col(field).alias("_new"), F.lit(True).alias("_hit"))
    value = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(field))
    joined = table.join(new, "k", "left")
    return joined.select(*[value.alias(c) if c == field else c for c in table.columns])


def remove(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("k"), "k", "left_anti")


def clear(table: DataFrame) -> DataFrame:
    """A table of the same columns without rows."""
    return table.limit(0)


def contains(table: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (k) with ``found``."""
    there = table.select("k", F.lit(True).alias("_hit")).distinct()
    return keys.select("k").join(there, "k", "left").select("k", F.coalesce("_hit", F.lit(False)).alias("found"))
