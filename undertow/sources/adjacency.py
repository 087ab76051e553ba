"""Adjacency text: one line per vertex, ``k<TAB>d1 d2 `` or ``k<TAB>d1,w1 d2,w2 ``, and result lines ``k<TAB>delta|value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands between the tab and the links in the two secondary formats.
TAG_UNWEIGHTED, TAG_SOURCE, TAG_OTHER = "1:", "f0:", "p:"


def parse_lines(lines: DataFrame, weighted: bool = False, strict: bool = False, column: str = "value") -> DataFrame:
    """(src, dst[, weight]) of adjacency lines; a vertex without links has one row with null dst.

    Space after the last link is optional and empty tokens are ignored. A tag before the links (``1:``, ``f0:``, ``p:``)
    is skipped. Malformed lines are skipped, or an error with ``strict``.
    """
    line = F.col(column)
    shape = r"^-?\d+\t(?:1:|f\d*:|p:)?" + (r"(?: *-?\d+,[-+0-9.eE]+)* *$" if weighted else r"(?: *-?\d+)* *$")
    good = F.regexp_like(line, F.lit(shape))
    if strict:
        message = F.concat(F.lit("not an adjacency line: "), F.substring(line, 1, 200))
        checked = F.when(good, line).otherwise(F.raise_error(message))
        lines = lines.select(checked.alias(column))
    else:
        lines = lines.filter(good)
    src = F.split_part(line, F.lit("\t"), F.lit(1)).cast("long")
    links = F.regexp_replace(F.split_part(line, F.lit("\t"), F.lit(2)), r"^(?:1:|f\d*:|p:)", "")
    tokens = F.filter(F.split(links, " "), lambda x: x != "")
    out = lines.select(src.alias("src"), F.explode_outer(tokens).alias("link"))
    if not weighted:
        return out.select("src", F.col("link").cast("long").alias("dst"))
    part = lambda n: F.split_part(F.col("link"), F.lit(","), F.lit(n))
    return out.select("src", part(1).cast("long").alias("dst"), part(2).cast("double").alias("weight"))


def read_adjacency(spark: SparkSession, path: str, weighted: bool = False, strict: bool = False, check_keys: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the text files under ``path`` (a folder, file or glob).

    With ``check_keys`` a vertex on more than one line is an error, since files have no order that says which counts.
    """
    lines = spark.read.text(path)
    if check_keys:
        key = F.split_part("value", F.lit("\t"), F.lit(1))
        twice = lines.groupBy(key.alias("k")).count().filter("count > 1").take(1)
        if twice:
            raise ValueError(f"vertex {twice[0].k} has more than one line")
    rows = parse_lines(lines, weighted, strict)
    return rows.select(F.col("src").alias("k")).distinct(), rows.filter("dst IS NOT NULL")


def _number(x: Column) -> Column:
    """A weight as text, without a fraction where it is whole."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def adjacency_lines(edges: DataFrame, vertices: DataFrame | None = None, weighted: bool = False, tag: str | None = None, source=0) -> DataFrame:
    """(k, line): the links of each vertex by target. ``tag`` "plain" or "source" gives the two secondary formats.

    A line per vertex is what the format asks for, so a vertex's links, and its line, have to fit into one task.
    """
    link = F.concat_ws(",", F.col("dst").cast("string"), _number(F.col("weight"))) if weighted else F.col("dst").cast("string")
    pair = F.struct("dst", *(["weight"] if weighted else []), link.alias("link"))
    lines = edges.groupBy(F.col("src").alias("k")).agg(F.sort_array(F.collect_list(pair)).alias("links"))
    if vertices is not None:
        lines = vertices.select("k").join(lines, "k", "left")
    links = F.array_join(F.transform(F.coalesce("links", F.array()), lambda x: F.concat(x["link"], F.lit(" "))), "")
    if tag == "plain":
        head = F.lit(TAG_UNWEIGHTED)
    elif tag == "source":
        head = F.when(F.col("k") == source, TAG_SOURCE).otherwise(TAG_OTHER)
    else:
        head = F.lit("")
    return lines.select("k", F.concat(F.col("k").cast("string"), F.lit("\t"), head, links).alias("line"))


def write_adjacency(edges: DataFrame, path: str, parts: int | None = None, **options) -> None:
    """Text files of adjacency lines; with ``parts``, vertices are dealt out by ``k % parts`` into folders part=i."""
    lines = adjacency_lines(edges, **options)
    if parts is None:
        lines.select("line").write.text(path)
    else:
        dealt = lines.withColumn("part", F.pmod("k", F.lit(parts))).repartition(parts, "part")
        dealt.select("line", "part").write.partitionBy("part").text(path)


def result_lines(state: DataFrame, unreached: str | None = None) -> DataFrame:
    """(k, line): ``k<TAB>delta|value``; ``unreached`` is what stands for NULL (by default nothing)."""
    text = lambda c: F.coalesce(_number(F.col(c)), F.lit(unreached or ""))
    return state.select("k", F.concat(F.col("k").cast("string"), F.lit("\t"), text("delta"), F.lit("|"), text("value")).alias("line"))


def write_result(state: DataFrame, path: str, text: bool = False, **options) -> None:
    """The (k, value, delta) of a run as Parquet, or as result lines."""
    if text:
        result_lines(state, **options).select("line").write.text(path)
    else:
        state.select("k", "value", "delta").write.parquet(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """(k, value, delta) of result lines."""
    parts = F.split(F.split_part("value", F.lit("\t"), F.lit(2)), r"\|")
    number = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit("")).cast("double")
    return spark.read.text(path).select(
        F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("k"), number(1).alias("value"), number(0).alias("delta")
    )
