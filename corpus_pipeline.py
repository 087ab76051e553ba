"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir), ``docs`` being all that the stage before kept, and returns the columns of
``documents``; the last adds n_tokens and ids. Stages whose decisions come back by a join number the rows and write them
once, and the decisions are those of rows, not of ids: a row that is repeated, or has a null id or one that another text
has too, is judged by its own. Of equal rows the first by that number stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from undertow.llm.common import cut


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row, written, so that all who read it see the same numbers; its name."""
    row = _free(docs, "row_number")
    return cut(docs.withColumn(row, F.monotonically_increasing_id())), row


def _kept(docs: DataFrame, row: str, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number has ``kept`` in ``verdicts``."""
    return docs.join(verdicts.filter("kept").select(row), row, "left_semi").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their nearest labelled examples don't call toxic; examples come from the tables in ``sf_dir``."""
    return toxicity.keep_clean(docs, toxicity.fit_tables(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    docs, row = _numbered(docs)
    return _kept(docs, row, exact_dedup.exact_dedup(docs, row_col=row))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates; texts without words are in no group."""
    docs, row = _numbered(docs)
    return _kept(docs, row, near_dedup.near_groups(docs, row_col=row))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it; those it takes no time go."""
    columns, (docs, row) = docs.columns, _numbered(docs)
    taken = mixing.mix(docs, row_col=row).filter("repeats > 0").select(row, F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("time"))
    return docs.join(taken.select(row), row).select(*columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    out = bpe.encode(docs, "text", "ids")
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", token_ids),
]

#: The votes of nearest neighbours, the seeded mix and BPE have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
