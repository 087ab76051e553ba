"""Exact deduplication by distributed most-significant-digit radix partitioning.

Rows start in groups of equal byte length. Each round splits every open group by the next digit, a run of
successive bytes, and rows leave as soon as they are alone in their group or their bytes have ended. Digits
widen from round to round, so the number of rounds is logarithmic in the longest repeated text. Equality is decided on
the bytes themselves, not on a digest, and a group is named by the number of one of its rows.

At scale: the first round moves no text, only the first FIRST_DIGIT bytes, to the partial aggregation of its groups.
Groups of several rows that have more bytes set a bit each in a bitmap, broadcast, of 16 to 32 bits per group, but 2**20
at least and FILTER_BITS (8 MB) at most. A text whose bit isn't set is alone and done without a shuffle, so only texts
that look repeated move on. A false positive costs that text another round and nothing else; with far more groups than
FILTER_BITS all texts move once.
Later rounds are one aggregation (a hot group shrinks to one row per map task before the shuffle) and one sort-merge
join back to the rows (AQE splits the partition of a hot group on the row side), which carries the bytes not compared
yet. Every round ends in files of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.common import WS, code_points, cut, forget, is_empty, read, utf8

FIRST_DIGIT, WIDEN = 64, 16
FILTER_BITS = 1 << 26
_WORD_BITS = 32_768  # of each value that bitmap_construct_agg makes


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ASCII white space. The row with the most code points in its original
    text stays, of those the one with the smallest id. Null text counts as empty, and all empty texts form one
    group. Ids may be of any type that can be ordered. Rows with a null id take part and stay only if no row with an id
    ties with them. Rows repeated with the same id and text all count in ``group_size`` and are all marked like their id,
    unless ``row_col`` names a column of distinct numbers: the result then begins with it, ties of equal ids go to the
    smallest number, and exactly one row of a group is kept. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"),
        code_points(text).alias("points"),
        utf8(F.translate(text, WS, "")).alias("bytes"),
    ).select("id", "row", "points", "bytes", F.octet_length("bytes").alias("len"), F.substring("bytes", 1, FIRST_DIGIT).alias("digit"))
    sha = F.sha2("bytes", 256).alias("sha")
    first = cut(rows.select(F.monotonically_increasing_id().alias("n_row"), "id", "row", "points", "len", "digit", sha))
    groups = _groups(first, ["len", "digit"])
    longer = F.col("len") > FIRST_DIGIT
    open_groups = groups.filter(F.col("g_len") > FIRST_DIGIT)
    n_open = open_groups.count()
    size = min(FILTER_BITS, max(1 << 20, 1 << (16 * n_open).bit_length()))
    bits = cut(_bitmap(open_groups, size))
    done = [
        _settled(_joined(first.filter(~longer), groups, ["len", "digit"])),
        _alone(_marked(first.filter(longer), bits, size).filter(~F.col("marked"))),
    ]
    at, width = FIRST_DIGIT, FIRST_DIGIT * WIDEN
    rest = F.substring("bytes", at + width + 1, 2_147_483_647)
    rows = _marked(rows.filter(longer), bits, size).filter("marked").select(
        F.monotonically_increasing_id().alias("n_row"), "id", "row", "points", "len", sha,
        F.col("len").cast("long").alias("gid"), F.substring("bytes", 1, at + width).alias("digit"), rest.alias("rest"),
    )
    while n_open:
        at = at + width
        rows = cut(rows)
        step = cut(_joined(rows, _groups(rows, ["gid", "digit"]), ["gid", "digit"]))
        forget(rows)
        open_ = F.col("n").isNotNull() & (F.col("len") > at)
        done.append(_settled(step.filter(~open_)))
        rows, width = step.filter(open_), min(width * WIDEN, 1 << 30)
        if is_empty(rows.select("len")):
            break
        rows = rows.select(
            "n_row", "id", "row", "points", "len", "sha", F.col("next").alias("gid"),
            F.substring("rest", 1, width).alias("digit"), F.substring("rest", width + 1, 2_147_483_647).alias("rest"),
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    kept = F.col("row") == F.col("keep_row") if row_col else F.col("id").eqNullSafe(F.col("keep"))
    return out.select(
        *([F.col("row").alias(row_col)] if row_col else []),
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        kept.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of several rows (g_ keys, n, keep, keep_row, next), written: both sides of the join are then plain shuffles
    and AQE can split a hot key. ``next`` is the least row number of the group."""
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "row"))
    return cut(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), best.alias("best"), F.min("n_row").alias("next")).filter("n > 1")
        .select(*[F.col(k).alias(f"g_{k}") for k in keys], "n", F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"), "next")
    )


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their group, null where they are alone; the same plan at every size."""
    return rows.join(groups.hint("merge"), [F.col(k) == F.col(f"g_{k}") for k in keys], "left").drop(*[f"g_{k}" for k in keys], "digit")


def _settled(rows: DataFrame) -> DataFrame:
    alone = F.col("n").isNull()
    return rows.select(
        "id", "row", "sha", F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep"),
        F.when(alone, F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"), F.coalesce("n", F.lit(1)).cast("long").alias("n"),
    )


def _alone(rows: DataFrame) -> DataFrame:
    return rows.select("id", "row", "sha", F.col("id").alias("keep"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"))


def _bit(length: Column, digit: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(length, digit), F.lit(size))


def _bitmap(groups: DataFrame, size: int) -> DataFrame:
    """(part, bits): the bits of ``groups``, in at most ``size`` / 32768 values of 4 KB."""
    bit = _bit(F.col("g_len"), F.col("g_digit"), size)
    at = groups.select(F.floor(bit / _WORD_BITS).alias("part"), (bit % _WORD_BITS).alias("place"))
    return at.groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"))


def _marked(rows: DataFrame, bitmap: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``marked``: whether the bit of their length and first digit is set."""
    bit = _bit(F.col("len"), F.col("digit"), size)
    place = (bit % _WORD_BITS).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bits, int(place DIV 8) + 1, 1)")), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.expr("shiftleft(1, place % 8)")) != 0
    out = rows.withColumn("place", place).join(F.broadcast(bitmap), F.floor(bit / _WORD_BITS) == F.col("part"), "left")
    return out.withColumn("marked", F.coalesce(marked, F.lit(False))).drop("place", "part", "bits")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
