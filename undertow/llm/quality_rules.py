"""Quality rules: repetition inside a document and lines shared by many documents of a host.

Only DataFrame functions. Lines are normalised (trimmed, lower case, inner white space as one space, digits as 0) and
hashed; per host the distinct documents of each line are counted, where copies of one text count as one document.
Lines above both limits, a count and a share of the host's distinct texts, are taken out of the texts, and documents
that have too small a share of their words left are depleted and rejected.

At scale: lines are reduced to (host, text digest, line hash) rows, and every count is partially aggregated, so a line
in every document of a hot host leaves one row per map task. Boilerplate lines are broadcast to the texts, which stay
where they are; only where the lines are too many do texts move, once, to the lines found in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.common import WORD, WS, cut, read, word_count

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is boilerplate in at least LINE_DOCS distinct texts and LINE_PERCENT % of those of its host.
LINE_DOCS, LINE_PERCENT = 20, 1
#: A document is depleted when less than this percentage of its words is outside boilerplate lines.
MIN_LEFT_PERCENT = 30
#: Boilerplate lines are broadcast up to this many in all and of one host; results don't depend on it.
BROADCAST_LINES, HOST_LINES = 200_000, 4096


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _covered(starts: Column) -> Column:
    """How many words the three-word windows at these ascending positions cover."""
    last = F.size(starts)
    steps = F.transform(
        starts, lambda x, i: F.when(i + 1 < last, F.least(F.lit(3), F.get(starts, i + 1) - x)).otherwise(3)
    )
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur at least twice. Windows are compared by a 64-bit hash within a text."""

    def among(hashes: Column) -> Column:
        def grouped(pairs: Column) -> Column:
            same = lambda x, i, j: F.get(pairs, j)["h"] == x["h"]
            found = F.filter(
                pairs,
                lambda x, i: F.coalesce(same(x, i, i + 1), F.lit(False))
                | F.when(i > 0, same(x, i, F.greatest(i - 1, F.lit(0)))).otherwise(False),
            )
            return let(F.sort_array(F.transform(found, lambda x: x["i"])), _covered)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, grouped))

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(hashes, among))

    return let(words, windows)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with long columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words in place of any of these
    names; null text has none of each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WS, "")) > 0)
    long = lambda c: c.cast("long")
    counts = let(
        _words(text),
        lambda w: F.struct(long(F.size(w)).alias("n_words"), repeat_words(w).alias("n_repeat_words")),
    )
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_counts")
    return docs.withColumn("_counts", counts).select(
        *[c for c in docs.columns if c.lower() not in made],
        F.col("_counts.n_words"),
        long(F.length(F.translate(text, WS, ""))).alias("word_chars"),
        long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        F.col("_counts.n_repeat_words"),
    )


def _line(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.translate(text, WS, " " * len(WS)))), " +", " "), "[0-9]", "0")


def common_lines(
    docs: DataFrame, host: str, digest: str, text: str, min_docs: int = LINE_DOCS, min_percent: float = LINE_PERCENT
) -> tuple[DataFrame, DataFrame]:
    """(every line of every distinct text as host, digest, line; the host, line pairs above the limits)."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.translate(x, WS, "")) > 0)
    hashed = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(_line(x))))
    named = [F.col(host).alias("host"), F.col(digest).alias("digest")]
    each = docs.select(*named, F.explode(hashed).alias("line")).distinct()
    texts = docs.select(*named).distinct().groupBy(F.col("host").alias("c_host")).agg(F.count(F.lit(1)).alias("texts"))
    seen = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    flagged = (
        seen.join(texts, F.col("host").eqNullSafe(F.col("c_host")))
        .filter(F.col("docs") * 100 >= F.col("texts") * min_percent)
        .select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    )
    return each, cut(flagged)


def _dealt(hashes: Column) -> Column:
    """Distinct hashes as lists by their remainder."""

    def lists(h: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(h))).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(h, lambda x: F.pmod(x, n) == i))

    return let(hashes, lists)


def _with_common(docs: DataFrame, text_col: str, host_col: str, min_docs: int, min_percent: float) -> DataFrame:
    """``docs`` with a column __b_lines: the hashes of boilerplate lines to take out of the row's text, null for none.

    The lines of a host are broadcast where they are few; else each text gets those that are in it, by host and digest.
    Hashes are dealt into the square root of their number of lists, so a text costs less than its lines times these.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    slim = docs.select(F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    each, flagged = common_lines(slim, "host", "digest", "text", min_docs, min_percent)
    total, most = flagged.groupBy("f_host").count().agg(F.sum("count"), F.max("count")).first()
    same_host = F.col(host_col).eqNullSafe(F.col("__b_host"))
    if (total or 0) <= BROADCAST_LINES and (most or 0) <= HOST_LINES:
        bad = flagged.groupBy(F.col("f_host").alias("__b_host")).agg(_dealt(F.collect_list("f_line")).alias("__b_lines"))
        return docs.join(F.broadcast(bad), same_host, "left")
    bad = (
        each.join(flagged, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")))
        .groupBy(F.col("host").alias("__b_host"), F.col("digest").alias("__b_digest"))
        .agg(_dealt(F.collect_list("line")).alias("__b_lines"))
    )
    return docs.join(bad, same_host & (digest == F.col("__b_digest")), "left")


def _outside(text: Column, bad: Column) -> Column:
    """``text`` without the lines whose hashes are in ``bad``, lists by remainder; unchanged where that is null."""
    common = lambda h: F.array_contains(F.get(bad, F.pmod(h, F.size(bad)).cast("int")), h)
    left = F.filter(F.split(text, "\n"), lambda x: ~let(F.xxhash64(_line(x)), common))
    return F.when(bad.isNull(), text).otherwise(F.array_join(left, "\n"))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = LINE_DOCS,
    min_percent: float = LINE_PERCENT,
    min_left_percent: float = MIN_LEFT_PERCENT,
) -> DataFrame:
    """One row per input row: ``id_col``, the base counts, words_removed, base_failed, kept, text_left.

    ``text_left``: the text without the boilerplate lines of its host, null for null. ``words_removed``: the words it has
    lost. ``base_failed``: the whole text has fewer than 50 words, or over half of them in repeated three-word windows.
    ``kept``: neither base_failed nor depleted. Null text has no words and fails; null hosts form a host; null and
    repeated ids keep a row each. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    counted = base_counts(_with_common(slim, "text", "host", min_docs, min_percent), "text")
    cleaned = counted.withColumn("text_left", _outside(F.col("text"), F.col("__b_lines")))
    unchanged = F.col("text_left").eqNullSafe(F.col("text"))
    out = cleaned.withColumn("words_left", F.when(unchanged, F.col("n_words")).otherwise(word_count(F.col("text_left"))))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("words_left") * 100 < F.col("n_words") * min_left_percent
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_words") - F.col("words_left")).alias("words_removed"), base_failed.alias("base_failed"),
        (~base_failed & ~depleted).alias("kept"), "text_left",
    )


def remove_common_lines(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = LINE_DOCS, min_percent: float = LINE_PERCENT
) -> DataFrame:
    """``docs`` with the boilerplate lines of its host taken out of ``text_col``; null text stays null."""
    joined = _with_common(docs, text_col, host_col, min_docs, min_percent)
    text = _outside(F.col(text_col), F.col("__b_lines"))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).drop("text_left")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS digest,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), tri2 AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM tri2, (VALUES (0), (1), (2)) AS v(o) WHERE tri2.n > 1 GROUP BY doc_id
), b AS (
  SELECT d.doc_id, d.source, d.digest, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), l AS (
  SELECT DISTINCT source, digest, pos, line,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM (SELECT source, digest, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), n AS (
  SELECT *, regexp_replace(regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]', ' ', 'g'))), ' +', ' ', 'g'), '[0-9]', '0', 'g') AS norm
  FROM l
), hosts AS (SELECT source, count(DISTINCT digest) AS texts FROM d GROUP BY source
), bad AS (
  SELECT n.source, norm FROM n JOIN hosts ON n.source IS NOT DISTINCT FROM hosts.source
  GROUP BY n.source, norm, texts HAVING count(DISTINCT digest) >= 20 AND count(DISTINCT digest) * 100 >= texts * 1
), gone AS (
  SELECT n.source, n.digest, sum(words) AS words FROM n JOIN bad ON n.source IS NOT DISTINCT FROM bad.source AND n.norm = bad.norm
  GROUP BY n.source, n.digest
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       CAST(coalesce(gone.words, 0) AS BIGINT) AS words_removed,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT ((n_words - coalesce(gone.words, 0)) * 100 < n_words * 30) AS kept
FROM b LEFT JOIN gone ON b.source IS NOT DISTINCT FROM gone.source AND b.digest = gone.digest
"""
