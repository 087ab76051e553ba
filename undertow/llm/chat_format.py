r"""Chat formatting of reply trees.

Messages form trees by parent. Iterative self-joins double the reach of every message's ancestor pointer and add up the
scores it passes, so after log2(depth) rounds every leaf has the score of its path and branches are ranked. Then the
pointers, from the shortest on, enumerate the root-to-leaf paths that were chosen, and each is formatted as one
conversation. Only DataFrame functions.

The template writes a turn as ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash becomes
``\\``, ``###`` becomes ``\h``, ``</turn>`` becomes ``\e`` and, in roles, ``:`` becomes ``\c``; ``unescape`` and
``parse`` undo this exactly.

At scale: a round has one row per message, whatever the number of leaves below it, and only chosen paths are listed, as
(tree, leaf, message, distance) rows without texts. Every join is on (tree, message) and so spread over a tree's messages,
and each round is written to the shared folder. Texts move once, to their path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.llm.common import cut, is_empty, read
from undertow.llm.quality_rules import let

HEAD, COLON, END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ROLE_ESCAPES if role else ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    """Undoes ``escape``: what stands between two escaped backslashes holds no other backslash but of a code."""

    def part(x: Column) -> Column:
        for plain, code in (ROLE_ESCAPES if role else ESCAPES)[1:]:
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def _jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers (tree, node, above) of reach 1, 2, 4, ..., and (tree, leaf, score), scores summed up to the root."""
    links = messages.select("tree", "node", "parent", "score")
    known = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    now = cut(links.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("above"), "score"))
    jumps, reach, limit = [], 1, None
    while not is_empty(now.filter("above IS NOT NULL").select("node")):
        if limit is None:
            limit = 2 * now.count()
        if reach > limit:
            raise ValueError("a message is its own ancestor")
        far = now.select("tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("score").alias("more"))
        step = now.filter("above IS NOT NULL").join(far, ["tree", "above"])
        jumps.append(now.filter("above IS NOT NULL").select("tree", "node", "above"))
        now = cut(
            step.select("tree", "node", F.col("next").alias("above"), (F.col("score") + F.col("more")).alias("score"))
            .unionByName(now.filter("above IS NULL"))
        )
        reach *= 2
    inner = links.select("tree", F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
    return jumps, now.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "score")


def _paths(jumps: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """The paths (tree, leaf, node, up) of ``leaves`` (tree, leaf)."""
    paths = cut(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps):
        more = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = cut(paths.unionByName(more))
    return paths


def tree_paths(messages: DataFrame) -> DataFrame:
    """All root-to-leaf paths: (tree, leaf, node, up), ``up`` counting from 0 at the leaf.

    ``messages`` has tree, node and parent (null: a root), node being unique within its tree. A message whose parent
    isn't there is a root. Messages on a cycle have no leaf that they end in a root, and an error says so.
    """
    jumps, leaves = _jumps(messages.select("tree", "node", "parent", F.lit(0.0).alias("score")))
    return _paths(jumps, leaves)


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` paths of each tree as conversations.

    ``messages``: tree, node, parent, role, text, score. Returns tree, leaf, rank, score, n_turns, formatted and spans,
    the places (start from 1, chars) of escaped assistant texts in ``formatted``, which are the loss mask. Ties in
    score go to the smaller leaf. Null roles and texts are empty, null scores 0; tree and node are never null, and node
    is unique within its tree (see ``conversations`` for flat rows with any ids). No messages give no rows.
    """
    said = messages.select(
        "tree", "node",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    jumps, scores = _jumps(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    best = cut(scores.withColumn("rank", rank).filter(F.col("rank") <= branches))
    turns = (
        _paths(jumps, best).join(best, ["tree", "leaf"])
        .join(said, ["tree", "node"])
        .withColumn("body", escape(F.col("text")))
        .withColumn("head", F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(COLON)))
        .groupBy("tree", "leaf", "rank", "score")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", (F.col("role") == "assistant").alias("loss")))).alias("turns"))
    )
    size = lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(END)

    def add(state: Column, t: Column) -> Column:
        span = F.struct((state["at"] + F.char_length(t["head"]) + 1).alias("start"), F.char_length(t["body"]).cast("long").alias("chars"))
        spans = F.when(t["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size(t)).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, chars: bigint>>)").alias("spans"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return turns.select(
        "tree", "leaf", "rank", "score",
        F.size("turns").cast("long").alias("n_turns"),
        text.alias("formatted"),
        F.aggregate("turns", start, add)["spans"].alias("spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    turns = F.filter(F.split(formatted, END), lambda x: F.length(x) > 0)
    role = lambda t: F.substring_index(F.substr(t, F.lit(len(HEAD) + 1)), COLON, 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(role(t), role=True).alias("role"),
            unescape(F.substr(t, F.char_length(role(t)) + len(HEAD) + len(COLON) + 1)).alias("text"),
        ),
    )


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Flat conversations as reply trees: each row answers the one before it, by turn and then role and text.

    ``tree`` is the id as text after an ``=``; rows with a null id are one conversation, ``null``.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))
    rows = rows.select(tree.alias("tree"), F.col(turn_col).alias("turn"), "role", "text")
    w = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "\\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role UNION ALL SELECT -7L, 1L, 'assistant'")
    rows = rows.unionByName(extra.withColumn("text", F.lit(control)))
    messages = cut(conversations(rows))
    said = format_trees(messages)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substr("formatted", s["start"].cast("int"), s["chars"].cast("int")))), "")
    said = said.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss)
    return said.select(
        F.when(F.col("tree") != "null", F.substr("tree", F.lit(2)).cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS body FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(4 + length(coalesce(role, '')) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
