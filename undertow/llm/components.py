"""Connected components of a link table, by contraction.

Each round maps every vertex to the smallest vertex in its neighbourhood and once more along that map, and replaces
the links by links between images until none is left; the maps are then composed. Rounds grow with the logarithm of
the longest path. Every round is written to the shared folder; a hot vertex is aggregated partially before its links
are shuffled, and nothing but an emptiness test reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import cut, forget, is_empty


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of ``links`` (a, b), comp being the smallest vertex of its component.

    Links are undirected; repeated links and links to oneself change nothing, and no links give no rows.
    """
    links = cut(links.select("a", "b").filter("a <> b").distinct())
    maps, used = [], [links]
    while not is_empty(links):
        both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u")))
        near = cut(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("to")))
        ahead = near.select(F.col("v").alias("to"), F.col("to").alias("next"))
        to = cut(near.join(ahead, "to").select("v", F.col("next").alias("to")))
        maps.append(to)
        used += [near, to]
        a, b = (to.select(F.col("v").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        links = cut(
            links.join(a, "a").join(b, "b").filter("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
        used.append(links)
    if not maps:
        return links.select(F.col("a").alias("v"), F.col("b").alias("comp"))
    out = maps[0].withColumnRenamed("to", "comp")
    for later in maps[1:]:
        step = later.select(F.col("v").alias("comp"), F.col("to").alias("next"))
        out = out.join(step, "comp", "left").select("v", F.coalesce("next", "comp").alias("comp"))
    out = cut(out)
    for scratch in used:
        forget(scratch)
    return out
