"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) are packed by size, largest first, each into the bin with the tightest remaining
capacity that still holds it. Groups of one size are interchangeable, so the packer sees runs (size, count): there
are at most sqrt(2 * total size) distinct sizes however many rows there are, and one task packs them. The bins'
remaining capacities are kept in a balanced tree, and a run goes to a bin as often as it fits, which is what
placing its groups one by one would do.

At scale: texts are read once and reduced to (id, size, crc, digest) rows in the shared folder. Group sizes come
from a partially aggregated sum; ranks within a run and slots within a shard come from counts per hash bucket and a
ranking inside each bucket, so no run and no shard is ever sorted by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.llm.common import cut, read, utf8

BUCKET_ROWS = 100_000


class TightestFit:
    """Ordered multiset of (remaining, bin) in a two-level B-tree: leaves of bounded width under one index."""

    WIDTH = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.top: list[tuple[int, int]] = []  # the largest key of each leaf

    def add(self, key: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.top = [[key]], [key]
            return
        i = min(bisect_left(self.top, key), len(self.leaves) - 1)
        leaf = self.leaves[i]
        insort(leaf, key)
        if len(leaf) > self.WIDTH:
            half = len(leaf) // 2
            self.leaves[i : i + 1] = [leaf[:half], leaf[half:]]
            self.top[i : i + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.top[i] = leaf[-1]

    def pop_at_least(self, size: int) -> tuple[int, int] | None:
        """Takes out the smallest key whose remaining capacity is at least ``size``."""
        i = bisect_left(self.top, (size, -1))
        if i == len(self.leaves):
            return None
        leaf = self.leaves[i]
        key = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.top[i] = leaf[-1]
        else:
            del self.leaves[i], self.top[i]
        return key


def best_fit_decreasing(
    runs: list[tuple[int, int]], capacity: int, bins: int | None = None
) -> list[tuple[int, int, int, int]] | None:
    """Packs ``runs`` (size, count), largest size first, into bins of ``capacity``.

    Returns (size, first, last, bin): groups ``first`` to ``last`` of that size, counted from 1, are in ``bin``. With
    ``bins`` given, None if they don't suffice; else bins are opened as needed. A group above the capacity has a bin
    of its own.
    """
    tree, opened, out = TightestFit(), 0, []
    if bins is not None:
        for b in range(bins):
            tree.add((capacity, b))
        opened = bins
    for size, count in sorted(runs, reverse=True):
        at = 1
        while at <= count:
            hit = tree.pop_at_least(size)
            if hit is None:
                if bins is not None:
                    return None
                hit, opened = (max(capacity, size), opened), opened + 1
            left, b = hit
            n = min(count - at + 1, left // size) if size else count - at + 1
            out.append((size, at, at + n - 1, b))
            tree.add((left - n * size, b))
            at += n
    return out


def pack_evenly(runs: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """``best_fit_decreasing`` into exactly ``bins`` bins of the smallest capacity that holds everything.

    A group larger than its even share has a bin to itself, and the others share the remaining bins evenly.
    """
    rest, own, taken = dict(runs), [], {}
    total, free = sum(s * c for s, c in runs), bins
    for size, count in sorted(runs, reverse=True):
        for _ in range(count):
            if free > 1 and size * free > total and size < total:
                taken[size] = taken.get(size, 0) + 1
                own.append((size, taken[size], taken[size], bins - free))
                total, free = total - size, free - 1
                rest[size] -= 1
            else:
                break
        if size * free <= total:
            break
    left = [(s, c) for s, c in rest.items() if c]
    if not left:
        return own
    low = max(-(-total // free), max(s for s, _ in left))
    high = low + max(s for s, _ in left)  # always enough: no bin is closed before it is within one group of `low`
    best = best_fit_decreasing(left, low, free)
    while best is None and low + 1 < high:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(left, mid, free)) is None:
            low = mid
        else:
            high, packed = mid, found
            if high - low <= 1:
                best = packed
    best = best if best is not None else best_fit_decreasing(left, high, free)
    shift = lambda s: taken.get(s, 0)
    return own + [(s, a + shift(s), b + shift(s), k + bins - free) for s, a, b, k in best]


def _ranked(df: DataFrame, within: list[str], key: str, by: list[str], buckets: int, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within ``within``, by bucket of ``key``'s hash and then by ``by``."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    counts = df.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*within).orderBy("_b")
    starts = counts.withColumn("_start", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy(*within, "_b").orderBy(*by))
    return (
        df.withColumn("_local", local)
        .join(starts, [*within, "_b"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_b", "_local", "_start")
    )


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, group_size, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1, and one group with the empty texts); rows with equal
    texts stay together, and shards' sizes are as near equal as best-fit-decreasing gets them. A group above an even
    share has a shard to itself. Slots count from 0 without gaps in each shard. Null and repeated ids are rows like
    any other. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(utf8(text)).alias("text_crc32"),
            F.unhex(F.sha2(utf8(text), 256)).alias("digest"),
        )
    )
    n = base.count()
    buckets = max(16, -(-n // BUCKET_ROWS))
    groups = cut(base.groupBy("digest").agg(F.sum("size").alias("group_size")))
    runs = groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n"))

    def pack(frames):
        got = pd.concat([pd.DataFrame({"group_size": [], "n": []}, dtype="int64"), *frames])
        out = pack_evenly(list(zip(got.group_size.tolist(), got.n.tolist())), n_shards) if len(got) else []
        yield pd.DataFrame(out, columns=["r_size", "first", "last", "shard"]).astype("int64")

    spans = cut(runs.coalesce(1).mapInPandas(pack, "r_size long, first long, last long, shard long"))
    placed = (
        _ranked(groups, ["group_size"], "digest", ["digest"], buckets, "rank")
        .join(spans, (F.col("group_size") == F.col("r_size")) & F.col("rank").between(F.col("first"), F.col("last")))
        .select("digest", "group_size", F.col("shard").cast("int").alias("shard"))
    )
    rows = cut(base.join(placed, "digest").withColumn("row_key", F.xxhash64("id", "digest")))
    return _ranked(rows, ["shard"], "row_key", ["row_key", "id"], buckets, "slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", "group_size", "shard", (F.col("slot") - 1).alias("slot")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
