"""Near-duplicate groups by b-bit MinHash.

A text's set holds its distinct five-word shingles. HASHES minima per set serve twice: ROWS of them in full make the
key of each of BANDS buckets, and the low BITS bits of each, packed into longs, make the signature. Texts that share a
bucket are candidates; the similarity estimated by counting unequal signature digits, corrected for chance collisions,
drops those that are five standard deviations below the threshold; the rest are confirmed on their full sets.

Groups, not pairs, are the result, so links are looked for in two steps. First each text is compared with the first and
the last of each of its buckets, which is linear in a bucket's size; the two most similar of these are confirmed and
contracted. What is still apart but similar by estimate in some bucket forms clusters; all texts of a cluster are compared
on their full sets, in cells of bounded size, and the links that connect them are kept. Blocks of a large component are
compared with other components only. Pairs inside a group are never listed, and no pair whose ends are apart is left out.

Chance of missing a link at similarity 0.75: (1 - 0.75**5)**51, about one in a million, in the buckets, and less in
the estimate. Shingles are compared by 64-bit hashes.

At scale: texts with equal sets are one vertex; what moves per vertex is 51 bucket keys of 16 bytes and, for those
that meet others, a signature of 128 bytes. Full sets are made for candidates only, from the texts, and written once.
Hot buckets are aggregated partially, joined with AQE's skew handling, and what is left of them is compared in cells of two
blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.llm.common import cut, forget, is_empty, read, spread
from undertow.llm.components import components
from undertow.llm.wordbpe import Memo

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, BITS = 51, 5, 4
HASHES = 256
SLACK = 5.0  # standard deviations
BLOCK = 4096
CELL_MEMBERS, CELL_SHINGLES = 1024, 2_000_000
BROADCAST_ROWS = 500_000  # of at most 60 bytes

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_RNG = np.random.default_rng(20_231)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_hash = Memo(lambda w: xxhash.xxh3_64_intdigest(w), 100_000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The set of a text as ascending 64-bit hashes; words are lower-cased in A-Z only."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    size = min(SHINGLE, len(w))
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = h * _P + w[i : i + n]
    return np.unique(_mix(h))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        least = np.minimum(least, ((x[i : i + 256, None] ^ _XOR) * _MUL).min(0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    m = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = h * _P + m[:, i]
    return _mix(h).view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the (mixed) minima, packed into longs."""
    low = _mix(least.astype(np.uint64) + np.arange(HASHES, dtype=np.uint64)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return (low.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def most_unequal(percent: float = PERCENT) -> int:
    """Unequal digits up to which a pair may still have the similarity, at SLACK standard deviations."""
    chance = 2.0**-BITS
    equal = percent / 100 * (1 - chance) + chance
    return int(np.ceil(HASHES * (1 - equal) + SLACK * np.sqrt(HASHES * equal * (1 - equal))))


_DIGITS = np.uint64(int("1" * (64 // BITS), 16)) if BITS == 4 else None


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of unequal digits of signatures along the last axis."""
    v = a ^ b
    v = v | (v >> np.uint64(1))
    v = (v | (v >> np.uint64(2))) & _DIGITS
    return np.bitwise_count(v).sum(-1, dtype=np.int64)


def similarity(unequal_digits: float) -> float:
    """Collision-corrected estimate of the similarity from the number of unequal digits."""
    chance = 2.0**-BITS
    return max(0.0, (1 - unequal_digits / HASHES - chance) / (1 - chance))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """``docs`` (row, id, text) as (row, id, n_shingles, fp, bands, sig); without words fp, bands and sig are null."""
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, keys, sig = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py() or "")
                n.append(len(s))
                if len(s):
                    least = minima(s)
                    fp.append(_digest(s))
                    keys.append(bands(least))
                    sig.append(signature(least))
                else:
                    fp.append(None)
                    keys.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))],
                ["row", "id", "n_shingles", "fp", "bands", "sig"],
            )

    return docs.mapInArrow(run, f"row long, id {kind.simpleString()}, n_shingles long, fp binary, bands array<long>, sig array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, shingle set as packed longs) of ``wanted`` (v, id, fp), made anew from the texts."""
    wanted = cut(wanted)
    few = wanted.count() <= BROADCAST_ROWS
    small = F.broadcast(wanted) if few else wanted
    found = docs.select("id", "text").join(small.withColumnRenamed("id", "w_id"), F.col("id").eqNullSafe(F.col("w_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, sets = [], []
            for k, fp, text in zip(batch.column("v").to_pylist(), batch.column("fp").to_pylist(), batch.column("text")):
                s = shingles(text.as_py() or "")
                if _digest(s) == fp:  # ids may repeat; the set tells the row
                    v.append(k)
                    sets.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(sets, pa.binary())], ["v", "set"])

    return cut(found.select("v", "fp", "text").mapInArrow(run, "v long, set binary").dropDuplicates(["v"]))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: float) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b"))):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    with_b = pairs.join(sets.select(F.col("v").alias("b"), F.col("set").alias("set_b")), "b")
    with_both = with_b.join(sets.select(F.col("v").alias("a"), F.col("set").alias("set_a")), "a")
    return cut(with_both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"))


def _unequal(a: Column, b: Column) -> Column:
    """Number of unequal digits of two signatures."""

    def digits(x: Column, y: Column) -> Column:
        v = x.bitwiseXOR(y)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        return F.bit_count(v.bitwiseAND(F.lit(int(_DIGITS))))

    return F.aggregate(F.zip_with(a, b, digits), F.lit(0), lambda total, n: total + n)


def _to_ends(members: DataFrame, marks: DataFrame, limit: int, percent: float) -> DataFrame:
    """Each v of ``members`` (bucket, v) with the two most similar, by estimate, of the first and last of its buckets (w)."""
    ends = members.groupBy("bucket").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    pairs = members.join(ends, "bucket").select("v", F.explode(F.array("first", "last")).alias("w")).filter("v <> w").distinct()
    of_w = marks.select(F.col("v").alias("w"), F.col("n_shingles").alias("n_w"), F.col("sig").alias("sig_w"))
    near = (
        pairs.join(marks, "v").join(of_w, "w")
        .filter(100 * F.least("n_shingles", "n_w") >= percent * F.greatest("n_shingles", "n_w"))
        .select("v", "w", _unequal(F.col("sig"), F.col("sig_w")).alias("unequal")).filter(F.col("unequal") <= limit)
    )
    rank = F.row_number().over(Window.partitionBy("v").orderBy("unequal", "w"))
    return near.withColumn("rank", rank).filter("rank <= 2").select("v", "w")


def _cells(members: DataFrame, key: str, load: Column) -> DataFrame:
    """``members`` (key, v, comp, ...) dealt to cells: with cell, j and own, one row per cell that a member is in.

    ``load`` is a member's share of a block. A key with a load of 1 at most is one cell (j = own = 0). Otherwise the
    components with more than a block's load are cut into blocks of their own and the others are dealt to blocks whole;
    a cell is two blocks (own tells which, j = 1) or one of the latter by itself, but never two of one component.
    """
    members = members.withColumn("load", load)
    hot = members.groupBy(key).agg(F.sum("load").alias("total")).filter("total > 1.000001").select(F.col(key).alias("h_key"))
    hot = cut(hot)
    one = [F.lit(0).cast("long").alias("cell"), F.lit(0).alias("j"), F.lit(0).alias("own")]
    plain = members.join(hot, F.col(key) == F.col("h_key"), "left_anti").drop("load").select("*", *one)
    if is_empty(hot):
        return plain
    members = cut(members.join(hot, F.col(key) == F.col("h_key"), "left_semi"))
    comps = cut(members.groupBy(key, "comp").agg(F.sum("load").alias("load")))
    large = comps.filter("load > 1").select(key, "comp", F.ceil("load").cast("int").alias("subs"))
    small = comps.filter("load <= 1").groupBy(key).agg(F.ceil(F.sum("load")).cast("int").alias("subs"))
    blocks = cut(
        large.select(key, F.col("comp").alias("c"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("s"))
        .unionByName(small.select(key, F.lit(-1).cast("long").alias("c"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("s")))
    )
    a, b = (blocks.select(F.col(key).alias(f"k_{x}"), F.col("c").alias(f"c_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
    before = (F.col("c_a") < F.col("c_b")) | (F.col("c_a") == -1) & (F.col("c_b") == -1) & (F.col("s_a") <= F.col("s_b"))
    same = (F.col("c_a") == F.col("c_b")) & (F.col("s_a") == F.col("s_b"))
    pairs = cut(
        a.join(b, (F.col("k_a") == F.col("k_b")) & before)
        .select(F.col("k_a").alias("p_key"), "c_a", "s_a", "c_b", "s_b", F.when(same, 0).otherwise(1).alias("j"), F.monotonically_increasing_id().alias("cell"))
    )
    sides = pairs.select("p_key", F.col("c_a").alias("p_c"), F.col("s_a").alias("p_s"), "cell", "j", F.lit(0).alias("own")).unionByName(
        pairs.filter("j = 1").select("p_key", F.col("c_b").alias("p_c"), F.col("s_b").alias("p_s"), "cell", "j", F.lit(1).alias("own"))
    )
    dealt = (
        members.join(large.select(F.col(key).alias("l_key"), F.col("comp").alias("l_comp"), F.col("subs").alias("l_subs")), (F.col(key) == F.col("l_key")) & (F.col("comp") == F.col("l_comp")), "left")
        .join(small.select(F.col(key).alias("s_key"), F.col("subs").alias("s_subs")), F.col(key) == F.col("s_key"), "left")
        .withColumn("m_c", F.when(F.col("l_subs").isNotNull(), F.col("comp")).otherwise(-1))
        .withColumn("m_s", F.when(F.col("l_subs").isNotNull(), F.pmod(F.xxhash64("v"), F.col("l_subs"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("s_subs"))).cast("int"))
    )
    columns = [c for c in plain.columns if c not in ("cell", "j", "own")]
    dealt = dealt.join(sides, (F.col(key) == F.col("p_key")) & (F.col("m_c") == F.col("p_c")) & (F.col("m_s") == F.col("p_s")))
    return plain.unionByName(dealt.select(*columns, "cell", "j", "own"))


def _apart(members: DataFrame, limit: int, percent: float) -> DataFrame:
    """Pairs (v, w) of a bucket with different comps and at most ``limit`` unequal digits: as many as connect all comps
    that such pairs connect, so fewer in a cell than there are comps.

    ``members``: bucket, v, comp, n_shingles, sig. A task holds two blocks of BLOCK members at a time.
    """
    cells = _cells(members, "bucket", F.lit(1.0 / BLOCK)).select("bucket", "cell", "j", "own", "v", "comp", "n_shingles", "sig")

    def cell(frame: list, j: int) -> tuple[list, list]:
        own, v, comp, n, sig = (np.concatenate(x) for x in zip(*frame)) if len(frame) > 1 else frame[0]
        left, right = np.flatnonzero(own == 0), np.flatnonzero(own == j)
        found: tuple[list, list] = ([], [])
        group = comp.copy()
        for k in left.tolist():
            other = right[right > k] if j == 0 else right
            other = other[(group[other] != group[k]) & (100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k]))]
            other = other[unequal(sig[other], sig[k]) <= limit]
            while len(other):
                for x, y in zip(found, (v[k], v[other[0]])):
                    x.append(np.array([y]))
                group[group == group[other[0]]] = group[k]
                other = other[group[other] != group[k]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, frame, out = None, [], ([], [])

        def done() -> pa.RecordBatch:
            columns = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in out]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["v", "w"])

        def add() -> None:
            for x, more in zip(out, cell(frame, key[2])):
                x.extend(more)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("bucket", "cell", "j", "own", "v", "comp", "n_shingles")]
            sig = batch.column("sig").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            change = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
            for a, z in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                this = tuple(int(c[a]) for c in columns[:3])
                if key is not None and this != key:
                    add()
                    frame = []
                key = this
                frame.append((*(c[a:z] for c in columns[3:]), sig[a:z]))
            yield done()
        if frame:
            add()
            yield done()

    dealt = cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    return dealt.mapInArrow(run, "v long, w long")


def _cluster_links(members: DataFrame, percent: float) -> DataFrame:
    """Links (a, b) between different comps of a cluster, confirmed on full sets: as many as connect what all would.

    ``members``: cluster, v, comp, n_shingles, set. A task holds two blocks of CELL_MEMBERS members or CELL_SHINGLES
    shingles at a time and compares them through an inverted index of their sets.
    """
    load = F.greatest(F.lit(1.0 / CELL_MEMBERS), F.col("n_shingles") / CELL_SHINGLES)
    sets = members.select("v", "set")
    cells = _cells(members.drop("set"), "cluster", load).join(sets, "v").select("cluster", "cell", "j", "own", "v", "comp", "set")

    def cell(own: list, v: list, comp: list, sets: list, j: int) -> list[tuple[int, int]]:
        own, group = np.array(own), np.array(comp)
        sets = [np.frombuffer(x, "<u8") for x in sets]
        n = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(n)])
        _, which = np.unique(np.concatenate(sets), return_inverse=True)
        holders = np.repeat(np.arange(len(sets)), n)[np.argsort(which, kind="stable")]  # members by shingle
        edges = np.concatenate([[0], np.cumsum(np.bincount(which))])
        left, right = np.flatnonzero(own == 0), np.flatnonzero(own == j)
        out = []
        for k in left.tolist():
            if len(np.unique(group)) == 1:
                break
            at = which[starts[k] : starts[k + 1]]
            lens = edges[at + 1] - edges[at]
            ends = np.cumsum(lens)
            both = np.bincount(holders[np.arange(ends[-1]) + np.repeat(edges[at] - ends + lens, lens)], minlength=len(sets))
            other = right[right > k] if j == 0 else right
            other = other[(group[other] != group[k]) & (100 * both[other] >= percent * (n[other] + n[k] - both[other]))]
            while len(other):
                out.append((min(v[k], v[other[0]]), max(v[k], v[other[0]])))
                group[group == group[other[0]]] = group[k]
                other = other[group[other] != group[k]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, frame = None, []

        def done() -> pa.RecordBatch:
            links = cell(*(list(x) for x in zip(*frame)), key[2])
            return pa.RecordBatch.from_arrays([pa.array([x[side] for x in links], pa.int64()) for side in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "cell", "j")))
            for this, *row in zip(keys, *(batch.column(c).to_pylist() for c in ("own", "v", "comp", "set"))):
                if key is not None and this != key:
                    yield done()
                    frame = []
                key = this
                frame.append(row)
        if frame:
            yield done()

    dealt = cells.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell")
    return cut(dealt.mapInArrow(run, "a long, b long").distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: float = PERCENT, row_col: str | None = None) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept``.

    Words are runs of anything but ASCII white space. A text with fewer than five words has their sequence as its one
    shingle; null texts and texts without words have none and are linked with nothing. Links need
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id that links reach. Rows with equal
    sets are linked, whatever their ids; null ids never name a component unless all of its ids are null. All rows with
    the id of their component are kept; if ``row_col`` names a column of distinct numbers, the result begins with it and
    exactly one row of a component is kept, of equal ids the one with the smallest number. An empty table gives an
    empty result.
    """
    docs = spread(docs)
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    docs = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(sketches(docs))
    classes = cut(rows.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("row").alias("v")).select("v", F.col("fp").alias("c_fp")))
    one = cut(
        rows.select("row", "id", "n_shingles", "fp", "bands", "sig").join(classes.select("v"), F.col("row") == F.col("v"), "left_semi")
        .withColumnRenamed("row", "v")
    )
    keys = one.select("v", F.explode("bands").alias("bucket"))
    buckets = cut(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(keys.join(buckets, "bucket").select("bucket", "v"))
    limit = most_unequal(percent)
    marks = one.select("v", "n_shingles", "sig")

    first = cut(_ends(_to_ends(members, marks, limit, percent)))
    sets = _sets(docs, _named(first, one))
    links = _confirm(first, sets, percent)
    forget(sets)
    comps = components(links)

    placed = members.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket")
    apart = _apart(cut(placed.join(mixed, "bucket")).join(marks, "v"), limit, percent)
    side = lambda x: placed.select(F.col("v").alias(x), F.col("comp").alias(f"comp_{x}")).distinct()
    near = cut(_ends(apart).join(side("a"), "a").join(side("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    if not is_empty(near):
        clusters = components(near).select(F.col("v").alias("comp"), F.col("comp").alias("cluster"))
        inside = cut(placed.select("v", "comp").distinct().join(clusters, "comp"))
        wanted = one.select("v", "id", "fp").join(inside.select("v"), "v", "left_semi")
        sets = _sets(docs, wanted)
        more = _cluster_links(inside.join(one.select("v", "n_shingles"), "v").join(sets, "v"), percent)
        forget(sets)
        if not is_empty(more):
            comps = components(links.unionByName(more))

    of = classes.join(comps, "v", "left").select("c_fp", F.coalesce("comp", "v").alias("comp"))
    placed = cut(
        rows.select("row", "id", "n_shingles", "fp").join(of, F.col("fp") == F.col("c_fp"), "left")
        .select("row", "id", "n_shingles", F.coalesce("comp", "row").alias("comp"))
    )
    for scratch in (rows, one, members, classes):
        forget(scratch)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    least = cut(placed.groupBy("comp").agg(first.alias("first")).select("comp", F.col("first.id").alias("component_id"), F.col("first.row").alias("keep_row")))
    kept = F.col("row") == F.col("keep_row") if row_col else F.col("id").eqNullSafe(F.col("component_id"))
    return placed.join(least, "comp").select(
        *([F.col("row").alias(row_col)] if row_col else []), F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept")
    )


def _named(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """(v, id, fp) of the ends of ``pairs``."""
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    return one.select("v", "id", "fp").join(ends, "v", "left_semi")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
