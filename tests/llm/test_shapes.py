"""Conversations, shards, mixes, the registry and the pipeline."""

import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from undertow.llm import chat_format, mixing, registry, sharding

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = ["", "\\", "\\h", "\\\\h###", "####", "</turn>", "<</turn>\n>", "\\### Assistant: </turn> ok", ": a: b"]
    texts += ["".join(rng.choice(["\\", "#", "h", "e", "c", "</turn>", ":", " ", "\n", "é"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    code = chat_format.escape(F.col("t"))
    bad = df.filter((chat_format.unescape(code) != F.col("t")) | code.contains("###") | code.contains("</turn>"))
    assert bad.count() == 0
    role = chat_format.escape(F.col("t"), role=True)
    assert df.filter((chat_format.unescape(role, role=True) != F.col("t")) | role.contains(":")).count() == 0


def test_mix_of_one_hot_row(spark):
    """A row repeated so often that one id holds most of its source is taken in part, to within half of it."""
    rows = [(1, "a b", "s")] * 9000 + [(None, "c", "s")] * 3000 + [(i, "d e f", "t") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, weights=(1, 5)).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.source_size: (r.n, r.target) for r in got} == {21_000: (12_000, 9000.0), 6000: (2000, 18_000.0)}
    for r in got:
        assert abs(r.taken - r.target) <= 2, r


def test_trees(spark):
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 3, "user", None, 1.0),
            ("t", 5, 2, "user", "thanks", None), ("u", 1, None, None, "### x", 0.0), ("u", 9, 77, "assistant", "orphan", 3.0)]
    rows += [("deep", i, i - 1 if i else None, "user" if i % 2 else "assistant", f"m{i}", 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    best = {r.tree: r for r in chat_format.format_trees(df).collect()}
    assert best["t"].leaf == 5 and best["t"].n_turns == 3 and best["t"].score == 6.0
    assert best["t"].formatted == "### user: q</turn>\n### assistant: good</turn>\n### user: thanks</turn>\n"
    assert [best["t"].formatted[s.start - 1 : s.start - 1 + s.chars] for s in best["t"].spans] == ["good"]
    assert best["deep"].n_turns == 50 and best["u"].leaf == 9
    two = chat_format.format_trees(df, branches=2)
    assert two.count() == 5
    turns = two.select("tree", "leaf", chat_format.parse(F.col("formatted")).alias("turns")).collect()
    assert {(r.tree, r.leaf): [tuple(x) for x in r.turns] for r in turns}[("t", 4)] == [("user", "q"), ("assistant", "bad"), ("user", "")]
    assert chat_format.format_trees(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        chat_format.tree_paths(spark.createDataFrame([("t", 1, 2), ("t", 2, 1)], "tree string, node long, parent long"))


def test_trunk_with_many_leaves(spark):
    """Ranking needs no path of a leaf that isn't chosen, and agrees with sums along every path."""
    rng = random.Random(6)
    rows = [("t", i, i - 1 if i else None, "user", f"m{i}", rng.random()) for i in range(200)]
    rows += [("t", 1000 + i, rng.randrange(200), "assistant", f"leaf {i}", rng.random()) for i in range(400)]
    by = {r[1]: r for r in rows}

    def total(leaf):
        path = [leaf]
        while by[path[-1]][2] is not None:
            path.append(by[path[-1]][2])
        return sum(by[x][5] for x in path), path

    inner = {r[2] for r in rows}
    want = sorted(((total(i)[0], i) for i in by if i not in inner), key=lambda x: (-x[0], x[1]))[:3]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    made, real = [], chat_format._paths
    try:
        chat_format._paths = lambda jumps, leaves: made.append(real(jumps, leaves)) or made[-1]
        got = sorted(chat_format.format_trees(df, branches=3).collect(), key=lambda r: r.rank)
    finally:
        chat_format._paths = real
    assert [r.leaf for r in got] == [i for _, i in want] and all(abs(r.score - t) < 1e-9 for r, (t, _) in zip(got, want))
    assert made[0].count() == sum(len(total(i)[1]) for _, i in want) == sum(r.n_turns for r in got)


def test_flat_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (None, 1, None, "x"), (None, 0, "assistant", "###")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat_format.format_trees(chat_format.conversations(df)).collect()}
    assert got["=1"].n_turns == 3 and got["=1"].formatted.startswith("### system: </turn>")
    assert got["null"].formatted == "### assistant: \\h</turn>\n### : x</turn>\n"


def shards(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, size int")
    return sharding.shard(df).collect()


@pytest.mark.parametrize("kind", ["many", "hot", "few", "none", "equal sizes"])
def test_shards(spark, monkeypatch, kind):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rng = random.Random(6)
    rows = {
        "many": [(i, "é" * rng.randrange(1, 300) + str(i)) for i in range(1500)] + [(None, None), (3, ""), (3, "")],
        "hot": [(i, "copy" * 20) for i in range(500)] + [(1000 + i, f"text {i}" * rng.randrange(1, 5)) for i in range(900)],
        "few": [(1, "a"), (2, "b"), (2, "b")], "none": [], "equal sizes": [(i, f"{i:05d}") for i in range(800)],
    }[kind]
    got = shards(spark, rows)
    assert len(got) == len(rows)
    total, by = [0] * 8, {}
    for r in got:
        total[r.shard] += r.size
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    of = {}
    want = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows}
    assert {(r.doc_id, r.text_crc32, r.size) for r in got} == want
    for r in got:
        assert of.setdefault(r.text_crc32, r.shard) == r.shard
    if kind in ("many", "equal sizes"):
        assert max(total) - min(total) <= max(r.size for r in got)
    if kind == "hot":
        rest = sorted(total)[:-1]
        assert max(rest) - min(rest) <= max(r.group_size for r in got if r.group_size < max(total))


def test_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(30):
        runs = [(s, rng.randrange(1, 6)) for s in rng.sample(range(1, 60), 12)]
        capacity = rng.randrange(60, 120)
        left: list[int] = []
        for s in sorted((s for s, c in runs for _ in range(c)), reverse=True):  # one by one
            fits = [k for k, x in enumerate(left) if x >= s]
            k = min(fits, key=lambda k: left[k]) if fits else len(left)
            left += [capacity] * (k == len(left))
            left[k] -= s
        got = sharding.best_fit_decreasing(runs, capacity)
        filled: dict[int, int] = {}
        for s, a, z, b in got:
            filled[b] = filled.get(b, 0) + s * (z - a + 1)
        assert sorted(capacity - x for x in filled.values()) == sorted(left)
        assert sum(z - a + 1 for _, a, z, _ in got) == sum(c for _, c in runs)


def test_tightest_fit(monkeypatch):
    monkeypatch.setattr(sharding.TightestFit, "WIDTH", 4)
    rng, tree, plain = random.Random(9), sharding.TightestFit(), []
    for i in range(2000):
        if rng.random() < 0.6 or not plain:
            key = (rng.randrange(50), i)
            tree.add(key)
            plain.append(key)
        else:
            size = rng.randrange(55)
            want = min((k for k in plain if k[0] >= size), default=None)
            assert tree.pop_at_least(size) == want
            if want:
                plain.remove(want)


def fill(sizes, weights, total, most=3):
    """Targets by the stated rule: reshare the excess until none is above its cap."""
    target = {k: total * weights[k] / sum(weights.values()) for k in sizes}
    capped = set()
    while over := [k for k in sizes if k not in capped and target[k] > most * sizes[k]]:
        capped |= set(over)
        free = {k: w for k, w in weights.items() if k not in capped}
        rest = total - sum(most * sizes[k] for k in capped)
        for k in sizes:
            target[k] = most * sizes[k] if k in capped else rest * weights[k] / sum(free.values())
    return target


def test_mix(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice(["a", "a", "a", "é", "Z", None])) for i in range(3000)]
    rows += [(5000, "x " * 10, "tiny"), (5001, None, "empty"), (5002, "", "empty"), (None, "n", "a"), (7, "w w", "a"), (7, "w w", "a")]
    df = spark.createDataFrame([(i, t, s, 0, 9) for i, t, s in rows], "doc_id long, text string, source string, size int, order int")
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect())) and len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.repeats * r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 15.5, s
    assert target["tiny"] == 30 and target["empty"] == 0
    assert mixing.mix(df.limit(0)).collect() == []


def test_boundary_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 2)  # many levels
    rows = spark.createDataFrame([("s", (i * 7919 % 1000) << 53, i, 1) for i in range(1000)], "source string, order long, id long, size long")
    shares = spark.createDataFrame([("s", 600.0)], "source string, part double")
    edge = mixing._boundary(rows, shares, small=8).first()
    last = edge.first_not.order if edge.first_not else edge.last.order + 1
    assert abs(rows.filter(F.col("order") < last).count() - 600) <= 1


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    pick = lambda names, rows: sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rows)
    assert pick(got.columns, map(tuple, got.collect())) == pick(want.columns, want.fetchall())


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in out.select("doc_id").collect()}
        out = stage(spark, out, SF).cache()
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= before
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF)
    assert last.count() == out.count() > 0 and last.filter("size(ids) <> n_tokens").count() == 0
    assert out.groupBy("doc_id").count().filter("count > 3").count() == 0
    same = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert all(same[r.doc_id] == hashlib.sha256((r.text or "").encode()).hexdigest() for r in last.collect())


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
