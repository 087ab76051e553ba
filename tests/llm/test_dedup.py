"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from undertow.llm import exact_dedup, near_dedup
from undertow.llm.components import components


def frame(spark, rows):
    """Rows (doc_id, text) among columns whose names operators use inside."""
    data = [(i, t, "a", 1, "b", 2, None) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, row int, digest string, n int, bands string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


TEXTS = [
    (1, "a b"), (2, "ab"), (3, "a  b\n"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "x" * 300_000), (8, "x" * 299_999 + "y"),
    (9, "x" * 300_000), (10, "é" * 40), (11, "é" * 40 + " "), (12, "z" * 64), (13, "z" * 65), (14, "z" * 64), (15, "a\u00a0b"),
]


def test_exact(spark):
    got = by_id(exact_dedup.exact_dedup(frame(spark, TEXTS)))
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in TEXTS}
    size = {i: len(t or "") for i, t in TEXTS}
    for i, n in norm.items():
        group = [j for j in norm if norm[j] == n]
        best = min(group, key=lambda j: (-size[j], j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best, len(group), i == best), i


def test_exact_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []
    rows = exact_dedup.exact_dedup(frame(spark, [(None, "a"), (3, "a"), (3, "a"), (5, "b")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows) == [(0, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (5, 5, 1, True)]


def test_exact_ids_of_any_kind(spark):
    long = "long text " * 40
    data = [("b", long), ("a", long), (None, long + "!"), (None, long + "!"), ("c", "x"), (None, "x"), ("d", None)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == sorted([
        ("b", "a", 2, False), ("a", "a", 2, True), ("None", "None", 2, True), ("None", "None", 2, True), ("c", "c", 2, True),
        ("None", "c", 2, False), ("d", "d", 1, True),
    ])
    least = -(1 << 63)
    got = exact_dedup.exact_dedup(frame(spark, [(least, "q"), (least + 1, "q"), (5, "r")])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(least, least), (least + 1, least), (5, 5)]


@pytest.mark.parametrize("bits", [1, 1 << 26])
def test_exact_common_beginnings(spark, monkeypatch, bits):
    """Texts that part after any number of bytes, also with a bitmap that lets all through."""
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    base = "".join(chr(97 + i % 26) for i in range(20_000))
    texts = [base[:at] + c + base[at + 1 :] for at in (0, 63, 64, 1087, 1088, 17_471, 17_472, 19_999) for c in "XY"] * 2
    texts += [base[:n] for n in (63, 64, 65, 1088, 1089)] * 3
    got = by_id(exact_dedup.exact_dedup(frame(spark, list(enumerate(texts)))))
    for i, t in enumerate(texts):
        assert (got[i].keep_id, got[i].group_size) == (texts.index(t), texts.count(t))
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_random(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.randrange(7)))) for i in range(400)]
    got = by_id(exact_dedup.exact_dedup(frame(spark, rows)))
    norm = {i: re.sub(r"\s", "", t) for i, t in rows}
    for i, t in rows:
        group = [(-len(u), j) for j, u in rows if norm[j] == norm[i]]
        assert (got[i].keep_id, got[i].group_size) == (min(group)[1], len(group))


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # many cells
    monkeypatch.setattr(near_dedup, "CELL_MEMBERS", 4)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two\n"), (4, "é x"), (5, "É x")], 6
    for _ in range(12):  # chains of edits: ends of a chain are often only linked through its middle
        text = rng.choices(words, k=rng.randrange(20, 200))
        for _ in range(rng.randrange(1, 15)):
            rows.append((n, " ".join(text)))
            n += 1
            for _ in range(rng.randrange(1, 4)):
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(words)
    base = rng.choices(words, k=120)
    for _ in range(40):  # copies of one text whose pairs are near the threshold
        text = list(base)
        for _ in range(3):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((n, " ".join(text)))
        n += 1
    rng.shuffle(rows)
    got = by_id(near_dedup.near_groups(frame(spark, rows)))
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_hot(spark, monkeypatch):
    """Thousands of near copies that share most buckets, with some texts that are near to few of them: no quadratic step."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(3000)]
    rows += [(5000 + i, " ".join([f"x{i}"] + base[1:40] + [f"y{i}"] + base[41:-2])) for i in range(20)]
    rng.shuffle(rows)
    seen = []

    def cells(members, key, load):
        out = real(members, key, load)
        seen.append(out.count())
        return out

    real = near_dedup._cells
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    monkeypatch.setattr(near_dedup, "CELL_MEMBERS", 100)
    monkeypatch.setattr(near_dedup, "_cells", cells)
    got = by_id(near_dedup.near_groups(frame(spark, rows)))
    want = brute([r for r in rows if r[0] < 3 or r[0] >= 5000])
    assert all(got[i].component_id == 0 for i in range(3000))
    assert {i: got[i].component_id for i in range(5000, 5020)} == {i: want[i][1] for i in range(5000, 5020)}
    assert sum(seen) <= 3 * near_dedup.BANDS * len(rows)  # a bucket of 3000 in blocks of 100 had 30 rows per member


def test_cells_cover_every_pair_of_different_components(spark):
    rng = random.Random(2)
    members = [(b, 1000 * b + v, rng.choice([1, 1, 1, 2, 3, *range(10, 30)])) for b, n in enumerate([1, 3, 20, 200]) for v in range(n)]
    df = spark.createDataFrame(members, "bucket long, v long, comp long")
    cells: dict = {}
    for r in near_dedup._cells(df, "bucket", F.lit(1 / 16)).collect():
        cells.setdefault((r.bucket, r.cell, r.j), []).append((r.own, r.v, r.comp))
    met = set()
    for (bucket, _, j), rows in cells.items():
        assert len(rows) < 100
        for own, v, c in rows:
            for own2, w, d in rows:
                if c != d and v != w and (j == 0 or own != own2):
                    assert (bucket, min(v, w), max(v, w), own > own2) not in met
                    met.add((bucket, min(v, w), max(v, w)))
    want = {(b, min(v, w), max(v, w)) for b, v, c in members for b2, w, d in members if b == b2 and v != w and c != d}
    assert met == want


def test_near_edges(spark):
    assert near_dedup.near_groups(frame(spark, [])).collect() == []
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, long), (8, long + " x"), (9, None), (9, None)]
    got = near_dedup.near_groups(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("4", 4), ("4", 4), ("7", 7), ("8", 7), ("9", 9), ("9", 9), ("None", 4)]


def test_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64)) for _ in range(2))
    half = np.unique(np.concatenate([a[:2000], b[:2000]]))
    sig = [near_dedup.signature(near_dedup.minima(x)).view(np.uint64) for x in (a, b, half)]
    assert near_dedup.unequal(sig[0], sig[0]) == 0
    assert near_dedup.similarity(near_dedup.unequal(sig[0], sig[1])) < 0.15
    assert abs(near_dedup.similarity(near_dedup.unequal(sig[0], sig[2])) - 1 / 3) < 0.15


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(5, 3), (9, 5), (3, 9), (20, 21), (21, 20)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.v: r.comp for r in components(df).collect()}
    low = {v: v for link in links for v in link if link[0] != link[1]}
    for _ in low:
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
