"""The pipeline's stages judge rows, not ids, against plain Python."""

import random
import re
from collections import Counter

import tokenizers

import corpus_pipeline
from undertow.llm import wordbpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def told(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


A, B = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
A2, B2 = A.replace("a39", "x"), B.replace("b39", "x")


def test_copies(spark):
    rows = [(1, A), (1, A), (2, A), (1, B), (9, B), (9, B + " "), (None, "c"), (None, "c"), (None, "d"), (3, "d"), (3, "d"), (4, "e"), (4, "e"), (4, "f"), (5, None), (None, ""), (5, None)]
    got = corpus_pipeline.drop_copies(spark, frame(spark, [(*r, "s") for r in rows]), "")
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    best = {}
    for i, t in rows:  # the longest, then the smallest id, null last
        rank = (-len(t or ""), i is None, i or 0)
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[norm] = min(best.get(norm, (rank, i, t)), (rank, i, t), key=lambda x: x[0])
    assert told(got) == Counter((i, t) for _, i, t in best.values())


def test_near_copies(spark):
    rows = [(1, A), (1, A), (2, A2), (1, B2), (0, B), (0, B), (None, "p q r s t"), (None, "p q r s t"), (None, "u v w x y"), (7, "u v w x y"), (8, ""), (8, "")]
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, [(*r, "s") for r in rows]), "")
    assert told(got) == Counter({(1, A): 1, (0, B): 1, (None, "p q r s t"): 1, (7, "u v w x y"): 1, (8, ""): 2})


def test_mix(spark):
    """Equal rows aren't taken more often than the source's target allows."""
    rows = [(1, "w " * 10, "s1")] * 8 + [(None, "v " * 10, "s1")] * 8 + [(i, "u " * 10, "s2") for i in range(16)] + [(1, "z " * 10, "s2")] * 8
    out = corpus_pipeline.mix_sources(spark, frame(spark, rows), "").collect()
    words = Counter()
    for r in out:
        words[r.source] += 10
    # 400 words by weights 1 and 2
    assert abs(words["s1"] - 400 / 3) <= 5 and abs(words["s2"] - 800 / 3) <= 5


def test_empty(spark):
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        assert stage(spark, frame(spark, []), "").collect() == []


def test_extra_columns_with_clashing_names(spark):
    docs = frame(spark, [(1, A, "s"), (1, A, "s"), (2, A2, "s"), (3, B, "t")]).selectExpr("*", "1 as row_number", "2 as __v_id", "3 as repeats", "4 as row", "5 as time")
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {(r.row_number, r["__v_id"], r.repeats, r.row, r.time) for r in out.collect()} == {(1, 2, 3, 4, 5)}


def test_run_against_plain_python(spark, tmp_path):
    """Planted toxic texts, copies, near copies, repeated rows and null ids through all stages."""
    rng = random.Random(12)
    words = [f"word{i}" for i in range(500)]

    def text(n=60):
        return " ".join(rng.choices(words, k=n))

    clean = [(i, text(), "a" if i % 3 else "b") for i in range(200)]
    toxic = [(1000 + i, text() + " vile rotten scum", "a") for i in range(80)]
    planted = [(2000 + i, clean[i][1] + " \n", "b") for i in range(10)]  # exact, and longer, so these stay
    planted += [(3000 + i, clean[20 + i][1] + " more", "b") for i in range(10)]  # near, with larger ids, so these go
    planted += [(5, clean[5][1], clean[5][2])] * 3 + [(None, text(), "b"), (None, "", None), (4001, "  ", None)]
    rows = clean + toxic + planted
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 1000)) for i, _, _ in clean + toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.cache()
        kept.append(docs.collect())
    assert Counter((r.doc_id, r.text) for r in kept[0]) == Counter((i, t) for i, t, _ in clean + planted)  # no clean one goes
    best = {}
    for i, t, _ in clean + planted:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, ((1,), i, t)), ((-len(t), i is None, i or 0), i, t), key=lambda x: x[0])
    assert Counter((r.doc_id, r.text) for r in kept[1]) == Counter((i, t) for _, i, t in best.values())
    near = Counter((i, t) for _, i, t in best.values() if i is None or not 3000 <= i < 3010)
    assert Counter((r.doc_id, r.text) for r in kept[2]) == near
    size = Counter()
    for r in kept[2]:
        size[r.source] += len(r.text.split())
    total, weight = sum(size.values()), {"a": 1, "b": 2, None: 3}
    taken = Counter()
    for r in kept[3]:
        taken[r.source] += len(r.text.split())
    # the null source has no words, so a and b share the rest by 1 and 2, up to three times what they have
    b = min(3 * size["b"], total * 2 / 3 if not size[None] else total)
    assert abs(taken["a"] - min(3 * size["a"], total - b)) <= 31 and abs(taken["b"] - b) <= 31, (taken, size, weight)
    assert max(Counter((r.doc_id, r.text) for r in kept[3]).values()) <= 3 and {(r.doc_id, r.text) for r in kept[3]} <= set(near)
    library = tokenizers.Tokenizer.from_file(wordbpe.default_path())
    library.no_truncation()
    assert Counter((r.doc_id, r.text) for r in kept[4]) == Counter((r.doc_id, r.text) for r in kept[3])
    assert all(list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in kept[4])
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter((r.doc_id, r.text) for r in kept[4])
