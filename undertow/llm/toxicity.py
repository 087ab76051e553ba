"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The classifier is fitted on a bounded sample of labelled rows (``max_examples``). Every word of the sample is a term and
every example with a word is in the index. A term's weight is its IDF, raised up to elevenfold the more surely the term
marks the label (Chernoff bound of its count among the label's examples, in full at ``DOUBT`` over all terms), so the rest
of a long text doesn't hide what it is judged by; no term is left out. The examples' unit vectors form an inverted index
whose postings are cut into blocks of BLOCK examples, with the largest weight of each term in each block. A text's
cosine with any example of a block cannot exceed the sum of its weights times these maxima; blocks are scored exactly in
falling order of that bound until it falls below the k-th best cosine. Terms that more than one example in COMMON has
(DENSE of them at most, the most frequent) are kept as rows of a matrix instead: their share of all cosines is one product,
which tightens the bounds and gives a first floor. The neighbours vote with their cosine as weight,
and votes become probabilities by an isotonic fit to the examples' own votes, each taken without itself.

At scale: the index is bounded by ``max_examples`` and broadcast; documents are scored where they are read, without a
shuffle. Term counts, vectors and the examples' own votes are made in the cluster; the driver gets the sample's terms and
vectors as packed arrays. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.common import cut, read, spread

MAX_EXAMPLES = 8192
NEIGHBOURS, BLOCK = 25, 64
COMMON, DENSE = 16, 512
AT_ONCE, GROUP = 16, 64
ROUNDING = 1e-5  # of 32-bit sums, in bounds
RAISE, DOUBT = 10.0, 0.01
SIGNS = 24  # of the most frequent terms: examples that share them come together in blocks
_WORD = re.compile(r"[^\W_]+")


def text_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words, ascending, and how often each occurs."""
    count = Counter(_WORD.findall(text.lower()))
    terms = np.fromiter(map(xxhash.xxh3_64_intdigest, count), np.uint64, len(count))
    order = np.argsort(terms)
    return terms[order], np.fromiter(count.values(), np.float64, len(count))[order]


def _runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and length, end to end."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lens, lens)


@dataclass
class Terms:
    """The terms of the sample, ascending, and their weights."""

    terms: np.ndarray
    weights: np.ndarray

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's terms, ascending, and their weights as a unit vector; words the sample lacks don't count."""
        terms, n = text_terms(text)
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        at = at[known]
        weights = (1 + np.log(n[known])) * self.weights[at]
        return at, weights / (math.sqrt((weights**2).sum()) or 1.0)


@dataclass
class Index:
    """Block-max inverted index of the examples' unit vectors; ``prepare`` lays out its blocks where it is used."""

    terms: Terms
    ids: list  # of the examples
    labels: np.ndarray
    firsts: np.ndarray  # by term, its first posting; one more at the end
    examples: np.ndarray  # by posting
    weights: np.ndarray  # by posting
    k: int = NEIGHBOURS
    size: int = BLOCK
    dense: int = DENSE
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))  # votes, rising
    probabilities: np.ndarray = field(default_factory=lambda: np.zeros(1))
    nothing: float = 0.0  # probability of a text without any of the terms

    @staticmethod
    def of(terms: Terms, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> Index:
        """The index of examples in the given order."""
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)]).astype(np.float32)
        order = np.argsort(term, kind="stable")
        firsts = np.searchsorted(term[order], np.arange(len(terms.terms) + 1)).astype(np.int32)
        kind = np.uint16 if len(vectors) < 1 << 16 else np.uint32
        return Index(terms, ids, np.asarray(labels, float), firsts, example[order].astype(kind), weight[order], k, BLOCK, DENSE)

    def __getstate__(self) -> dict:
        return {f: getattr(self, f) for f in self.__dataclass_fields__}

    def shared(self, spark: SparkSession):
        """The index as one broadcast value, made once; its calibration may be of an earlier time."""
        if getattr(self, "_shared", None) is None:
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared

    def prepare(self) -> Index:
        """The matrix of common terms, and of the others the entries: the (term, block) pairs that have postings."""
        if getattr(self, "rows", None) is not None:
            return self
        n, found = len(self.ids), np.diff(self.firsts)
        often = np.argsort(-found, kind="stable")[: self.dense]
        often = np.sort(often[found[often] * COMMON > n])
        rows = np.full(len(found), -1, np.int16)
        rows[often] = np.arange(len(often))
        term = np.repeat(np.arange(len(found)), found)
        example, weight, row = self.examples.astype(np.int32), self.weights, rows[term]
        self.matrix = np.zeros((len(often), -(-max(1, n) // self.size) * self.size), np.float32)  # padded to whole blocks
        self.matrix[row[row >= 0], example[row >= 0]] = weight[row >= 0]
        term, self.example, self.weight = (x[row < 0] for x in (term, example, weight))
        block = self.example // self.size
        edge = np.flatnonzero(np.diff(term * self.matrix.shape[1] + block, prepend=-1))
        self.entries = np.searchsorted(term[edge], np.arange(len(found) + 1)).astype(np.int32)  # by term, its first; one more
        self.blocks, self.starts = block[edge], np.append(edge, len(term)).astype(np.int32)  # by entry; first posting, one more
        self.most = np.maximum.reduceat(self.weight, edge) if len(edge) else self.weight  # by entry, the largest weight
        self.rows = rows
        return self

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The share of common terms in the cosines of ``vectors`` (rows) with the examples."""
        self.prepare()
        dense = np.zeros((len(vectors), len(self.matrix)), np.float32)
        for k, (ids, weights) in enumerate(vectors):
            row = self.rows[ids]
            dense[k, row[row >= 0]] = weights[row >= 0]
        return dense @ self.matrix

    def nearest(self, ids: np.ndarray, weights: np.ndarray, skip: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with a positive cosine, nearest first; exact but for the order of ties.

        ``base`` is the vector's row of ``common`` where that is known."""
        base = self.common([(ids, weights)])[0] if base is None else base
        if skip >= 0:
            base[skip] = -np.inf
        rare = self.rows[ids] < 0
        ids, weights = ids[rare], weights[rare]
        first, lens = self.entries[ids], self.entries[ids + 1] - self.entries[ids]
        entry, own = _runs(first, lens), np.repeat(weights, lens)
        block = self.blocks[entry]
        bound = base.reshape(-1, self.size).max(1) + np.bincount(block, own * self.most[entry], minlength=len(base) // self.size)
        order = np.argsort(-bound, kind="stable")
        floor = max(0.0, float(np.partition(base, -self.k)[-self.k])) if len(base) > self.k else 0.0
        near, cosines, at, take = np.zeros(0, np.int64), np.zeros(0), 0, AT_ONCE
        while at < len(order) and bound[order[at]] > max(ROUNDING, floor) - ROUNDING:
            take = min(take, np.count_nonzero(bound > max(ROUNDING, floor) - ROUNDING) - at)
            now = np.zeros(len(bound), bool)
            now[order[at : at + take]] = True
            at, take = at + take, take * 16
            here = now[block]
            start, some = self.starts[entry[here]], self.starts[entry[here] + 1]
            posting = _runs(start, some - start)
            score = base + np.bincount(self.example[posting], np.repeat(own[here], some - start) * self.weight[posting], minlength=len(base))
            hit = np.flatnonzero((score > max(0.0, floor - ROUNDING)) & np.repeat(now, self.size))
            near, cosines = np.concatenate([near, hit]), np.concatenate([cosines, score[hit]])
            best = np.lexsort((near, -cosines))[: self.k]
            near, cosines = near[best], cosines[best]
            if len(near) == self.k:
                floor = max(floor, cosines[-1])
        return near, cosines

    def nearest_of(self, texts: list[str], skips: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each text, GROUP texts at a time."""
        for k in range(0, len(texts), GROUP):
            vectors = [self.terms.vector(t) for t in texts[k : k + GROUP]]
            for j, (vector, base) in enumerate(zip(vectors, self.common(vectors))):
                yield self.nearest(*vector, skip=skips[k + j] if skips else -1, base=base)

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        return float((cosines * self.labels[near]).sum() / cosines.sum()) if len(near) else 0.0

    def calibration(self) -> tuple[np.ndarray, np.ndarray, float]:
        return self.knots, self.probabilities, self.nothing

    def scores(self, texts: list[str], calibration: tuple[np.ndarray, np.ndarray, float]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Probability, nearest examples and their cosines of each text."""
        knots, probabilities, nothing = calibration
        for near, cosines in self.nearest_of(texts):
            yield (float(np.interp(self.vote(near, cosines), knots, probabilities)) if len(near) else nothing), near, cosines


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of rising probabilities, each pool smoothed by half a case of either label."""
    pools: list[list[float]] = []  # sum of x, sum of y, cases
    for a, b in sorted(zip(x.tolist(), y.tolist())):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def marking(n: np.ndarray, hits: np.ndarray, texts: int, marked: int) -> np.ndarray:
    """How surely terms found in ``n`` of the texts, ``hits`` of them with the label, mark it: 0 to 1."""
    rate = marked / texts if texts else 0.0
    if not 0 < rate < 1:
        return np.zeros(len(n))
    share = hits / n
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.where(share > 0, share * np.log(share / rate), 0.0)
        miss = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0)
    surprise = np.where(share > rate, n * (hit + miss), 0.0)
    return np.minimum(1.0, surprise / math.log(max(1, len(n)) / DOUBT)) ** 2


def _sample(docs: DataFrame, labels: DataFrame, train: Column, max_examples: int) -> DataFrame:
    """At most ``max_examples`` labelled texts (id, label, text), the first by a hash of the id; of an id with several
    texts the last in order."""
    known = (
        labels.filter("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
        .filter(train).orderBy(F.xxhash64("id"), "id").limit(max_examples)
    )
    return cut(docs.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.max("text").alias("text")))


def _batch_maker(shared, make):
    """A mapInArrow function that gets the broadcast value and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(shared.value, batch)

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> Index:
    """The index of a sample of labelled texts. ``docs``: id, text; ``labels``: id, label; ``train``: which ids to use.

    An id with several labels has the label if any of them says so. Without a labelled text the index is empty and
    every text scores 0; with texts of one label only, every text scores near that label's share.
    """
    spark = docs.sparkSession
    sample = _sample(docs, labels, train, max_examples)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_terms(text or "")[0] for text in batch.column("text").to_pylist()]
            label = np.repeat(batch.column("label").to_numpy(), [len(t) for t in found])
            every, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True)
            hits = np.bincount(which, label, minlength=len(every)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(every.view(np.int64)), pa.array(hits), pa.array(np.bincount(which, minlength=len(every)))], ["term", "hits", "n"]
            )

    base = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("n")).first()
    stats = sample.mapInArrow(counts, "term long, hits long, n long").groupBy("term").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toArrow()
    term, hits, n = (stats.column(c).to_numpy() for c in ("term", "hits", "n"))
    order = np.argsort(term.view(np.uint64))
    term, hits, n = term.view(np.uint64)[order], hits[order], n[order]
    terms = Terms(term, np.log(1 + base.n / n) * (1 + RAISE * marking(n, hits, base.n, base.hits)))
    signs = np.argsort(-n, kind="stable")[:SIGNS]
    shared = spark.sparkContext.broadcast(terms)

    def vectors(own: Terms, batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [own.vector(t or "") for t in batch.column("text").to_pylist()]
        packed = [pa.array([x[side].astype(kind).tobytes() for x in got], pa.binary()) for side, kind in ((0, "<i4"), (1, "<f8"))]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *packed], ["id", "label", "terms", "weights"])

    kind = sample.schema["id"].dataType.simpleString()
    plain = sample.mapInArrow(_batch_maker(shared, vectors), f"id {kind}, label int, terms binary, weights binary").toArrow().to_pylist()
    rows = [(r["id"], r["label"], np.frombuffer(r["terms"], "<i4").astype(np.int64), np.frombuffer(r["weights"], "<f8")) for r in plain]
    none = [r[1] for r in rows if not len(r[2])]
    rows = [r for r in rows if len(r[2])]
    rows.sort(key=lambda r: (np.isin(signs, r[2]).tobytes(), r[0]))
    index = Index.of(terms, [r[0] for r in rows], np.array([r[1] for r in rows]), [r[2:] for r in rows], k)
    index.nothing = (sum(none) + (base.hits + 0.5) / (base.n + 1)) / (len(none) + 1) if base.n else 0.0

    def votes(index: Index, batch: pa.RecordBatch) -> pa.RecordBatch:
        places = {i: at for at, i in enumerate(index.ids)}
        texts, skips = [t or "" for t in batch.column("text").to_pylist()], [places.get(i, -1) for i in batch.column("id").to_pylist()]
        got = [index.vote(*near) if len(near[0]) else None for near in index.nearest_of(texts, skips)]
        return pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), batch.column("label")], ["vote", "label"])

    spread = sample.repartition(spark.sparkContext.defaultParallelism)
    cast = spread.mapInArrow(_batch_maker(index.shared(spark), votes), "vote double, label int").filter("vote IS NOT NULL").toArrow()
    if cast.num_rows:
        index.knots, index.probabilities = isotonic(cast.column("vote").to_numpy(), cast.column("label").to_numpy().astype(float))
    return index


def score(docs: DataFrame, index: Index, evidence: int = 5) -> DataFrame:
    """``docs`` (id, text) scored: id, score, predicted, evidence array<struct<id string, cosine, label>>.

    One row per input row. Null and empty texts, and texts without a word of the sample, have no neighbours and score
    the share of the label among such examples, smoothed by one case of the overall share; ``evidence`` is the nearest examples, none for such texts.
    """
    calibration = index.calibration()
    near_type = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(own: Index, batch: pa.RecordBatch) -> pa.RecordBatch:
        got = list(own.scores([t or "" for t in batch.column("text").to_pylist()], calibration))
        near = [
            [{"id": str(own.ids[e]), "cosine": c, "label": int(own.labels[e])} for e, c in zip(es[:evidence].tolist(), cs[:evidence].tolist())]
            for _, es, cs in got
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), pa.array(near, near_type)],
            ["id", "score", "predicted", "evidence"],
        )

    kind = docs.schema["id"].dataType.simpleString()
    return spread(docs.select("id", "text")).mapInArrow(
        _batch_maker(index.shared(docs.sparkSession), run),
        f"id {kind}, score double, predicted int, evidence array<struct<id: string, cosine: double, label: int>>",
    )


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def fit_tables(spark: SparkSession, sf_dir: str, max_examples: int = MAX_EXAMPLES) -> Index:
    """The index for the ``toxic`` label of ``labels``, learnt from the documents that aren't held out."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return fit(docs, labels, ~held_out(F.col("id")), max_examples)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return score(docs, fit_tables(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted", "evidence"
    )


def keep_clean(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns; scored and filtered in place."""
    shared, calibration = index.shared(docs.sparkSession), index.calibration()

    @F.pandas_udf("boolean")
    def clean(texts):
        own = shared.value
        return pd.Series([p < 0.5 for p, _, _ in own.scores(list(texts), calibration)], dtype=bool)

    return spread(docs).filter(clean(F.coalesce(F.col(text_col), F.lit(""))))
