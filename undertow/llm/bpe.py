"""BPE encoding and decoding of whole texts.

A pass of Arrow batches through the scan's partitions: no shuffle, and a lost task repeats its own partition only.
Each worker keeps one vocabulary and a bounded memo of recent pre-tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm import wordbpe
from undertow.llm.common import read, spread


#: Rows encoded at a time; their ids are handed on before the next rows are read.
SLICE = 256


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``out_col`` array<int>, the token ids of ``text_col``; null text has none. It replaces a column of that name."""
    path = path or wordbpe.default_path()
    docs = docs.drop(out_col) if out_col != text_col else docs
    names = [c for c in docs.columns if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                packed = [bpe.encode(t.as_py() or "") for t in part.column(text_col)]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids], [*names, out_col])

    return spread(docs).mapInArrow(run, schema)


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with ``out_col`` string, the decoded ``ids_col``; null ids decode to an empty text."""
    path = path or wordbpe.default_path()

    @F.pandas_udf("string")
    def text(ids):
        bpe = wordbpe.load(path)
        return ids.map(lambda x: bpe.decode(np.asarray([] if x is None else x, "<u4").tobytes()))

    return docs.withColumn(out_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and decodes each text where it is: ``id_col, n_tokens, ids_sha256, decoded_sha256, decoded_chars``.

    One row per input row, whatever its id; null text counts as empty and has no tokens. Only digests leave the
    worker, for callers that verify or fingerprint a corpus without keeping its ids.
    """
    path = path or wordbpe.default_path()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path)
        for batch in batches:
            n, ids_sha, decoded_sha, chars = [], [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py())
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                chars.append(len(decoded))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(chars, pa.int64())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = spread(rows).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")
    return out.withColumnRenamed("id", id_col)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
