"""Token counts without ids: pieces are counted once per distinct pre-token.

One pass over the texts turns each block of documents into pre-token frequencies: one row per distinct pre-token of
the block, with its (document, frequency) postings packed into 4 bytes each. These rows meet by pre-token, where the
pre-token's pieces are counted once, and the products are summed per document.

At scale: what is shuffled is the frequencies, not the texts, and a frequent pre-token has one row per block rather
than per occurrence. Pre-tokens found in many documents of a block are salted by block, so no task holds all postings
of a hot one; the others are counted exactly once. Sums are added up per task and shuffled as one packed row per
block, which knows its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import wordbpe
from undertow.llm.common import read, spread

BLOCK_CHARS, BLOCK_DOCS = 16_000_000, 1 << 14
FREQ_BITS = 18  # of the 32 bits of a posting; the others number the document in its block
HOT_SHARE, SALTS = 0.05, 64
FLUSH_POSTINGS = 2_000_000
OWN = ["id", "n_bytes", "special"]  # of each document of a block


def _packed(batch: pa.RecordBatch) -> bytes:
    """``batch`` as one value. List columns, null in all rows but one, would cost Spark a walk over the batch for each row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _postings(texts: list[str], bpe: wordbpe.WordBpe) -> tuple[list[str], np.ndarray, pa.Array, list[int]]:
    """Pre-tokens of a block, in how many of its documents each is, their postings, and each document's special tokens."""
    seen: dict[str, int] = {}
    word, doc, freq, special = [], [], [], []
    for text in texts:
        count: Counter = Counter()
        pieces = bpe.pieces(text)
        for piece in pieces[::2]:
            count.update(bpe.words(piece))
        special.append(len(pieces) // 2)
        word.extend([seen.setdefault(w, len(seen)) for w in count])
        freq.extend(count.values())
        doc.append(len(count))
    word, freq = np.array(word, np.int64), np.array(freq, np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), doc)
    most = (1 << FREQ_BITS) - 1
    while (over := freq > most).any():  # what does not fit into one posting goes into more
        word, doc = np.concatenate([word, word[over]]), np.concatenate([doc, doc[over]])
        freq = np.concatenate([np.minimum(freq, most), freq[over] - most])
    order = np.argsort(word, kind="stable")
    packed = ((doc[order] << FREQ_BITS) | freq[order]).astype("<u4").tobytes()
    counts = np.bincount(word, minlength=len(seen))
    ends = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed)])
    return list(seen), counts, blobs, special


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_tokens``.

    Null text counts as empty: no bytes, no tokens. Rows are told apart by their place in their block, so null and
    repeated ids keep a row each. An empty table gives an empty result.
    """
    path = path or wordbpe.default_path()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spread(docs.select(F.col(id_col).alias("id"), text.alias("text"))).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    first = "word string, salt int, block long, postings binary"

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path)
        block, ids, texts, chars = 0, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            words, counts, blobs, special = _postings(texts, bpe)
            n, salt = len(words), block % 1_000_003
            hot = np.where(counts > max(32, HOT_SHARE * len(texts)), salt % SALTS + 1, 0).astype(np.int32)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            own = _packed(pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(special, pa.int64())], OWN))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(hot), pa.array(np.full(n, block)), blobs], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([salt], pa.int32()), pa.array([block]), pa.array([own])], names)

        names = [f.split()[0] for f in first.split(", ")]
        for batch in batches:
            id_type = batch.schema.field("id").type
            for row, key, text in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if texts and (chars + len(text) > BLOCK_CHARS or len(texts) == BLOCK_DOCS):
                    yield from done()
                    ids, texts, chars = [], [], 0
                if not texts:
                    block = row
                ids.append(key)
                texts.append(text)
                chars += len(text)
        if texts:
            yield from done()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path)
        last, n, held, size = None, 0, [], 0
        names = ["block", "sums", "own"]

        def flush() -> pa.RecordBatch:
            """One row per block seen, with packed (document, tokens) pairs."""
            block, doc, tokens = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, block))
            block, doc, tokens = block[order], doc[order], tokens[order]
            starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])]))
            pairs = np.stack([doc[starts], np.add.reduceat(tokens, starts)], 1).astype("<u4")
            block = block[starts]
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            sums = [pairs[a:z].tobytes() for a, z in zip(edges, [*edges[1:], len(block)])]
            return pa.RecordBatch.from_arrays([pa.array(block[edges]), pa.array(sums, pa.binary()), pa.nulls(len(sums), pa.binary())], names)

        for batch in batches:
            words, blobs = batch.column("word").to_pylist(), batch.column("postings")
            each = np.zeros(len(words), np.int64)
            for k, word in enumerate(words):
                if word is not None:
                    if word != last:
                        last, n = word, len(bpe.parts(word))
                    each[k] = n
            whole = batch.filter(batch.column("word").is_null())
            if whole.num_rows:
                yield pa.RecordBatch.from_arrays([whole.column("block"), pa.nulls(whole.num_rows, pa.binary()), whole.column("postings")], names)
            full = np.flatnonzero(batch.column("word").is_valid().to_numpy(zero_copy_only=False))
            if len(full):
                parts = blobs.take(pa.array(full)).to_pylist()
                lens = np.array([len(p) // 4 for p in parts])
                posting = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
                block = np.repeat(batch.column("block").take(pa.array(full)).to_numpy(), lens)
                held.append((block, posting >> FREQ_BITS, (posting & ((1 << FREQ_BITS) - 1)) * np.repeat(each[full], lens)))
                size += len(posting)
            if size >= FLUSH_POSTINGS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, own = None, np.zeros(BLOCK_DOCS, np.int64), None

        def done() -> pa.RecordBatch:
            ids, size, special = own.columns
            n = tokens[: len(ids)] + special.to_numpy()
            return pa.RecordBatch.from_arrays([ids, size, pa.array(n)], ["id", "n_bytes", "n_tokens"])

        for batch in batches:
            for k, block in enumerate(batch.column("block").to_pylist()):
                if block != now:
                    if now is not None:
                        yield done()
                    now, tokens, own = block, np.zeros(BLOCK_DOCS, np.int64), None
                pairs = batch.column("sums")[k]
                if pairs.is_valid:
                    pairs = np.frombuffer(pairs.as_py(), "<u4").reshape(-1, 2).astype(np.int64)
                    tokens[pairs[:, 0]] += pairs[:, 1]
                else:
                    own = pa.ipc.open_stream(batch.column("own")[k].as_py()).read_next_batch()
        if now is not None:
            yield done()

    meet = rows.mapInArrow(frequencies, first).repartition("word", "salt").sortWithinPartitions("word")
    packed = meet.mapInArrow(pieces, "block long, sums binary, own binary")
    blocks = packed.repartition("block").sortWithinPartitions("block")
    return blocks.mapInArrow(sums, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    counts = token_counts(read(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
