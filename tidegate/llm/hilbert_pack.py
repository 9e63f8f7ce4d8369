"""Packing along a space-filling curve.

A document's token ids are hashed into a vector, projected to three dimensions and placed
on a Hilbert curve.  Documents are range-sorted by that key and laid end to end, so a
sequence holds neighbours of the curve.  A task packs its own range: all of its sequences
but the last few are full, and the rest of a range is cut into powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import bounded_batches, materialize, text_or_empty
from tidegate.llm.token_ids import encoder

LENGTH = 4096
END_ID = 2
DIMS, BITS = 3, 16
HASHED = 256
#: Input bytes (as stored) a range holds about.
RANGE_BYTES = 16 << 20


@cache
def _projection():
    """Signed hash bucket of every possible id below 2^16, and the fixed projection of the buckets."""
    import numpy as np

    ids = np.arange(1 << 16, dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # multiplicative hashing; wraps
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed >>= np.uint64(32)
    return (mixed % np.uint64(2 * HASHED)).astype(np.int64), np.random.default_rng(7).standard_normal((HASHED, DIMS))


def hilbert_key(axes, bits: int = BITS):
    """Distance along the Hilbert curve of points (n, dims) of ``bits``-bit coordinates (Skilling, 2004)."""
    import numpy as np

    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids, ends) -> list[int]:
    """Hilbert keys of documents: document k is ids[ends[k]:ends[k + 1]]."""
    import numpy as np

    bucket, project = _projection()
    n, wide = len(ends) - 1, 2 * HASHED
    doc = np.repeat(np.arange(n) * wide, np.diff(ends))
    counts = np.bincount(doc + bucket[ids & 0xFFFF], minlength=n * wide).reshape(n, wide).astype(np.float64)
    v = counts[:, :HASHED] - counts[:, HASHED:]
    at = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ project
    # A logistic curve in place of the normal distribution spreads the coordinates.
    cells = np.floor((1 << BITS) / (1 + np.exp(-1.7 * at))).astype(np.int64).clip(0, (1 << BITS) - 1)
    return hilbert_key(cells).tolist()


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, curve, n, wide, ids) of each row; ids as little-endian unsigned 16-bit integers if they fit, else 32-bit (wide)."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("curve", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("wide", T.BooleanType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not len(b):
                continue
            ids, ends = encoder(tokenizer).encode(b.column("text"), end_id)
            wide = np.maximum.reduceat(ids, ends[:-1]) > 0xFFFF
            told = [ids[x:y].astype("<u4" if w else "<u2").tobytes() for x, y, w in zip(ends.tolist(), ends[1:].tolist(), wide.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(curve_keys(ids, ends), pa.int64()), pa.array(np.diff(ends)), pa.array(wide), pa.array(told, pa.binary())], names=schema.names
            )

    return bounded_batches(docs).select(docs["doc_id"], text_or_empty(docs["text"]).alias("text")).mapInArrow(run, schema)


def _ranges(docs: DataFrame) -> int:
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(docs.sparkSession.sparkContext.defaultParallelism, min(200_000, size // RANGE_BYTES + 1))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all rows of ``docs``.

    ids: the piece's ids, little-endian unsigned 32-bit.  A sequence is at most ``length``
    ids, without gaps; one shorter than that is a power of two, so nothing is padded.
    sequence_id is unique, not dense.  Null and empty texts are the end id alone.  Rows that
    tie on the curve stand by doc_id (nulls first); repeated rows are packed each; columns
    but doc_id and text are left out; an empty table gives none.  Ids stay with their curve
    position in one written table, so neither tokenizing nor sampling runs twice.
    """
    table = materialize(encoded(docs, tokenizer, end_id), "packed-ids")
    ordered = table.withColumn("_tie", F.crc32("ids")).repartitionByRange(_ranges(docs), "curve", "doc_id", "_tie").sortWithinPartitions("curve", "doc_id", "_tie", "n").drop("_tie")
    long = T.LongType()
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("start", long), T.StructField("length", long),
        T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        kind = docs_type
        tail: list[list] = []  # pieces of the open sequence
        at = done = 0

        def emit(rows: list[list]):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.binary())], names=schema.names)

        out: list[list] = []
        for b in batches:
            for doc, n, wide, raw in zip(*(b.column(k).to_pylist() for k in ("doc_id", "n", "wide", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype="<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < n:
                    take = min(n - start, length - at)
                    tail.append([doc, start, take, n, base + done, at, ids[start : start + take].tobytes()])
                    start, at = start + take, at + take
                    if at == length:
                        out += tail
                        tail, at, done = [], 0, done + 1
                if len(out) >= 1000:
                    yield emit(out)
                    out = []
        # What is left becomes sequences of powers of two, the largest first.
        for doc, start, take, n, _, offset, ids in tail:
            while take:
                cut = offset_of = 0
                for p in range(at.bit_length() - 1, -1, -1):
                    if at >> p & 1:
                        if offset < cut + (1 << p):
                            break
                        cut, offset_of = cut + (1 << p), offset_of + 1
                part = min(take, cut + (1 << p) - offset)
                out.append([doc, start, part, n, base + done + offset_of, offset - cut, ids[: 4 * part]])
                start, take, offset, ids = start + part, take - part, offset + part, ids[4 * part :]
        if out:
            yield emit(out)

    from pyspark.sql.pandas.types import to_arrow_type

    docs_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return ordered.mapInArrow(run, schema)
