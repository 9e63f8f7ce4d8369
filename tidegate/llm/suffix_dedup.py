"""Removing long passages that occur more than once, found in suffix arrays of shards.

A window is a string of LENGTH bytes.  Its mark is the least hash of its GRAM-byte strings,
so equal windows have equal marks wherever they are.  A run is a stretch of windows of one
text with one mark; runs whose mark occurs once hold no repeated window.  The bytes of the
other runs are dealt by mark to shards of about SHARD_BYTES; a shard's suffix array (induced
sorting) and permuted common prefixes tell its repeated windows exactly.

Scale: whole texts are told apart by two 64-bit hashes and handled once, however many copies
there are; they are dealt out once, into a table bucketed by those hashes, so that later
passes over them move only what they are told.  Equal runs are one in a shard, with their
number.  A mark with more than MARK_BYTES of different runs is not sorted in one task: the
windows of such runs are counted by hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import bounded_batches, columns_of, fresh_path, materialize, quoted, text_or_empty, unused

LENGTH = 400
GRAM = 64
SHARD_BYTES = 512 << 10
#: Bytes of the different runs of one mark that a shard takes.
MARK_BYTES = 1 << 20
#: Bytes that a task hashes at once, and windows of a run; longer ones are cut, which loses nothing.
PIECE = 1 << 20
RUN = 1 << 14

_BASE = 0x9E3779B97F4A7C15
_RUNS = "mark long, k1 long, k2 long, start long, n long, weight int"
_CONTEXTS = "mark long, c1 long, c2 long, n long, bytes binary, k1 long, k2 long, start long, copies long"
_SPANS = "c1 long, c2 long, first long, end long"
_KEPT = "k1 long, k2 long, spans array<struct<start:long,end:long>>, kept binary"


def text_table(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, text, copies) of the different texts of at least ``length`` bytes, bucketed by k1, k2."""
    spark = docs.sparkSession
    long_ = docs.where(F.octet_length("text") >= length).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    # As many buckets as the aggregate has partitions: each is written by one task.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    long_.write.format("parquet").option("path", fresh_path(spark, name)).bucketBy(buckets, "k1", "k2").saveAsTable(name)
    return spark.table(name)


def _flat(column):
    """(bytes, ends) of an Arrow binary column."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _powers(n: int):
    import numpy as np

    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out


def _marks(data, gram: int, length: int, powers):
    """For each window of ``data``: the least hash of its grams; and the grams' hashes."""
    import numpy as np

    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers[0][:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * powers[1][: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h = (h >> np.uint64(1)).astype(np.int64)
    width, windows = length - gram + 1, n - length + 1
    blocks = np.full(-(-len(h) // width) * width, np.iinfo(np.int64).max, np.int64)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]), h


def _runs_of(length: int, gram: int, piece: int):
    """Runs of texts (k1, k2, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        powers = None
        for batch in batches:
            data, ends = _flat(batch["text"])
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for lo in range(0, max(1, len(data) - length + 1), piece):
                part = data[lo : lo + piece + length - 1]
                if len(part) < length:
                    continue
                powers = _powers(piece + length) if powers is None else powers
                marks, grams = _marks(part, gram, length, powers)
                at = lo + np.arange(len(marks))
                text = np.searchsorted(ends, at, "right") - 1
                inside = at + length <= ends[text + 1]
                new = np.ones(len(marks), bool)
                new[1:] = (marks[1:] != marks[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
                starts = np.flatnonzero(new)
                counts = np.diff(np.append(starts, len(marks)))
                cuts = -(-counts // RUN)
                starts = np.repeat(starts, cuts) + RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
                counts = np.diff(np.append(starts, len(marks)))
                kept = inside[starts]
                starts, counts = starts[kept], counts[kept]
                if not len(starts):
                    continue
                value, owner = marks[starts], text[starts]
                # A mark at two places may repeat a window inside one run.
                low = np.sort(grams[grams <= value.max()])
                twice = np.isin(value, low[1:][low[1:] == low[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value), pa.array(k1[owner]), pa.array(k2[owner]), pa.array(lo + starts - ends[owner]), pa.array(counts), pa.array(np.where(twice, 2, 1).astype(np.int32))],
                    names=["mark", "k1", "k2", "start", "n", "weight"],
                )

    return run


def _context_rows(length: int, at_once: int = 2 << 20):
    """The bytes of runs, once a batch for equal ones."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ("mark", "c1", "c2", "n", "bytes", "k1", "k2", "start", "copies")
        out, size, seen = [], 0, set()

        def written():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for k1, k2, text, copies, runs in zip(*(batch[c] for c in ("k1", "k2", "text", "copies", "runs")), strict=True):
                data = text.as_buffer()
                k1, k2, copies = k1.as_py(), k2.as_py(), copies.as_py()
                for r in runs.as_py():
                    own = data[r["start"] : r["start"] + r["n"] + length - 1].to_pybytes()
                    name = xxhash.xxh3_128_digest(own)
                    c1, c2 = (int.from_bytes(name[k : k + 8], "big", signed=True) for k in (0, 8))
                    first = name not in seen
                    seen.add(name)
                    out.append((r["mark"], c1, c2, r["n"], own if first else None, k1, k2, r["start"], copies))
                    size += 100 + (len(own) if first else 0)
                    if size >= at_once:
                        yield written()
                        out, size, seen = [], 0, set()
        if out:
            yield written()

    return run


def _repeated_in_shard(length: int):
    """Spans of repeated windows in a shard's contexts (c1, c2, n, bytes, weight)."""

    def run(shard):
        import numpy as np
        import pyarrow as pa

        from tidegate.llm.suffix_arrays import common_prefixes, suffix_array

        shard = shard.combine_chunks()
        column = shard["bytes"]
        data, ends = _flat(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        n, weight = shard["n"].to_numpy(), shard["weight"].to_numpy()
        order = suffix_array(data)
        prefix = common_prefixes(data, order)
        # Windows that share all their bytes follow each other in order.
        group = np.cumsum(prefix[order] < length)
        windows = np.concatenate([np.arange(s, s + k) for s, k in zip(ends[:-1], n, strict=True)])
        owner = np.repeat(np.arange(len(n)), n)
        of = np.empty(len(data), np.int64)
        of[order] = group
        times = np.bincount(of[windows], weights=weight[owner])
        on = times[of[windows]] >= 2
        at, who = windows[on], owner[on]
        if not len(at):
            return pa.table({c: pa.array([], pa.int64()) for c in ("c1", "c2", "first", "end")})
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (who[1:] != who[:-1])
        first = np.flatnonzero(new)
        final = np.append(first[1:], len(at)) - 1
        who = who[first]
        return pa.table({"c1": shard["c1"].to_numpy()[who], "c2": shard["c2"].to_numpy()[who], "first": at[first] - ends[who], "end": at[final] - ends[who] + length})

    return run


def _window_rows(length: int, at_once: int = 100_000):
    """Hashes of the windows of contexts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for c1, c2, n, own, weight in zip(*(batch[c].to_pylist() for c in ("c1", "c2", "n", "bytes", "weight")), strict=True):
                for lo in range(0, n, at_once):
                    at = range(lo, min(n, lo + at_once))
                    w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(own[i : i + length]) for i in at), "<i8").reshape(-1, 2)
                    one = np.ones(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c1 * one, c2 * one, np.array(at, np.int64), w[:, 0], w[:, 1], weight * one)], names=["c1", "c2", "at", "w1", "w2", "weight"])

    return run


def _spans_by_window(crowded: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of contexts whose marks are too frequent for one task."""
    windows = materialize(crowded.select("c1", "c2", "n", "bytes", "weight").mapInArrow(_window_rows(length), "c1 long, c2 long, at long, w1 long, w2 long, weight long"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("times")).where("times > 1").select("w1", "w2")
    # All windows of a context that are repeated, as islands: a position less its rank is one value in each.
    found = windows.join(twice, ["w1", "w2"], "left_semi").groupBy("c1", "c2").agg(F.sort_array(F.collect_list("at")).alias("at"))
    each = found.select("c1", "c2", F.posexplode("at").alias("nth", "at"))
    return each.groupBy("c1", "c2", (F.col("at") - F.col("nth")).alias("island")).agg(F.min("at").alias("first"), (F.max("at") + length).alias("end")).drop("island")


def _cut(batches: Iterator) -> Iterator:
    """Texts without their spans, which may overlap and touch."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for k1, k2, text, spans in zip(*(batch[c] for c in ("k1", "k2", "text", "spans")), strict=True):
            data, merged = text.as_buffer(), []
            for s in sorted((s["start"], s["end"]) for s in spans.as_py()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            edges = [0, *(x for s in merged for x in s), len(data)]
            kept = b"".join(data[a:b].to_pybytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((k1.as_py(), k2.as_py(), [{"start": a, "end": b} for a, b in merged], kept))
        if out:
            k1, k2, spans, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["k1", "k2", "spans", "kept"])


@dataclass(frozen=True)
class Repeats:
    """texts: (k1, k2, text, copies).  parts: (k1, k2, start, end) spans, one text's may overlap, of texts that occur once."""

    texts: DataFrame
    parts: DataFrame

    def changed(self) -> DataFrame:
        """(k1, k2, spans, kept) of texts that lose anything: maximal spans in order, and the bytes left."""
        spans = self.parts.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        told = self.texts.join(spans, ["k1", "k2"]).select("k1", "k2", F.col("text").cast("binary").alias("text"), "spans")
        whole = self.texts.where("copies > 1").select("k1", "k2", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"))).alias("spans"), F.lit(b"").alias("kept"))
        return told.mapInArrow(_cut, _KEPT).unionByName(whole)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), k1, k2 of documents."""
    text = text_or_empty(docs[quoted("text")])
    return docs.select(docs[quoted("doc_id")].alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"))


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, mark_bytes: int = MARK_BYTES, piece: int = PIECE) -> Repeats:
    """Where texts hold strings of ``length`` bytes that also start elsewhere, in the same or another document.

    docs: (text, k1, k2) as :func:`keyed` gives them.
    """
    texts = bounded_batches(text_table(docs, length))
    plain = texts.select("k1", "k2", F.col("text").cast("binary").alias("text"), "copies")
    runs = materialize(plain.mapInArrow(_runs_of(length, gram, piece), _RUNS), "runs")
    twice = runs.groupBy("mark").agg(F.sum("weight").alias("times")).where("times > 1").select("mark")
    told = runs.join(twice, "mark", "left_semi").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "mark")).alias("runs"))
    contexts = materialize(plain.join(told, ["k1", "k2"]).mapInArrow(_context_rows(length), _CONTEXTS), "contexts")
    known = contexts.groupBy("c1", "c2").agg(F.first("mark").alias("mark"), F.first("n").alias("n"), F.first("bytes", ignorenulls=True).alias("bytes"), F.sum("copies").alias("weight"))
    known = materialize(known, "contexts")
    sizes = materialize(known.groupBy("mark").agg(F.sum(F.octet_length("bytes")).alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    crowded = sizes.where(F.col("size") > mark_bytes).select("mark")
    shards = max(1, -(-total // shard_bytes))
    few = known.join(crowded, "mark", "left_anti").withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)))
    spans = few.select("shard", "c1", "c2", "n", "bytes", "weight").groupBy("shard").applyInArrow(_repeated_in_shard(length), _SPANS)
    if not crowded.isEmpty():
        spans = spans.unionByName(_spans_by_window(known.join(crowded, "mark", "left_semi"), length).select("c1", "c2", "first", "end"))
    spans = materialize(spans, "spans")
    own = contexts.where("copies = 1").select("c1", "c2", "k1", "k2", "start")
    parts = own.join(spans, ["c1", "c2"]).select("k1", "k2", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("end")).alias("end"))
    return Repeats(texts, parts)


def digest(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document without its repeated passages.

    Null texts are empty; an empty or short text loses nothing; texts that occur more than
    once go whole if they have ``length`` bytes; null and repeated doc_ids have a row each;
    an empty table gives none; other columns count for nothing.
    """
    told = keyed(docs)
    rows = materialize(told.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "documents")
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    changed = find_repeats(told, length, **sizes).changed().select("k1", "k2", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    none = F.lit(0).cast("long")
    return rows.join(changed, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """``docs`` with two more columns: ``removed`` (spans in bytes) and ``kept`` (the bytes left); see :func:`digest`."""
    removed, kept = unused(docs, "removed"), unused(docs, "kept")
    changed = find_repeats(keyed(docs), length, **sizes).changed()
    text = text_or_empty(docs[quoted("text")])
    named = docs.select(F.struct(*columns_of(docs)).alias("row"), text.cast("binary").alias("text"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"))
    joined = named.join(changed, ["k1", "k2"], "left")
    none = F.array().cast(changed.schema["spans"].dataType)
    return joined.select("row.*", F.coalesce("spans", none).alias(removed), F.coalesce("kept", "text").alias(kept))
