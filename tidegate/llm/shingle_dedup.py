"""Near-duplicates by shared word shingles: candidates by SimHash and multi-index hashing, each link verified.

A document is its set of WORDS-word shingles; two link if their sets' Jaccard similarity is
4/5 or more.  A long SimHash fingerprint of the set is cut into segments; the sets that have
one segment in common (two that differ in fewer bits than there are segments always do) and
are near by CHECK_WORDS words of the fingerprint, then by all of it, are candidates.
Candidates are compared by whole sets, so no link is wrong.  A bit differs in a pair at 4/5 with a chance of at most
acos(8/9) / pi, so there are as many segments as it takes to lose such a pair once in about
10,000 times (by calculation), a closer one hardly ever.

Two rounds: the first FIRST segments link most of what links at all; in the others only
sets that are still apart are candidates, so a cloud of near copies is looked at a few times
and not once a segment.

Scale: a segment is dealt into parts by its first bits; a part is one task's work, and moves
as blocks of fixed-size records.  Segments widen by a bit as the table doubles, so what a
value brings together by chance stays bounded, and grow in number, as the table's size to
the power 0.24.  Equal sets are folded first, and so are segment values shared by the same
documents.  A crowded value's documents are dealt into blocks that are compared inside; what
that leaves apart is then compared with the whole, block by block.  A comparison returns a
forest, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import bounded_batches, materialize, row_key, whole_row
from tidegate.llm.components import components
from tidegate.llm.simhash_dedup import _merge

WORDS = 5
SEED = 42
#: The chance that a bit of two sets' fingerprints differs at a similarity of 4/5, and the power of e to which such a pair is found.
DIFFER, SURE = math.acos(8 / 9) / math.pi, 9.2
#: Segments of the first round.
FIRST = 16
#: Bits of a segment, at least, and of the table's size that they leave out.
LEAST_WIDTH, SPARE = 16, 6
#: Words of a fingerprint in which candidates differ in at most NEAR bits: five deviations above the mean of a pair at 4/5.
CHECK_WORDS, NEAR = 2, 40
#: Sets of fewer shingles, whose bits differ more often, are near any by the whole fingerprint; of others a bit differs with a chance of at most DIFFER_FEW.
FEW, DIFFER_FEW = 12, 0.1612
#: Candidates of one value that are looked at again by the whole fingerprint, at most (the rest stay candidates), and those in one part of that look, about.
LOOK, LOOK_PART = 1 << 10, 1 << 12
#: Documents in one part of a segment, about; more with one value are a crowd.
PART, CROWD = 1 << 16, 1 << 12
#: Comparisons of those of a crowd that are apart from most of it, at most, before all of it are candidates.
CROWD_LOOKS = 1 << 28
#: Mean number of documents in one block of a crowded bucket.
BLOCK = 256


def shingles(text: str, words: int = WORDS):
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, one of no words has none."""
    import numpy as np
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and the six gaps only
    if not parts:
        return np.empty(0, dtype=np.uint64)
    line, hash64 = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hash64(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view = memoryview(line)
    return np.unique(np.array([hash64(view[a:b], SEED) for a, b in zip(starts[: len(ends) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64))


@dataclass(frozen=True)
class Segments:
    """How fingerprints are cut: ``count`` segments of ``width`` bits, each dealt into parts by its first ``part_bits``."""

    width: int
    count: int
    part_bits: int

    @property
    def words(self) -> int:
        """64-bit words of a fingerprint."""
        return max(CHECK_WORDS, -(-self.width * self.count // 64))


def segments_for(n: int) -> Segments:
    """The segments for a table of ``n`` documents."""
    width = max(LEAST_WIDTH, n.bit_length() - SPARE)
    return Segments(width, math.ceil(SURE / (1 - DIFFER) ** width), max(3, (n // PART).bit_length()))


def fingerprint(s, words: int) -> bytes:
    """SimHash of a set of hashes, 64 bits a word: a bit is 1 if set in over half of the set's hashes of that word."""
    import numpy as np

    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(s), 255):  # counts of a slice fit a byte
        x = s[at : at + 255, None] + steps
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(s)).tobytes()


def signatures(docs: DataFrame, cut: Segments) -> DataFrame:
    """(doc_id, _k1, _k2, node, few, fp) for each row: node hashes the set of shingles, few tells if those are fewer than FEW, fp is its fingerprint (null: no words).  Null texts count as empty."""
    long = T.LongType()
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, long) for c in ("_k1", "_k2", "node")]]
    schema = T.StructType([*fields, T.StructField("few", T.BooleanType()), T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            nodes, few, fps = [], [], []
            for t in b.column("_text").to_pylist():
                s = shingles(t or "")
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                few.append(len(s) < FEW)
                fps.append(fingerprint(s, cut.words) if len(s) else None)
            cols = [b.column(k) for k in range(3)] + [pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(few, pa.bool_()), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return bounded_batches(docs).select(docs["doc_id"], *row_key(docs), docs["text"].cast("string").alias("_text")).mapInArrow(run, schema)


def _record(value: str, words: int) -> list[tuple]:
    return [("value", value), ("node", "<i8"), ("root", "<i8"), ("check", "<u8", (words,))]


#: What a part holds of a document.
_RECORD = _record("<u4", CHECK_WORDS)


def _dealt(cut: Segments, first: int, end: int):
    """Blocks of records of (node, root, fp) rows, by segment from ``first`` to ``end`` and part."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weights = 1 << np.arange(cut.width - 1, -1, -1, dtype=np.int64)
        parts = np.arange((1 << cut.part_bits) + 1) << (cut.width - cut.part_bits)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            fps = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(n, 8 * cut.words)
            bits = np.unpackbits(fps, axis=1)
            records = np.empty(n, _RECORD)
            records["node"], records["root"] = b.column("node").to_numpy(), b.column("root").to_numpy()
            records["check"] = np.ascontiguousarray(fps[:, : 8 * CHECK_WORDS]).view("<u8")
            for k in range(first, end):
                values = bits[:, k * cut.width : (k + 1) * cut.width] @ weights
                order = np.argsort(values, kind="stable")
                records["value"] = values
                own, at = records[order], np.searchsorted(values[order], parts)
                held = np.flatnonzero(np.diff(at))
                blocks = [own[at[p] : at[p + 1]].tobytes() for p in held]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), k), pa.int32()), pa.array(held, pa.int32()), pa.array(blocks, pa.binary())], names=["segment", "part", "records"])

    return run


def _met(records, near=NEAR):
    """Which of a part's records, in order of their values, are near one with the same value and another root.

    near: bits in which near ones differ at most, for all or by record (the larger one holds for a pair).
    """
    import numpy as np

    value, root, check = records["value"], records["root"], records["check"]
    on, n = np.zeros(len(records), bool), len(records)
    near = np.broadcast_to(near, n)

    def compare(i, j) -> None:
        far = np.bitwise_count(check[i] ^ check[j]).sum(axis=1)
        hit = (far <= np.maximum(near[i], near[j])) & (root[i] != root[j])
        on[i[hit]] = True
        on[j[hit]] = True

    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    sizes = np.diff(np.append(starts, n))
    few = np.repeat(sizes <= CROWD, sizes)
    left = np.repeat(starts + sizes, sizes)  # where each one's value ends
    apart = 1
    at = np.flatnonzero(few & (np.arange(n) + 1 < left))
    while len(at):
        compare(at, at + apart)
        apart += 1
        at = at[at + apart < left[at]]
    for a, size in zip(starts[sizes > CROWD], sizes[sizes > CROWD], strict=True):
        own = np.arange(a, a + size)
        roots, count = np.unique(root[own], return_counts=True)
        others = own[root[own] != roots[count.argmax()]]
        if len(others) * size > CROWD_LOOKS:
            on[own] = True
            continue
        for i in others:
            compare(np.full(size, i), own)
    return on


def _parts(batches: Iterator, by: int) -> Iterator[tuple[list, bytes]]:
    """(part, its records) of blocks that are in order of their parts, which the first ``by`` columns name."""
    now, held = None, []
    for batch in batches:
        for *part, block in zip(*(batch.column(k).to_pylist() for k in range(by + 1)), strict=True):
            if part != now and held:
                yield now, b"".join(held)
                held = []
            now = part
            held.append(block)
    if held:
        yield now, b"".join(held)


def _candidates(batches: Iterator) -> Iterator:
    """(key, node, n) of blocks (segment, part, records) in order of segment and part: the n nodes with one key are to be compared."""
    import numpy as np
    import pyarrow as pa

    for (segment, _), block in _parts(batches, 2):
        records = np.frombuffer(block, _RECORD)
        records = records[np.argsort(records["value"], kind="stable")]
        records = records[_met(records)]
        if len(records):
            values, at, n = np.unique(records["value"], return_inverse=True, return_counts=True)
            keys = (segment << 32) | values.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(np.ascontiguousarray(records["node"])), pa.array(n[at])], names=["key", "node", "n"])


def candidates(distinct: DataFrame, cut: Segments, first: int, end: int) -> DataFrame:
    """(key, node, n): the n nodes that share a segment from ``first`` to ``end`` with a near one of another root, by that segment's value.

    distinct: (node, root, fp).
    """
    rows = distinct.where("fp IS NOT NULL").select("node", "root", "fp").mapInArrow(_dealt(cut, first, end), "segment int, part int, records binary")
    by = ("segment", "part")
    return bounded_batches(rows.repartition(*by).sortWithinPartitions(*by)).mapInArrow(_candidates, "key long, node long, n long")


def whole_near(words: int) -> int:
    """Bits of whole fingerprints in which candidates differ at most: five deviations above the mean of a pair at 4/5."""
    return math.ceil(64 * words * DIFFER_FEW + 5 * math.sqrt(64 * words * DIFFER_FEW * (1 - DIFFER_FEW)))


def _whole(words: int, parts: int):
    """Blocks of whole fingerprints' records of (node, root, few, fp, keys) rows, by ``parts`` parts of the keys."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # a row has a key for each segment at most
                b = batch.slice(start, 256)
                keys = b.column("keys").flatten().to_numpy()
                at = np.repeat(np.arange(b.num_rows), np.array(list(map(len, b.column("keys"))), np.int64))
                part = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                at, part = at[order], part[order].astype(np.int32)
                records = np.empty(len(keys), [*_record("<i8", words), ("few", "?")])
                records["value"] = keys[order]
                records["node"], records["root"] = b.column("node").to_numpy()[at], b.column("root").to_numpy()[at]
                records["few"] = b.column("few").to_numpy(zero_copy_only=False)[at]
                records["check"] = np.frombuffer(b"".join(b.column("fp").to_pylist()), "<u8").reshape(-1, words)[at]
                held, first = np.unique(part, return_index=True)
                blocks = [x.tobytes() for x in np.split(records, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(blocks, pa.binary())], names=["part", "records"])

    return run


def _look(words: int):
    """(key, node) of blocks (part, records) in order of part: the nodes that are near one with the same key and another root."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for _, block in _parts(batches, 1):
            records = np.frombuffer(block, [*_record("<i8", words), ("few", "?")])
            records = records[np.argsort(records["value"], kind="stable")]
            records = records[_met(records, np.where(records["few"], 64 * words, whole_near(words)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(records[c])) for c in ("value", "node")], names=["key", "node"])

    return run


def near_by_all(keys: DataFrame, distinct: DataFrame, cut: Segments) -> DataFrame:
    """(key, node) of those of ``keys`` (key, node, n) that are near another of their key by the whole fingerprint; keys of more than LOOK nodes stay whole.

    distinct: (node, root, few, fp).
    """
    some = keys.where(F.col("n") <= LOOK)
    own = some.groupBy("node").agg(F.collect_list("key").alias("keys"))
    rows = bounded_batches(distinct.join(own, "node").select("node", "root", "few", "fp", "keys"))
    rows = rows.mapInArrow(_whole(cut.words, some.count() // LOOK_PART + 1), "part int, records binary")
    met = bounded_batches(rows.repartition("part").sortWithinPartitions("part")).mapInArrow(_look(cut.words), "key long, node long")
    return met.unionByName(keys.where(F.col("n") > LOOK).select("key", "node"))


def _sets(texts: DataFrame) -> DataFrame:
    """(node, hashes) of rows (node, _text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [shingles(t or "").tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])

    return bounded_batches(texts).select("node", "_text").mapInArrow(run, "node long, hashes binary")


def _forest(nodes, asks, sets):
    """Links that connect every two sets at 4/5 or more of which the second asks."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    labels, mark = np.arange(len(sets)), np.zeros(len(values), dtype=np.int32)
    for i in np.flatnonzero(asks):
        own = place[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[place], starts)
        mark[own] = 0
        hit = np.flatnonzero(9 * common >= 4 * (sizes + sizes[i]))
        labels = _merge(labels, hit, np.full(len(hit), i))
    other = np.flatnonzero(labels != np.arange(len(sets)))
    return nodes[labels[other]], nodes[other]


def _links(rows: DataFrame) -> DataFrame:
    """Links (a, b) from rows (key, bs, ba, asks, node, hashes): a group is a block, or a pair of blocks."""
    order = ("key", "bs", "ba")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def links_of(held):
            asks, nodes = (np.array(x) for x in list(zip(*held, strict=True))[:2])
            if len(held) > 1 and asks.any():
                a, b = _forest(nodes, asks, [np.frombuffer(h[2], dtype=np.uint64) for h in held])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for *group, asks, node, hashes in zip(*cols, strict=True):
                if group != now and held:
                    yield from links_of(held)
                    held = []
                now = group
                held.append((asks, node, hashes))
        if held:
            yield from links_of(held)

    dealt = rows.select(*order, "asks", "node", "hashes").repartition(*order).sortWithinPartitions(*order)
    return bounded_batches(dealt).mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, distinct: DataFrame, keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect every two nodes that share a key and 4/5 of their shingles.

    distinct: (node, row), row being the keys of one row of ``docs`` with that set; keys:
    (key, node), see :func:`near_by_all`.
    """
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    bucket = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *same).where("n > 1")
    bucket = materialize(bucket.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")), "buckets")
    members = materialize(keys.join(bucket.select("key", "n"), "key").select("node", "key", "n"), "members")
    # The sets of those that meet another.
    row = distinct.join(members.select("node").distinct(), "node", "left_semi").select("node", "row._k1", "row._k2")
    texts = docs.select(*row_key(docs), docs["text"].cast("string").alias("_text")).join(row, ["_k1", "_k2"]).dropDuplicates(["node"])
    sets = materialize(_sets(texts), "sets")
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.ceil(F.col(n) / block)).cast("int")
    inside = members.select("node", "key", dealt("n").alias("bs"), F.lit(0).alias("ba"), F.lit(True).alias("asks"))
    found = materialize(_links(inside.join(sets, "node")), "links")
    crowded = members.where(F.col("n") > block)
    if crowded.isEmpty():
        return found
    # Crowded buckets that still hold several components: all but the largest one's members ask the whole bucket.
    root = components(found).withColumnRenamed("node", "_node")
    crowded = materialize(crowded.join(root, F.col("node") == F.col("_node"), "left").select("node", "key", "n", F.coalesce("root", "node").alias("root")), "crowded")
    main = crowded.groupBy("key", "root").agg(F.count(F.lit(1)).alias("h")).groupBy("key").agg(F.max(F.struct("h", "root")).alias("m"), F.sum("h").alias("all"))
    main = materialize(main.where("all > m.h").select("key", F.col("m.root").alias("main"), (F.col("all") - F.col("m.h")).alias("na")), "main")
    apart = crowded.join(main, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / block) - 1).cast("int")))
    stored = apart.select("node", "key", dealt("n").alias("bs"), every("na").alias("ba"), F.lit(False).alias("asks"))
    asking = apart.where("root <> main").select("node", "key", every("n").alias("bs"), dealt("na").alias("ba"), F.lit(True).alias("asks"))
    return found.unionByName(materialize(_links(stored.unionByName(asking).join(sets, "node")), "links"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, _k1, _k2, root) for each row of ``docs``: root stands for the component.

    Texts of no words (null, empty) are one component.
    """
    cut = segments_for(docs.count())
    each = materialize(signatures(docs, cut), "signatures")
    distinct = materialize(each.groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("row"), F.first("few").alias("few"), F.first("fp").alias("fp")), "distinct")
    placed = lambda found: materialize(
        distinct.join(components(found), "node", "left").select("node", "few", "fp", F.coalesce("root", "node").alias("root")), "placed"
    )
    found = None
    apart = distinct.withColumn("root", F.col("node"))
    for first, end in ((0, FIRST), (FIRST, cut.count)):
        keys = materialize(candidates(apart, cut, first, end), "candidates")
        keys = materialize(near_by_all(keys, apart, cut), "near")
        more = materialize(links(docs, distinct, keys, block), "links")
        found = more if found is None else found.unionByName(more)
        apart = placed(found)
    return each.select("doc_id", "_k1", "_k2", "node").join(apart.select("node", "root"), "node").select("doc_id", "_k1", "_k2", "root")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id's (nulls last), and of its repeated rows one.

    Null and empty texts are one component; columns are kept whatever their names; an empty
    table gives none.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    chosen = near_duplicates(docs, block).groupBy("root").agg(F.min(row).alias("r")).select("r._k1", "r._k2")
    keyed = docs.select(whole_row(docs), *row_key(docs)).join(chosen, ["_k1", "_k2"], "left_semi")
    return keyed.dropDuplicates(["_k1", "_k2"]).select("row.*")
