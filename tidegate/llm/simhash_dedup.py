"""SimHash near-duplicates by multi-index hashing.

Fingerprints (64 bits, from repeated word shingles) link when few bits differ.  A
fingerprint is cut into segments; if two differ in at most RADIUS bits, the pigeonhole
principle bounds their difference in one segment.  Every distinct fingerprint is stored
under each segment's value and asks for all values in a small Hamming ball round it; what
it finds is compared in full.

Wide segments keep what a value finds by chance small, but their balls are large, so a ball
is not shuffled value by value.  A segment's table is dealt into parts by its first bits; a
fingerprint goes to each part its ball reaches and enumerates there the rest of the ball.
Parts grow in number with the table, so a part stays one task's work, and the copies of a
fingerprint grow only with the square of the logarithm of the table.
Copies are folded into one fingerprint first.  A crowded part is dealt into blocks of
stored and of asking fingerprints; each pair of blocks returns a forest that connects what
it found linked, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import bounded_batches, materialize, row_key, whole_row
from tidegate.llm.components import components

WORDS = 4
RADIUS = 4
SEGMENTS = 2
SEED = 42
#: A segment's table is dealt into parts by its values' first bits, at least so many and so many more that a part holds about PART fingerprints.
LEAST_PART_BITS, PART = 6, 1 << 14
#: Mean numbers of stored and asking fingerprints in one block of a crowded part.
STORED_BLOCK, ASKING_BLOCK = 1 << 16, 1 << 18
#: Comparisons held at a time.
_CHUNK = 1 << 21


def fingerprint(text: str, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text of no words."""
    import numpy as np
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and the six gaps only
    if not parts:
        return 0
    line = b" ".join(parts)
    hash64 = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hash64(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view, n = memoryview(line), len(parts) - words + 1
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        to = min(at + 65536, n)
        h = np.array([hash64(view[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist(), strict=True)], dtype="<u8")
        # How often each byte value stands at each place, times the bits of that value.
        seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
        set_bits += (seen @ _byte_bits()).ravel()
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def _byte_bits():
    import numpy as np

    return np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, _k1, _k2, fp) for each row; fp is the fingerprint's bits as a signed long.

    _k1 and _k2 hash the whole row.  Null texts count as empty.
    """
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, long) for c in ("_k1", "_k2", "fp")]])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t or "", words) for t in b.column("_text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(3)] + [pa.array(fps.view(np.int64))], names=schema.names)

    return bounded_batches(docs).select(docs["doc_id"], *row_key(docs), docs["text"].cast("string").alias("_text")).mapInArrow(run, schema)


def _segments(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment: radius = n * a + r gives r + 1 segments radius a, the rest a - 1."""
    a, r = divmod(radius, n)
    out, shift = [], 0
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        out.append((shift, width, a if k <= r else a - 1))
        shift += width
    return [x for x in out if x[2] >= 0]


def _ball(width: int, radius: int) -> list[int]:
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in range(width)}
    return sorted(masks)


def _forest(stored, asking, shift: int, width: int, radius: int, part: int, part_bits: int, within: int):
    """Links that connect stored and asking fingerprints within ``within`` bits whose segment differs in at most ``radius``.

    part: the first bits of the stored ones' segment.  Arrays of distinct unsigned 64-bit.
    """
    import numpy as np

    low = width - part_bits
    cut = lambda fp: (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    stored = stored[np.argsort(cut(stored), kind="stable")]
    values, first, count = np.unique(cut(stored), return_index=True, return_counts=True)
    nodes = np.unique(np.concatenate((stored, asking)))
    mine, labels = np.searchsorted(nodes, stored), np.arange(len(nodes))
    own = cut(asking)
    left = radius - np.bitwise_count((own >> np.uint64(low)) ^ np.uint64(part)).astype(int)
    for r in range(radius + 1):
        ask, seg = asking[left == r], own[left == r]
        # Into this part, then every value of what is left of the ball.
        seg = (seg & np.uint64((1 << low) - 1)) | np.uint64(part << low)
        for m in _ball(low, r) if len(ask) else ():
            want = seg ^ np.uint64(m)
            at = np.searchsorted(values, want).clip(0, len(values) - 1)
            hit = np.flatnonzero(values[at] == want)
            if not len(hit):
                continue
            sizes = count[at[hit]]
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(hit):  # a run of equal segments is expanded bit by bit
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _CHUNK, "right")))
                n, who = sizes[begin:end], hit[begin:end]
                k = np.repeat(first[at[who]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                x = np.repeat(ask[who], n)
                good = np.bitwise_count(x ^ stored[k]) <= within
                labels = _merge(labels, mine[k[good]], np.searchsorted(nodes, x[good]))
                begin = end
    other = labels != np.arange(len(nodes))
    return nodes[labels[other]], nodes[other]


def _merge(labels, a, b):
    """Least labels after joining nodes a[i] and b[i]; a label is a node that labels itself."""
    import numpy as np

    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            new = labels[labels]
            if (new == labels).all():
                break
            labels = new
    return labels


def _links(batches: Iterator, cut: list[tuple[int, int, int]], part_bits: int, within: int) -> Iterator:
    """Links (a, b) from rows (seg, part, bs, ba, asks, fp) sorted by the first four: a group is a pair of blocks."""
    import numpy as np
    import pyarrow as pa

    def links_of(cols):
        asks, fp = cols[4], cols[5]
        shift, width, radius = cut[int(cols[0][0])]
        stored, asking = fp[asks == 0], fp[asks == 1]
        if len(stored) and len(asking):
            a, b = _forest(stored, asking, shift, width, radius, int(cols[1][0]), part_bits, within)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list = []  # pieces of the group that may go on in the next batch
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        cols[5] = cols[5].view(np.uint64)
        if not len(cols[0]):
            continue
        turns = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:4]], axis=0)) + 1
        for lo, hi in zip([0, *turns], [*turns, len(cols[0])], strict=True):
            piece = [c[lo:hi] for c in cols]
            if held and any(h[0] != p[0] for h, p in zip(held[-1][:4], piece[:4], strict=True)):
                yield from links_of([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            held.append(piece)
    if held:
        yield from links_of([np.concatenate(x) for x in zip(*held, strict=True)])


def part_bits_for(n: int, cut: list[tuple[int, int, int]]) -> int:
    """Bits that deal ``n`` fingerprints into parts of about PART, in every segment alike."""
    return min(max(LEAST_PART_BITS, (max(1, n) // PART).bit_length()), min(width for _, width, _ in cut) - 1)


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, part_bits: int | None = None) -> DataFrame:
    """Links (a, b) that connect every two of the distinct fingerprints ``fp`` within ``radius`` bits."""
    cut = _segments(segments, radius)
    part_bits = part_bits_for(distinct.count(), cut) if part_bits is None else part_bits
    stored, asking = [], []
    for i, (shift, width, ball) in enumerate(cut):
        part = F.shiftrightunsigned("fp", shift + width - part_bits).bitwiseAND((1 << part_bits) - 1)
        at = lambda p, i=i: F.struct(F.lit(i).alias("seg"), p.cast("int").alias("part"))
        stored.append(at(part))
        asking += [at(part.bitwiseXOR(m)) for m in _ball(part_bits, ball)]
    listed = lambda xs: distinct.select("fp", F.explode(F.array(*xs)).alias("_at")).select("fp", "_at.seg", "_at.part")
    stored, asking = listed(stored), listed(asking)
    count = lambda df, name: df.groupBy("seg", "part").agg(F.count(F.lit(1)).alias(name))
    size = materialize(  # a row a part
        count(stored, "s").join(count(asking, "a"), ["seg", "part"])
        .select("seg", "part", (F.col("s") / STORED_BLOCK).cast("int").alias("ms"), (F.col("a") / ASKING_BLOCK).cast("int").alias("ma")),
        "parts",
    )
    mine = lambda most: F.pmod(F.xxhash64("fp"), F.col(most) + 1).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most)))
    rows = (
        stored.join(size, ["seg", "part"]).select("seg", "part", mine("ms").alias("bs"), every("ma").alias("ba"), F.lit(0).alias("asks"), "fp")
        .unionByName(asking.join(size, ["seg", "part"]).select("seg", "part", every("ms").alias("bs"), mine("ma").alias("ba"), F.lit(1).alias("asks"), "fp"))
    )
    order = ("seg", "part", "bs", "ba")
    rows = rows.repartition(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(lambda batches: _links(batches, cut, part_bits, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, _k1, _k2, fp, root, component_id) for each row of ``docs``.

    component_id: the smallest doc_id reachable over links of ``radius`` bits or fewer,
    the row's own included (null only if all are null); root: a fingerprint that stands
    for the component.  Texts of no words (null, empty) have fingerprint 0 and link like
    any other.  Copies and repeated rows share a fingerprint; an empty table gives none;
    columns but doc_id and text are left out.
    """
    each = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = materialize(links(distinct, radius, segments), "links")
    root = components(edges)
    # A table of fingerprints, each once: root and least document of its component.
    placed = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialize(placed.select("fp", "root", "least"), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(placed.select("fp", "root").join(least, "root"), "fp").select("doc_id", "_k1", "_k2", "fp", "root", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id's (nulls last), and of its repeated rows one.

    Null and empty texts are one component; columns are kept whatever their names; an empty
    table gives none.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    chosen = near_duplicates(docs, **options).groupBy("root").agg(F.min(row).alias("r")).select("r._k1", "r._k2")
    keyed = docs.select(whole_row(docs), *row_key(docs)).join(chosen, ["_k1", "_k2"], "left_semi")
    return keyed.dropDuplicates(["_k1", "_k2"]).select("row.*")


def hexed(fp) -> Column:
    """16 lowercase hexadecimal digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
