"""A Merkle manifest of a table, by Pregel-like supersteps over RDDs.

Rows are leaves; leaves of a source ascend by their key, and every FANOUT consecutive nodes
become one digest until one node is left, the source's subroot.  Subroots in the order of
their sources make another such tree, whose top is the root.

Upwards, each superstep sends a node's digest to its parent; a parent whose children have
all come hashes them and is a node of the next superstep.  A vertex is a parent with its
children's digests, so nothing grows with a source: a source of a third of all rows has as
many more vertices.  Downwards, each superstep sends a vertex the siblings along its path,
once for all its children; the last one reaches the leaves, which then prove themselves.
Every superstep's vertices are a table in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import materialize, quoted

#: Children of a node.
FANOUT = 16
#: Hex digits of a digest.
HEX = 64
_VERTEX = "r long, p long, last boolean, digest string, kids string"


def digest(*values: Column) -> Column:
    """Hex SHA-256 of values, each told apart: ``-`` for null, else UTF-8 byte count, colon, value."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _cut(kids: str) -> list[str]:
    return [kids[i : i + HEX] for i in range(0, len(kids), HEX)]


def _complete(p: int, kids: list[str]) -> tuple[str, str]:
    """(digest, children) of a parent; a source's only leaf is its own digest."""
    joined = "".join(kids)
    return (joined if p == 0 and len(kids) == 1 else _hash(joined)), joined


def _path(kids: list[str], j: int, above: str) -> str:
    """The path of child j: its place and siblings, then those of each node above."""
    here = f"{j:02x}" + "".join(kids[:j] + kids[j + 1 :])
    return f"{here},{above}" if above else here


def proof(path: str) -> str:
    """The digest of the siblings on a path."""
    return _hash("".join(step[2:] for step in path.split(",")) if path else "")


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and the siblings on its path give."""
    for step in path.split(",") if path else ():
        at = 2 + HEX * int(step[:2], 16)
        leaf = _hash(step[2:at] + leaf + step[at:])
    return leaf


@dataclass(frozen=True)
class Manifest:
    """Vertices by superstep, and the root (None for an empty table).

    runs: the parents of leaves, (r, p, last, digest, kids, keys, trials).  levels: the
    parents above, by superstep.  tops: (r, level, subroot) of each source.  sources:
    levels of the tree over subroots.
    """

    root: str | None
    runs: DataFrame
    levels: list[DataFrame]
    tops: DataFrame
    sources: list[DataFrame]


def _numbered(rows: RDD) -> tuple[RDD, int]:
    """Rows (source, ...) sorted by source as (r, i, last, row), and the number of sources.

    r numbers the sources, i the rows of one, last marks its last row.  The driver gets a
    few values for each partition.
    """

    def told(k: int, part: Iterable) -> Iterator:
        first = last = None
        n = n_last = sources = 0
        for n, row in enumerate(part, 1):
            if n == 1 or row[0] != last:
                sources, n_last, last = sources + 1, 0, row[0]
                first = last if n == 1 else first
            n_last += 1
        if n:
            yield k, first, last, sources, n_last

    begins, ends, r, run, before = {}, {}, -1, 0, None
    for k, first, last, sources, n_last in sorted(rows.mapPartitionsWithIndex(told).collect(), key=lambda x: x[0]):
        if r < 0 or first != before[0]:
            r, run = r + 1, 0
        else:
            ends[before[1]] = False  # the source goes on here
        begins[k] = (r, run)
        r, run, before = r + sources - 1, (n_last if sources > 1 else run + n_last), (last, k)

    def number(k: int, part: Iterable) -> Iterator:
        held = None
        r, i = begins.get(k, (0, 0))
        for row in part:
            if held is not None:
                same = row[0] == held[0]
                yield r, i, not same, held
                r, i = (r, i + 1) if same else (r + 1, 0)
            held = row
        if held is not None:
            yield r, i, ends.get(k, True), held

    return rows.mapPartitionsWithIndex(number), r + 1


def _parents(nodes: DataFrame, parts: int, fanout: int) -> DataFrame:
    """A superstep upwards: nodes (r, p, last, digest) as vertices of the next level."""

    def hashed(x: tuple) -> tuple:
        (r, p), got = x
        got = sorted(got)
        name, kids = _complete(p, [g[2] for g in got])
        return r, p, got[-1][1], name, kids

    sent = nodes.select("r", "p", "last", "digest").rdd.map(lambda x: ((x[0], x[1] // fanout), (x[1] % fanout, x[2], x[3])))
    up = sent.groupByKey(parts).map(hashed)
    return materialize(nodes.sparkSession.createDataFrame(up, _VERTEX, verifySchema=False), "merkle")


def _climb(nodes: DataFrame, parts: int, fanout: int) -> list[DataFrame]:
    """Vertices of all supersteps above ``nodes``, as long as a source has several nodes."""
    levels = []
    while not (open_ := nodes.where(~(F.col("last") & (F.col("p") == 0)))).isEmpty():
        parts = -(-parts // fanout)
        nodes = _parents(open_, parts, fanout)
        levels.append(nodes)
    return levels


def build(rows: DataFrame, source: str, key: str, leaf: Column, trial: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``rows``: leaves ``leaf`` (hex digests), by source and ascending key, nulls first.

    trial: another digest of the row, to be folded with the leaf's siblings (see
    :func:`proofs`).  Rows of one source and key follow by digest; rows equal in all are
    leaves each.  An empty table has no root.
    """
    spark = rows.sparkSession
    told = rows.select(rows[quoted(source)].cast("string").alias("source"), rows[quoted(key)].alias("key"), leaf.alias("leaf"), (leaf if trial is None else trial).alias("trial"))
    told = materialize(told.withColumn("uid", F.monotonically_increasing_id()), "leaves")
    by = [F.col(c).asc_nulls_first() for c in ("source", "key", "leaf", "uid")]
    ranged = told.repartitionByRange(*by).sortWithinPartitions(*by).select("source", "key", "leaf", "trial").rdd
    leaves, n_sources = _numbered(ranged.map(tuple))
    parts = max(1, ranged.getNumPartitions())

    def hashed(x: tuple) -> tuple:
        (r, p), got = x
        got = sorted(got, key=lambda g: g[0])
        name, kids = _complete(p, [g[2] for g in got])
        return r, p, got[-1][1], name, kids, [g[4] for g in got], "".join(g[3] for g in got)

    sent = leaves.map(lambda x: ((x[0], x[1] // fanout), (x[1] % fanout, x[2], x[3][2], x[3][3], x[3][1])))
    schema = T.StructType([*T.StructType.fromDDL(_VERTEX).fields, T.StructField("keys", T.ArrayType(told.schema["key"].dataType)), T.StructField("trials", T.StringType())])
    runs = materialize(spark.createDataFrame(sent.groupByKey(parts).map(hashed), schema, verifySchema=False), "merkle")
    levels = _climb(runs, parts, fanout)
    tops = None
    for k, vertices in enumerate([runs, *levels]):
        done = vertices.where("last AND p = 0").select("r", F.lit(k).alias("level"), F.col("digest").alias("subroot"))
        tops = done if tops is None else tops.unionByName(done)
    tops = materialize(tops, "subroots")
    roots = tops.select(F.lit(0).cast("long").alias("r"), F.col("r").alias("p"), (F.col("r") == n_sources - 1).alias("last"), F.col("subroot").alias("digest"))
    sources = _climb(roots, -(-n_sources // 10_000), fanout)
    top = (sources[-1] if sources else roots).where("last AND p = 0").select("digest").head()
    return Manifest(None if top is None else top[0], runs, levels, tops, sources)


def _told(messages: RDD, vertices: DataFrame, fields: Callable, parts: int) -> RDD:
    """(key, (message, fields of the vertex)) of the vertices that get a message."""
    return messages.join(vertices.rdd.map(lambda v: ((v["r"], v["p"]), fields(v))), parts)


def _down(messages: RDD, vertices: DataFrame, parts: int, fanout: int) -> RDD:
    """A superstep downwards: each vertex (subroot, path) tells every child its path."""

    def send(x: tuple) -> Iterator:
        (r, p), ((subroot, above), kids) = x
        cut = _cut(kids)
        for j, own in enumerate(cut):
            yield (r, p * fanout + j), (subroot or own, _path(cut, j, above))

    return _told(messages, vertices, lambda v: v["kids"], parts).flatMap(send)


_MESSAGE = "r long, p long, subroot string, path string"


def _kept(spark, messages: RDD) -> DataFrame:
    flat = messages.map(lambda m: (*m[0], *m[1]))
    return materialize(spark.createDataFrame(flat, _MESSAGE, verifySchema=False), "merkle")


def _read(messages: DataFrame) -> RDD:
    return messages.rdd.map(lambda m: ((m["r"], m["p"]), (m["subroot"], m["path"])))


def proofs(made: Manifest, fanout: int = FANOUT) -> DataFrame:
    """(key, leaf, subroot, root, path, proof_sha256, folded_root, verified) of every leaf.

    path: the place and siblings of each node from the leaf to the root.  folded_root is
    computed from the leaf's trial and those siblings; verified tells whether it is the root.
    """
    spark, root = made.runs.sparkSession, made.root
    key = made.runs.schema["keys"].dataType.elementType
    out = T.StructType([T.StructField("key", key), *T.StructType.fromDDL("leaf string, subroot string, root string, path string, proof_sha256 string, folded_root string, verified boolean").fields])
    if root is None:
        return spark.createDataFrame([], out)
    parts = max(1, made.runs.rdd.getNumPartitions())
    # Over the subroots: afterwards a message is keyed by (0, r).
    at = spark.sparkContext.parallelize([((0, 0), ("", ""))], 1)
    for vertices in reversed(made.sources):
        at = _read(_kept(spark, _down(at, vertices, max(1, vertices.rdd.getNumPartitions()), fanout).map(lambda m: (m[0], ("", m[1][1])))))
    told = at.map(lambda m: (m[0][1], m[1][1])).join(made.tops.rdd.map(lambda t: (t["r"], (t["level"], t["subroot"]))))
    flat = told.map(lambda x: (x[0], x[1][1][0], x[1][1][1], x[1][0]))
    begins = materialize(spark.createDataFrame(flat, "r long, level int, subroot string, path string", verifySchema=False), "merkle")

    def begun(level: int) -> RDD:
        return begins.where(F.col("level") == level).rdd.map(lambda b: ((b["r"], 0), (b["subroot"], b["path"])))

    at = begun(len(made.levels))
    for level in range(len(made.levels), 0, -1):
        at = _read(_kept(spark, _down(at, made.levels[level - 1], -(-parts // fanout**level), fanout))).union(begun(level - 1))

    def prove(x: tuple) -> Iterator:
        (_, p), ((subroot, above), (kids, keys, trials)) = x
        cut, tried = _cut(kids), _cut(trials)
        for j, own in enumerate(cut):
            path = above if p == 0 and len(cut) == 1 else _path(cut, j, above)
            got = folded(tried[j], path)
            yield keys[j], own, subroot, root, path, proof(path), got, got == root

    proven = _told(at, made.runs, lambda v: (v["kids"], v["keys"], v["trials"]), parts).flatMap(prove)
    return spark.createDataFrame(proven, out, verifySchema=False)


def check(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified) of documents.

    A leaf is the digest of doc_id, source, lang, n_chars and text.  Where five divides the
    CRC-32 of the doc_id, the text is tampered with (lower-cased) before the root is folded
    anew.  Null doc_ids come first and are not tampered with, null texts stay null; repeated
    rows are leaves each; an empty table gives none; other columns count for nothing.
    """
    value = lambda name: docs[quoted(name)]
    fields = [value(n) for n in ("doc_id", "source", "lang", "n_chars")]
    leaf = digest(*fields, value("text"))
    struck = F.coalesce(F.crc32(value("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    trial = F.when(struck, digest(*fields, lower_ascii(value("text").cast("string")))).otherwise(leaf)
    return proofs(build(docs, "source", "doc_id", leaf, trial)).withColumnRenamed("key", "doc_id")
