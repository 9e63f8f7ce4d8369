"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in built-in expressions.

No ring table: a key and the number of shards decide the shard.  When one shard is
appended, a key keeps its shard or moves to the new one, and 1/(n+1) of the keys move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import materialize, text_or_empty

# Fixed values of the published generator: state = state * 2862933555777941757 + 1 (mod 2^64).
_MULT_HI = 2862933555777941757 >> 32
_MULT_LO = 2862933555777941757 & 0xFFFFFFFF
_MASK = 0xFFFFFFFF
#: A key jumps 1 + ln(n) times on average; past this many steps a row raises an error.
MAX_JUMPS = 160


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the generator on a state held as two unsigned 32-bit halves.

    Every partial product stays below 2^63, so it is right with ANSI arithmetic too.
    """
    t0 = lo.bitwiseAND(0xFFFF) * F.lit(_MULT_LO)
    t1 = F.shiftright(lo, 16) * F.lit(_MULT_LO)
    s = t0 + F.shiftleft(t1.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(s, 32) + F.shiftright(t1, 16)
    cross = (lo * F.lit(_MULT_HI)).bitwiseAND(_MASK)
    own = (hi.bitwiseAND(0xFFFF) * F.lit(_MULT_LO)).bitwiseAND(_MASK)
    top = F.shiftleft((F.shiftright(hi, 16) * F.lit(_MULT_LO)).bitwiseAND(0xFFFF), 16)
    return (carry + cross + own + top).bitwiseAND(_MASK), s.bitwiseAND(_MASK)


def jump_shard(key: Column, n_shards: int) -> Column:
    """Shard (int, 0 to n_shards - 1) of a 64-bit integer key."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = key.cast("long")
    start = F.struct(
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(_MASK).alias("lo"),
    )

    def step(acc: Column, _: Column) -> Column:
        hi, lo = _next(acc["hi"], acc["lo"])
        jump = F.floor((acc["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        ahead = F.struct(acc["j"].alias("b"), jump.cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(acc["j"] >= n_shards, acc).otherwise(ahead)

    steps = F.array(*[F.lit(0)] * min(n_shards, MAX_JUMPS))
    done = lambda acc: F.when(acc["j"] >= n_shards, acc["b"]).otherwise(
        F.raise_error(F.lit("a key needs more jumps than MAX_JUMPS")).cast("long")
    )
    return F.aggregate(steps, start, step, done).cast("int")


def assign_shards(
    docs: DataFrame,
    n_shards: int,
    key: Column | None = None,
    size: Column | None = None,
    rows_per_task: int = 250_000,
) -> DataFrame:
    """``docs``' keys with ``shard``, ``grown_shard`` (with one shard more), ``slot``, ``size``, ``text_crc32``.

    key: what alone decides the shard (default: a hash of ``doc_id``; null is a key like
    any other).  slot: gapless from 0 in each shard.  A shard is numbered in hash buckets
    of about ``rows_per_task`` rows, each starting where the one before ends, so that no
    task holds a whole shard; rows of one repeated key are dealt over buckets by the input
    partition they were read in.  Empty tables give empty results; extra columns are left
    out.
    """
    text = text_or_empty(docs["text"])
    key = F.xxhash64(docs["doc_id"]) if key is None else key
    size = F.octet_length(text).cast("long") + 8 if size is None else size
    slim = docs.select(
        docs["doc_id"].alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("_key"),
        F.spark_partition_id().alias("_part"),
    ).select(
        "*",
        jump_shard(F.col("_key"), n_shards).alias("shard"),
        jump_shard(F.col("_key"), n_shards + 1).alias("grown_shard"),
    )
    slim = materialize(slim, "shards")
    buckets = 1 + slim.count() // (rows_per_task * n_shards) * 2
    slim = slim.withColumn("_bucket", F.pmod(F.xxhash64("_key", "_part"), F.lit(buckets + 15)).cast("int"))
    before = (
        slim.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "shard", "_bucket",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_before"),
        )
    )
    within = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size"))
    return (
        slim.withColumn("_rank", within.cast("long"))
        .join(before, ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_rank") - 1).alias("slot"), "grown_shard")
    )
