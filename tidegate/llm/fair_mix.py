"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Each source is a queue of its documents in hash order.  A document's virtual finish time
is the words of its source up to its end, divided by the source's target.  All queues are
merged in order of finish time and cut where the words served reach the total budget.  A
source whose target exceeds its size is queued again, in another order, up to three times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import materialize, n_words, null_coded, row_key, whole_row

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: A unit of virtual time is cut into at least so many slices, and into more as rows grow: only the slice in which the budget ends is sorted in full.
SLICES, SLICE_ROWS = 4096, 25_000


def source_targets(slim: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """(source key, source_size, target) for rows (_source, _label, size).

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a
    target stops at ``passes`` times its source's size and the excess is shared again by
    weight.  That fixed point is min(cap, level * weight); the level follows from the
    sources sorted by cap / weight.
    """
    per = slim.groupBy("_source").agg(F.sum("size").alias("source_size"), F.first("_label").alias("_label"))
    order = Window.orderBy(F.col("_label").asc_nulls_last())  # one row a source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("_cap", (F.col("source_size") * passes).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", F.col("_label").asc_nulls_last())
    per = (
        per.withColumn("_total", F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_rest"))
        .withColumn("_fits", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
    )
    level = F.first("_fits", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("_source", "source_size", F.least("_cap", F.coalesce(level, F.col("_ratio")) * F.col("_w")).alias("target"))


def fair_schedule(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    passes: int = MAX_PASSES,
    seed: int = 20240229,
    rows_per_task: int = 100_000,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, _k1, _k2 (hashes of the whole row), size, source_size, target, copies.

    copies: how many times the mix takes the document, 0 to ``passes``.  Sizes are words
    (null and empty texts: 0, never served but reported).  Null doc_ids and sources are
    values like others.  The order hashes the row's columns, so reruns agree; rows equal
    in all columns stand side by side.  Empty tables give empty results.  Every running
    sum is taken in slices of a queue, with the sums of the slices before it added, so no
    task holds a source.
    """
    slim = materialize(
        docs.select(docs["doc_id"], docs["source"].alias("_label"), null_coded(docs["source"]).alias("_source"), n_words(docs["text"]).alias("size"), *row_key(docs))
        .withColumn("_row", F.monotonically_increasing_id()),
        "mix",
    )
    targets = materialize(source_targets(slim, weights, passes), "mix-targets")
    n_rows = slim.count()
    n_slices = 16 + n_rows // rows_per_task * 2
    # A source's documents finish evenly over its time, so a slice has its part of all rows.
    moments = max(SLICES, passes * n_rows // SLICE_ROWS)
    # Copies beyond what the target can take by one pass are not queued.
    served = F.when(F.col("target") > 0, F.least(F.lit(passes), F.ceil(F.col("target") / F.col("source_size")) + F.lit(1))).otherwise(F.lit(1))
    queue = (
        slim.select("_row", "_k1", "_k2", "size", "_source")
        .join(targets, "_source")
        .withColumn("_pass", F.explode(F.sequence(F.lit(0), served.cast("int") - 1)))
        .withColumn("_order", F.xxhash64("_k1", "_k2", "_pass", F.lit(seed)))
        .withColumn("_slice", F.floor(F.shiftrightunsigned("_order", 33) * F.lit(n_slices) / F.lit(2.0**31)).cast("int"))
    )
    sums = queue.groupBy("_source", "_pass", "_slice").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("_source", "_pass").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "_pass", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_pass", "_slice").orderBy("_order", "_k1", "_k2", "_row").rowsBetween(Window.unboundedPreceding, 0)
    timed = (
        queue.withColumn("_upto", F.sum("size").over(inside))
        .join(sums, ["_source", "_pass", "_slice"])
        .withColumn("_finish", F.when(F.col("target") > 0, (F.col("_pass") * F.col("source_size") + F.col("_before") + F.col("_upto")) / F.col("target")).otherwise(F.lit(float(passes + 1))))
        .select("_row", "size", "_source", "_pass", "_order", "_k1", "_k2", "_finish", F.floor(F.least(F.col("_finish"), F.lit(1e6)) * F.lit(float(moments))).cast("long").alias("_at"))
    )
    timed = materialize(timed, "mix-times")
    budget = F.lit(targets.agg(F.sum("source_size")).first()[0] or 0)  # one number
    upto = (
        timed.groupBy("_at").agg(F.sum("size").alias("_n"))  # one row a slice of time
        .withColumn("_end", F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
        .select("_at", (F.col("_end") - F.col("_n")).alias("_start"), "_end")
        .where(F.col("_start") < budget)
    )
    placed = timed.join(upto, "_at")
    whole = placed.where(F.col("_end") <= budget).select("_row")
    last = Window.partitionBy("_at").orderBy("_finish", "_source", "_pass", "_order", "_k1", "_k2", "_row").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        placed.where(F.col("_end") > budget)
        .withColumn("_upto", F.col("_start") + F.sum("size").over(last))
        .where(F.col("_upto") <= budget)
        .select("_row")
    )
    taken = whole.unionByName(edge).groupBy("_row").agg(F.count(F.lit(1)).alias("copies"))
    return (
        slim.join(targets, "_source").join(taken, "_row", "left")
        .select("doc_id", "_k1", "_k2", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))
    )


def fair_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as :func:`fair_schedule` takes it, columns unchanged.

    Rows equal in all columns are one row taken as often as all of them together.  Rows of
    no words are left out: the mix takes none of theirs.
    """
    taken = fair_schedule(docs, **options).groupBy("_k1", "_k2").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    keyed = docs.select(whole_row(docs), *row_key(docs)).dropDuplicates(["_k1", "_k2"])
    out = keyed.join(taken, ["_k1", "_k2"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select("row.*")
