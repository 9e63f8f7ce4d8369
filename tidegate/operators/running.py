"""Running maxima and sums, and as-of lookups, that no single task carries alone.

A window partitioned by a pod or a lane would put a third of a log into one task.  Here a
rows are cut by their order into slices of about SLICE_ROWS rows, whatever their number: a
window runs inside each slice, and what the slices before it add is a second window over
one row a slice.  The results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.plans.tables import settled

HOUR_US = 3_600_000_000
SLICE_ROWS = 100_000


def sliced(df: DataFrame, *order: Column | str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df``, computed once, with ``_slice``: ranges of ``order``, about equal in rows; rows equal in it share one."""
    df = settled(df)
    slices = 1 + df.count() // slice_rows
    if slices == 1:
        return df.withColumn("_slice", F.lit(0))
    return settled(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str, combine, fold, through: bool, slice_rows: int) -> DataFrame:
    df = sliced(df.withColumn("_value", value), *order, slice_rows=slice_rows)
    own = [*keys, "_slice"]
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*own).agg(fold("_value").alias("_v")).withColumn("_before", fold("_v").over(before)).drop("_v")
    run = df.withColumn("_inside", fold("_value").over(inside))
    cond = None
    for k in own:
        c = run[k].eqNullSafe(sums[k])
        cond = c if cond is None else cond & c
    joined = run.join(sums, cond)
    return joined.select(*[run[c] for c in run.columns if c not in ("_slice", "_value", "_inside")], combine(F.col("_inside"), F.col("_before")).alias(out))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str, through: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``out``: the greatest ``value`` of the rows before (or up to) each row of its keys; null if there is none.

    With a struct that begins with the order columns it is the row just before: a lag.
    """
    return _running(df, keys, order, value, out, _later, F.max, through, slice_rows)


def _later(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).when(a >= b, a).otherwise(b)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str, through: bool = True, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``out``: the sum of ``value`` over the rows up to (or before) each row of its keys; without keys, of all rows."""
    return _running(df, keys, order, value, out, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.sum, through, slice_rows)


def inside_any(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, flag: str, width_us: int = HOUR_US, slack_us: int = 0) -> DataFrame:
    """``points`` with ``flag``: whether ``at`` lies in an interval [lo - slack, hi + slack].

    A range join as an equi-join: an interval is listed in each time bucket that it
    touches; overlapping intervals of a bucket are one row, so no point is repeated.
    """
    bucket = lambda us: F.floor(us / F.lit(width_us)).cast("long")
    ends = intervals.select((F.unix_micros(lo) - slack_us).alias("_lo"), (F.unix_micros(hi) + slack_us).alias("_hi"))
    listed = ends.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))))
    listed = listed.groupBy("_bucket").agg(F.collect_list(F.struct("_lo", "_hi")).alias("_near"))
    us = F.unix_micros(at)
    joined = points.withColumn("_bucket", bucket(us)).join(listed, "_bucket", "left")
    hit = F.coalesce(F.exists("_near", lambda i: (us >= i["_lo"]) & (us <= i["_hi"])), F.lit(False))
    return joined.withColumn(flag, hit).drop("_bucket", "_near")


def islands(intervals: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(keys, lo, hi) in microseconds: unions of overlapping or touching intervals of each key.

    An interval opens a union if it begins after all earlier ends; unions are numbered by
    a running sum of openings.
    """
    marked = running_max(intervals.select(*keys, lo, hi), keys, [lo, hi], F.col(hi), "_upto", slice_rows=slice_rows)
    opens = F.when(F.col("_upto").isNull() | (F.col(lo) > F.col("_upto")), 1).otherwise(0).cast("long")
    numbered = running_sum(marked, keys, [lo, hi], opens, "_island", slice_rows=slice_rows)
    return numbered.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")
