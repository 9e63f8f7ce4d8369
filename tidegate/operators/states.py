"""Row states as predicates.

Several sound alike and differ on purpose: the parked list has no test for relayed, the
view's in-flight flag no test for cancelled, and lists and gauges differ in both.
Each ``IS NULL`` stands alone so that it reaches the parquet scan as a pushed filter.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.model import CONCURRENT, at


def _null(*names: str) -> Column:
    out = F.col(names[0]).isNull()
    for n in names[1:]:
        out = out & F.col(n).isNull()
    return out


def pending() -> Column:
    """Neither relayed nor cancelled: parked, held and leased rows are pending too."""
    return _null("relayed_on", "cancelled_on")


def parked_listed() -> Column:
    return F.col("parked_on").isNotNull() & F.col("cancelled_on").isNull()


def relayed() -> Column:
    """Delivered and dropped rows alike."""
    return F.col("relayed_on").isNotNull()


def cancelled() -> Column:
    return F.col("cancelled_on").isNotNull()


LISTS = {"pending": pending, "parked": parked_listed, "relayed": relayed, "cancelled": cancelled}


def parked_counted() -> Column:
    return F.col("parked_on").isNotNull() & pending()


def open_() -> Column:
    """What a claim may take at all."""
    return _null("relayed_on", "cancelled_on", "parked_on")


def held(now: datetime | Column) -> Column:
    return pending() & (F.col("release_at") > at(now))


def leased(now: datetime | Column) -> Column:
    """In flight as the row view and the key rule see it: a cancelled row under a live lease is."""
    return F.col("relayed_on").isNull() & (F.col("claimed_until") > at(now))


def leased_counted(now: datetime | Column) -> Column:
    """In flight as the gauge counts it: cancelled rows are not."""
    return leased(now) & F.col("cancelled_on").isNull()


def due(now: datetime | Column) -> Column:
    now = at(now)
    return (
        open_()
        & (F.col("next_attempt_on") <= now)
        & (F.col("release_at").isNull() | (F.col("release_at") <= now))
        & (F.col("claimed_until").isNull() | (F.col("claimed_until") <= now))
    )


def concurrent() -> Column:
    return F.col("lane").eqNullSafe(CONCURRENT)


def ordered() -> Column:
    """Every other lane value, null included."""
    return ~concurrent()


def keyed() -> Column:
    return concurrent() & F.col("ordering_key").isNotNull()


def unkeyed() -> Column:
    return concurrent() & F.col("ordering_key").isNull()


def sent_but_cancelled() -> Column:
    return F.col("relayed_on").isNotNull() & F.col("cancelled_on").isNotNull()


def lane_name() -> Column:
    return F.when(concurrent(), F.lit("concurrent")).otherwise(F.lit("ordered"))
