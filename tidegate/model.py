"""The event-queue table: schema, defaults and the instant a batch works with.

A row has no status column.  Its state follows from timestamps and the instant ``now`` that
every operator takes, so one batch sees one instant (see :mod:`tidegate.operators.states`).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED, CONCURRENT = "ORDERED", "CONCURRENT"

_S, _TS, _L = T.StringType(), T.TimestampType(), T.LongType()
OUTBOX = T.StructType([
    T.StructField("id", _L, False),
    T.StructField("aggregate_type", _S, False), T.StructField("aggregate_id", _S, False),
    T.StructField("event_type", _S, False), T.StructField("destination", _S, False),
    T.StructField("client_profile", _S), T.StructField("payload", _S, False), T.StructField("headers", _S),
    T.StructField("created_on", _TS, False), T.StructField("attempts", T.ShortType(), False),
    T.StructField("next_attempt_on", _TS, False), T.StructField("relayed_on", _TS), T.StructField("last_error", _S),
    T.StructField("release_at", _TS), T.StructField("cancelled_on", _TS), T.StructField("parked_on", _TS),
    T.StructField("reference", _S), T.StructField("claimed_until", _TS), T.StructField("lane", _S),
    T.StructField("ordering_key", _S), T.StructField("sending_since", _TS), T.StructField("key_token", _S),
])

DELIVERY = T.StructType([
    T.StructField("row_id", _L), T.StructField("destination", _S), T.StructField("ordering_key", _S), T.StructField("lane", _S),
    T.StructField("pod", _S), T.StructField("attempt", T.IntegerType()), T.StructField("start", _TS), T.StructField("end", _TS),
    T.StructField("outcome", _S), T.StructField("interrupted", T.BooleanType()),
])

#: Outcomes that reached the receiver, unless the send was interrupted.
REACHED = ("OK", "HANG", "HOLD", "DEAF")


@dataclass(frozen=True)
class Settings:
    """Settings that change results, with their defaults."""

    service: str = "service"
    sweep: timedelta = timedelta(seconds=5)
    batch: int = 100
    max_attempts: int = 10
    backoff_base: timedelta = timedelta(seconds=5)
    backoff_factor: float = 2.0
    backoff_cap: timedelta = timedelta(minutes=10)
    retention: timedelta = timedelta(days=7)
    send_timeout: timedelta = timedelta(seconds=10)
    lease: timedelta = timedelta(minutes=2)
    ordered_lease: timedelta = timedelta(seconds=15)
    kafka_lease: timedelta = timedelta(seconds=15)
    kafka_lane: str = ORDERED
    kafka_key: str = "AGGREGATE_ID"
    max_in_flight: int = 8
    pause_after: int = 5
    pause_first: timedelta = timedelta(seconds=5)
    pause_max: timedelta = timedelta(minutes=1)
    maintenance_batch: int = 5000
    maintenance_budget: timedelta = timedelta(seconds=10)
    metrics_refresh: timedelta = timedelta(seconds=15)
    exhausted: str = "PARK"

    def __post_init__(self) -> None:
        for name in ("ordered_lease", "kafka_lease"):
            if getattr(self, name) <= self.send_timeout:
                raise ValueError(f"{name} must exceed send_timeout")
        if self.batch < 1 or self.max_in_flight < 1 or self.maintenance_batch < 1:
            raise ValueError("batch sizes must be positive")


DEFAULTS = Settings()


def at(now: datetime | Column) -> Column:
    """The batch's instant as a literal, so that it folds into pushed filters."""
    return now if isinstance(now, Column) else F.lit(now)


def seconds(d: timedelta) -> Column:
    return F.make_dt_interval(secs=F.lit(d / timedelta(seconds=1)))


def conform(df: DataFrame) -> DataFrame:
    """Columns of the table in order and type; raises where a required column is missing."""
    missing = [f.name for f in OUTBOX.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"not an outbox table, missing: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OUTBOX.fields])
