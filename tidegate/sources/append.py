"""Appending: requests become rows, stamped with key and lane."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions import scalars
from tidegate.model import CONCURRENT, DEFAULTS, Settings, at, conform

REQUEST = T.StructType([
    T.StructField("aggregate_type", T.StringType(), False), T.StructField("aggregate_id", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False), T.StructField("destination", T.StringType(), False),
    T.StructField("payload", T.StringType(), False), T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("client_profile", T.StringType()), T.StructField("release_at", T.TimestampType()), T.StructField("reference", T.StringType()),
])


def appended(requests: DataFrame, now: datetime | Column, first_id: Column, token: Column | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Outbox rows of append requests: due now, no attempts; lane and key by destination.

    first_id: an expression that gives each request its id, e.g. a sequence's base plus a
    row number.  token: part of the idempotency key (default: a random UUID, so make the
    rows durable before using them twice).
    """
    lane = scalars.lane_of(F.col("destination"), settings)
    key = scalars.key_of(F.col("destination"), F.col("aggregate_id"), settings)
    none = lambda kind: F.lit(None).cast(kind)
    return conform(requests.select(
        first_id.alias("id"), "aggregate_type", "aggregate_id", "event_type", "destination", "client_profile", "payload",
        F.when(F.col("headers").isNotNull(), F.to_json("headers")).alias("headers"),
        at(now).alias("created_on"), F.lit(0).cast("short").alias("attempts"), at(now).alias("next_attempt_on"),
        none("timestamp").alias("relayed_on"), none("string").alias("last_error"), "release_at",
        none("timestamp").alias("cancelled_on"), none("timestamp").alias("parked_on"), "reference",
        none("timestamp").alias("claimed_until"), lane.alias("lane"),
        F.when(lane == CONCURRENT, key).alias("ordering_key"), none("timestamp").alias("sending_since"),
        (F.expr("uuid()") if token is None else token).alias("key_token"),
    ))
