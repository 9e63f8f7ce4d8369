"""A deterministic outbox and delivery log derived from the ``events`` table (FIXTURES.md, part B)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.model import conform

NOW = datetime(2024, 1, 20)
_TEXTS = ("java.io.IOException: refused", "org.example.client.HttpError$ServiceUnavailable: 503", "receiver said no", "TimeoutException", "a.b.: broken", "Ann Smith: hello")



def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox as of NOW.  Rules are column expressions of event_id alone, so files are scanned once, by column."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e = F.col("event_id")
    http, done = e % 10 < 4, e % 5 < 3
    after = lambda s: F.timestamp_micros(F.unix_micros("ts") + s.cast("long") * 1_000_000)
    url = F.concat(F.lit("https://hub/"), F.col("user_id"))
    destination = F.when(http, url).otherwise(F.concat(F.lit("topic-"), F.col("event_type")))
    claimed = F.when((e % 13 == 0) & ~done, F.timestamp_micros(F.unix_micros(F.lit(NOW)) + (e % 7 - 3) * 60_000_000))
    errors = F.array(*[F.lit(t) for t in _TEXTS])
    md5 = F.md5(e.cast("string"))
    token = F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 4), F.substring(md5, 21, 12))
    return conform(events.select(
        (e + 1).alias("id"), F.lit("user").alias("aggregate_type"), F.col("user_id").cast("string").alias("aggregate_id"), "event_type",
        destination.alias("destination"),
        F.when(http & (e % 19 == 0), F.concat(F.lit("profile-"), e % 3)).alias("client_profile"),
        F.col("props").alias("payload"),
        F.when(e % 6 == 1, F.concat(F.lit('{"TraceParent":"00-'), e, F.lit('","x-kind":"a"}'))).alias("headers"),
        F.col("ts").alias("created_on"), (e % 4).cast("short").alias("attempts"), after(e % 3600).alias("next_attempt_on"),
        F.when(done, after(e % 120)).alias("relayed_on"),
        F.when(e % 4 > 0, F.element_at(errors, (e % 6 + 1).cast("int"))).alias("last_error"),
        F.when(e % 11 == 0, after(F.lit(86400))).alias("release_at"),
        F.when((e % 23 == 0) | (e % 39 == 13), after(F.lit(60))).alias("cancelled_on"),
        F.when((e % 17 == 0) & ~done, after(F.lit(3600))).alias("parked_on"),
        F.when(e % 7 < 3, F.concat(F.lit("sub-"), e % 7)).alias("reference"),
        claimed.alias("claimed_until"),
        F.when(e % 7 != 0, F.when(http, "CONCURRENT").otherwise("ORDERED")).alias("lane"),
        F.when((e % 7 != 0) & http & (e % 3 != 0), url).alias("ordering_key"),
        F.when(e % 2 == 0, F.timestamp_micros(F.unix_micros(claimed) - 60_000_000)).alias("sending_since"),
        F.when(e % 4 != 0, token).alias("key_token"),
    ))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery log of relayed and retried rows: three pods, a second delivery of every 29th row."""
    rows = outbox(spark, sf_dir).withColumn("e", F.col("id") - 1)
    e = F.col("e")
    second = rows.where(e % 29 == 0).withColumn("again", F.lit(1))
    both = rows.where((e % 5 < 3) | (e % 10 == 7)).withColumn("again", F.lit(0)).unionByName(second)
    # Every 37th row waits for three days; a 29th row's first send still runs when its second begins.
    begin = F.unix_micros("created_on") + (e % 120) * 500_000 + F.col("again") * 30_000_000 + F.when(e % 37 == 0, 3 * 86_400_000_000).otherwise(0)
    longer = F.when(e % 31 == 0, 180_000_000).otherwise(0) + F.when((e % 29 == 0) & (F.col("again") == 0), 45_000_000).otherwise(0)
    outcomes = F.array(*[F.lit(x) for x in ("OK", "OK", "OK", "HANG", "HOLD", "OK", "DEAF", "FAIL", "OK", "TERMINAL")])
    return both.select(
        F.col("id").alias("row_id"), "destination", "ordering_key", F.coalesce("lane", F.lit("ORDERED")).alias("lane"),
        F.concat(F.lit("pod-"), e % 3).alias("pod"), (1 + e % 2 + F.col("again")).cast("int").alias("attempt"),
        F.timestamp_micros(begin).alias("start"), F.timestamp_micros(begin + e * 7919 % 4000 * 1000 + longer).alias("end"),
        F.element_at(outcomes, (e % 10 + 1).cast("int")).alias("outcome"), (e % 50 == 0).alias("interrupted"),
    )


def pods(spark: SparkSession) -> DataFrame:
    """(pod, started, stopped, slots, killed): pod-2 was killed on the 15th."""
    day = lambda d: datetime(2024, 1, d)
    data = [("pod-0", day(1), None, 2, False), ("pod-1", day(1), None, 1, False), ("pod-2", day(2), day(15), 2, True)]
    return spark.createDataFrame(data, "pod string, started timestamp, stopped timestamp, slots int, killed boolean")


def outages(spark: SparkSession) -> DataFrame:
    """(lo, hi) of database outages."""
    data = [(datetime(2024, 1, 3), datetime(2024, 1, 3, 6)), (datetime(2024, 1, 10, 12), datetime(2024, 1, 10, 13))]
    return spark.createDataFrame(data, "lo timestamp, hi timestamp")


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery log that has lost every delivery of each 97th row."""
    return deliveries(spark, sf_dir).where(F.col("row_id") % 97 != 0)
