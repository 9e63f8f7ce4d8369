"""Gauges and counters.  Each gauge query is one scan and one aggregate: one snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.model import REACHED, at
from tidegate.operators import states


def gauges(rows: DataFrame, now: datetime) -> DataFrame:
    """(lane, open, parked, pending, oldest_open_since, in_flight, relay_lag_s), a row for either lane.

    Relay lag is the age of the oldest row neither relayed nor cancelled, parked ones
    included, from its release where it is held; 0 if there is none.
    """
    since = F.greatest("created_on", F.coalesce("release_at", "created_on"))
    lanes = rows.sparkSession.createDataFrame([("concurrent",), ("ordered",)], "lane string")
    found = (
        rows.where(states.pending())
        .groupBy(states.lane_name().alias("lane"))
        .agg(
            F.count_if(states.open_()).alias("open"),
            F.count_if(states.parked_counted()).alias("parked"),
            F.count(F.lit(1)).alias("pending"),
            F.min(since).alias("oldest_open_since"),
            F.count_if(states.leased_counted(now)).alias("in_flight"),
        )
    )
    lag = (F.unix_micros(at(now)) - F.unix_micros("oldest_open_since")) / F.lit(1e6)
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("open", "parked", "pending", "in_flight")}
    return lanes.join(found, "lane", "left").select(
        "lane", zero["open"], zero["parked"], zero["pending"], "oldest_open_since", zero["in_flight"],
        F.greatest(F.lit(0.0), F.coalesce(lag, F.lit(0.0))).alias("relay_lag_s"),
    )


def any_reached(deliveries: DataFrame) -> DataFrame:
    """(row_id, n, reached): deliveries of a row, and whether one reached its receiver."""
    ok = F.col("outcome").isin(*REACHED) & ~F.col("interrupted")
    return deliveries.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("reached"))


def relayed_counters(rows: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(destination, relayed, dropped): relayed rows, those whose every send failed counted as dropped."""
    sent = any_reached(deliveries).withColumnRenamed("row_id", "id")
    joined = rows.where(states.relayed()).select("id", "destination").join(sent, "id", "left")
    dropped = F.coalesce((F.col("n") > 0) & (F.col("reached") == 0), F.lit(False))
    return joined.groupBy("destination").agg(F.count_if(~dropped).alias("relayed"), F.count_if(dropped).alias("dropped"))


def attempts_summary(rows: DataFrame) -> DataFrame:
    """(n, total, most, median) of the attempts relayed rows took, the last one included."""
    tries = F.col("attempts").cast("long") + 1
    return rows.where(states.relayed()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(tries).alias("total"), F.max(tries).alias("most"), F.percentile(tries, F.lit(0.5)).alias("median")
    )


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def metrics_age_s(last_success: datetime | None, now: datetime) -> float:
    return float("nan") if last_success is None else max(0.0, (now - last_success).total_seconds())


_SHOWN = ("open", "parked", "pending", "in_flight", "relay_lag_s")


@dataclass
class GaugeSnapshot:
    """The gauges as last read: all of one instant, or all NaN after a read that failed.

    ``read`` gives the table.  ``values`` has lane.gauge names; before a first read none is known.
    """

    read: Callable[[], DataFrame]
    values: dict[str, float] = field(default_factory=lambda: {f"{lane}.{g}": float("nan") for lane in ("concurrent", "ordered") for g in _SHOWN})
    last_success: datetime | None = None

    def refresh(self, now: datetime) -> bool:
        """Reads anew and swaps all values at once; says whether that succeeded."""
        try:
            rows = gauges(self.read(), now).collect()
        except Exception:  # whatever a read raises, its gauges are unknown
            self.values = dict.fromkeys(self.values, float("nan"))
            return False
        self.values, self.last_success = {f"{r['lane']}.{g}": float(r[g]) for r in rows for g in _SHOWN}, now
        return True

    def age_s(self, now: datetime) -> float:
        return metrics_age_s(self.last_success, now)
