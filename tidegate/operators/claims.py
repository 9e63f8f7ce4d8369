"""Claims: which rows a pass takes next.

All are selections over a snapshot at one instant.  The concurrent claim has two limits:
heads are limited in key order and unkeyed rows in id order, and only then is their union
limited in id order.  One global sort would take other rows.

Scale: heads are a partial and final ``min`` by key over due rows (no window, no sort of the
backlog; the rows behind them are a window with a limit by key), limits are top-k operators, and keys in flight are excluded by an anti-join that
Spark broadcasts when the set is small and shuffles on the key when it is not.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.model import DEFAULTS, Settings, at, seconds
from tidegate.operators import states


def ordered_claim(rows: DataFrame, now: datetime, limit: int) -> DataFrame:
    """Due rows of the ordered lane, lowest ids first."""
    return rows.where(states.due(now) & states.ordered()).orderBy("id").limit(limit)


def keys_in_flight(rows: DataFrame, now: datetime) -> DataFrame:
    """Keys of leased rows, cancelled ones included: their sends may still be under way."""
    return rows.where(states.leased(now) & states.keyed()).select("ordering_key").distinct()


def open_keys(rows: DataFrame, after: str | None = None) -> DataFrame:
    """Each open key above a cursor with its lowest open id, in byte order of the key."""
    found = rows.where(states.open_() & states.keyed())
    if after is not None:
        found = found.where(F.col("ordering_key") > after)
    return found.groupBy("ordering_key").agg(F.min("id").alias("id")).orderBy("ordering_key")


def _key_range(after: str | None, until: str | None) -> Column:
    inside = F.lit(True)
    if after is not None:
        inside = inside & (F.col("ordering_key") > after)
    if until is not None:
        inside = inside & (F.col("ordering_key") <= until)
    return inside


def all_heads(rows: DataFrame, now: datetime, after: str | None = None, until: str | None = None) -> DataFrame:
    """(ordering_key, id): the lowest due id of every key with nothing in flight."""
    due = rows.where(states.due(now) & states.keyed() & _key_range(after, until))
    free = due.join(keys_in_flight(rows, now), "ordering_key", "left_anti")
    return free.groupBy("ordering_key").agg(F.min("id").alias("id"))


def heads(rows: DataFrame, now: datetime, limit: int, after: str | None = None, until: str | None = None) -> DataFrame:
    """At most ``limit`` heads, in key order."""
    return all_heads(rows, now, after, until).orderBy("ordering_key").limit(limit)


def unkeyed(rows: DataFrame, now: datetime, limit: int) -> DataFrame:
    return rows.where(states.due(now) & states.unkeyed()).select("ordering_key", "id").orderBy("id").limit(limit)


def concurrent_claim(rows: DataFrame, now: datetime, limit: int, after: str | None = None) -> DataFrame:
    """First pass: heads above the cursor and unkeyed rows, limited each, then together by id."""
    both = heads(rows, now, limit, after).unionByName(unkeyed(rows, now, limit))
    return _rows_of(rows, both.orderBy("id").limit(limit))


def wrap_claim(rows: DataFrame, now: datetime, limit: int, until: str) -> DataFrame:
    """Second pass: heads up to the old cursor, no unkeyed rows."""
    return _rows_of(rows, heads(rows, now, limit, None, until).orderBy("id").limit(limit))


def followers(rows: DataFrame, now: datetime, limit: int, depth: int) -> DataFrame:
    """Due rows behind the heads of keys with nothing in flight: at most ``depth`` of a key and ``limit`` in all, those next to their heads first.

    ``_rank`` counts from the head.  ``_again``: when a row of the key that isn't due yet
    will be, among those that ``rows`` has.  The rank is a limit by group, so a key sends
    that many rows of a task over the shuffle, whatever its backlog.
    """
    free = rows.where(states.due(now) & states.keyed()).join(keys_in_flight(rows, now), "ordering_key", "left_anti")
    rank = F.row_number().over(Window.partitionBy("ordering_key").orderBy("id")) - 1
    near = free.withColumn("_rank", rank).where((F.col("_rank") > 0) & (F.col("_rank") <= depth)).orderBy("_rank", "id").limit(limit)
    when = F.greatest("next_attempt_on", "release_at")
    soon = rows.where(states.open_() & states.keyed() & (when > at(now))).groupBy("ordering_key").agg(F.min(when).alias("_again"))
    return near.join(soon, "ordering_key", "left")


def _rows_of(rows: DataFrame, picked: DataFrame) -> DataFrame:
    return rows.join(picked.select("id"), "id", "left_semi")


def head_keys(rows: DataFrame, now: datetime, limit: int, after: str | None = None) -> DataFrame:
    """Keys a first pass would find: tells an exhausted key range from a short pass."""
    return heads(rows, now, limit, after).select("ordering_key")


def recheck(rows: DataFrame, candidates: DataFrame, now: datetime) -> DataFrame:
    """Candidates (id) that are still due heads: nothing of their key in flight, no lower due id of the key."""
    still = rows.where(states.due(now) & states.keyed()).join(candidates.select("id"), "id", "left_semi")
    return still.join(all_heads(rows, now).select("id"), "id", "left_semi")


def surviving(candidates: DataFrame, locked_keys: DataFrame, heads_now: DataFrame) -> DataFrame:
    """Unkeyed candidates pass; keyed ones if their key is locked by this pass and they are still heads."""
    free = candidates.where(F.col("ordering_key").isNull())
    kept = candidates.join(locked_keys.select("ordering_key"), "ordering_key", "left_semi").join(heads_now.select("id"), "id", "left_semi")
    return free.unionByName(kept.select(*candidates.columns))


def not_queued(candidates: DataFrame, queued: DataFrame) -> DataFrame:
    """Without rows this pod still holds in its queue."""
    return candidates.join(queued.select("id"), "id", "left_anti")


def lease_length(own_lease: Column | None = None, settings: Settings = DEFAULTS) -> Column:
    """The publisher's lease where it names one, else the lane's."""
    lane = F.when(states.concurrent(), seconds(settings.lease)).otherwise(seconds(settings.ordered_lease))
    return lane if own_lease is None else F.coalesce(own_lease, lane)


def lapsed() -> Column:
    """A lease and a send that began under it: the send's fate is unknown, so it counts as a failed attempt.

    Take it before :func:`stamp` clears it.
    """
    return F.col("claimed_until").isNotNull() & F.col("sending_since").isNotNull()


def stamp(claimed: DataFrame, now: datetime, own_lease: Column | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The claimed rows under their leases; ``was_lapsed`` says which count a failed attempt instead of being sent."""
    until = at(now) + lease_length(own_lease, settings)
    return (
        claimed.withColumn("was_lapsed", lapsed())
        .withColumn("claimed_until", until)
        .withColumn("next_attempt_on", until)
        .withColumn("sending_since", F.lit(None).cast("timestamp"))
    )


def may_take(now: datetime, paused: Column, probing: Column, settings: Settings = DEFAULTS) -> Column:
    """Whether a pod takes a due row: its transport is not paused, others left the row too long, or it is the probe."""
    waiting_since = F.greatest("next_attempt_on", "release_at")
    overdue = waiting_since < at(now) - seconds(settings.pause_max)
    return ~paused | overdue | (probing & (F.col("attempts") == 0))


def skip_window(claim, rows: DataFrame, now: datetime, limit: int, takes: Column, factor: int = 10) -> DataFrame:
    """A claim while a transport is paused: looks at ``factor`` times the rows and leases at most ``limit``."""
    return claim(rows, now, limit * factor).where(takes).orderBy("id").limit(limit)


def next_cursor(claimed_keys: list[str], walked: str | None, keys_ran_out: bool, filled_in_window: bool, cursor: str | None) -> str | None:
    """Round-robin cursor after a pass: the highest key claimed or walked, kept if the room filled inside a skip window."""
    if filled_in_window:
        return cursor
    top = max([*claimed_keys, *([walked] if walked else [])], key=lambda k: k.encode(), default=None)
    return top if top is not None else (None if keys_ran_out else cursor)


def claim_pass(rows: DataFrame, now: datetime, limit: int, cursor: str | None, takes: Column | None = None) -> tuple[DataFrame, str | None, bool]:
    """One concurrent pass with its wrap: (claimed rows, new cursor, whether it wrapped).

    It wraps only if the first pass was short because the keys above the cursor ran out.
    takes: which rows may be taken while a transport is paused; then a pass looks at a skip
    window, and the cursor stays where it is if the room filled inside it.  Driver state is
    bounded by ``limit`` keys.
    """
    if takes is not None:
        picked = skip_window(lambda r, at, n: concurrent_claim(r, at, n, cursor), rows, now, limit, takes)
        if picked.count() >= limit:
            return picked, cursor, False
        keys = [r["ordering_key"] for r in head_keys(rows, now, 10 * limit, cursor).collect()]
        return picked, next_cursor([], keys[-1] if keys else None, len(keys) < 10 * limit, False, cursor), False
    first = concurrent_claim(rows, now, limit, cursor)
    taken = [(r["id"], r["ordering_key"]) for r in first.select("id", "ordering_key").collect()]
    keys = [k for _, k in taken if k is not None]
    found = [r["ordering_key"] for r in head_keys(rows, now, limit, cursor).collect()] if len(taken) < limit else []
    if len(taken) >= limit or len(found) >= limit or cursor is None:
        return first, next_cursor(keys, found[-1] if found else None, len(taken) < limit, False, cursor), False
    wrapped = wrap_claim(rows, now, limit - len(taken), cursor)
    more = [r["ordering_key"] for r in wrapped.select("ordering_key").collect()]
    return first.unionByName(wrapped), next_cursor(more, None, not more, False, None), True
