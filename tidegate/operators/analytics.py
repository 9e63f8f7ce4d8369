"""Checks of a delivery log against the table: duplicates, overlaps, order, starvation, consistency."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.model import CONCURRENT, DEFAULTS, REACHED, Settings, at
from tidegate.operators import states
from tidegate.operators.gauges import gauges
from tidegate.operators.running import inside_any, islands, running_max, running_sum

SLACK_US = 50_000


def delivered() -> Column:
    return F.col("outcome").isin(*REACHED) & ~F.col("interrupted")


def tracked() -> Column:
    """Destinations whose receiver keeps the log."""
    return F.col("destination").startswith("http") | F.col("destination").startswith("topic-")


def lease_us(settings: Settings = DEFAULTS) -> Column:
    us = lambda d: d // timedelta(microseconds=1)
    return F.when(F.col("lane").eqNullSafe(CONCURRENT), us(settings.lease)).otherwise(us(settings.ordered_lease))


def _us(name: str) -> Column:
    return F.unix_micros(name)


def never_relayed(rows: DataFrame, excused: DataFrame) -> DataFrame:
    """Open rows that nothing excuses."""
    return rows.where(states.open_()).join(excused, "id", "left_anti").select("id", "destination", "attempts")


def never_received(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows booked as relayed that no delivery shows."""
    seen = log.select(F.col("row_id").alias("id"))
    return rows.where(states.relayed() & tracked()).join(seen, "id", "left_anti").select("id", "destination")


def duplicates(log: DataFrame, pods: DataFrame, outages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(row_id, delivered, unbookable, unexplained) of rows delivered more than once.

    A send can't be booked if it outlasted its lease, its pod was killed, or it ended
    within a second of a database outage.
    """
    marked = inside_any(log, "end", outages, "lo", "hi", "_cut", slack_us=1_000_000).join(pods.select("pod", "killed"), "pod", "left")
    lost = (_us("end") - _us("start") > lease_us(settings)) | F.coalesce("killed", F.lit(False)) | F.col("_cut")
    found = marked.groupBy("row_id").agg(F.count_if(delivered()).alias("delivered"), F.count_if(lost).alias("unbookable"))
    return found.where("delivered > 1").withColumn("unexplained", F.col("delivered") - 1 > F.col("unbookable"))


def ordered_overlaps(log: DataFrame) -> DataFrame:
    """(pod, before, after): ordered sends of a pod that began before the one before them had ended."""
    sends = log.where(~F.col("lane").eqNullSafe(CONCURRENT))
    last = F.struct(_us("start").alias("s"), F.col("row_id"), F.col("attempt"), _us("end").alias("e"))
    seen = running_max(sends, ["pod"], ["start", "row_id", "attempt"], last, "_last")
    return seen.where(_us("start") < F.col("_last.e") - SLACK_US).select("pod", F.col("_last.row_id").alias("before"), F.col("row_id").alias("after"))


def ordered_inversions(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(pod, row_id, last): first ordered attempts sent after a higher id, of rows never held and never failed."""
    failed = log.where(~delivered()).select(F.col("row_id").alias("id")).distinct()
    plain = rows.where(F.col("release_at").isNull()).select("id").join(failed, "id", "left_anti").withColumnRenamed("id", "row_id")
    first = log.where(~F.col("lane").eqNullSafe(CONCURRENT) & (F.col("attempt") == 1)).join(plain, "row_id", "left_semi")
    seen = running_max(first, ["pod"], ["start", "row_id"], F.col("row_id"), "last")
    return seen.where("row_id < last").select("pod", "row_id", "last")


def key_overlaps(log: DataFrame, pods: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(ordering_key, before, after): two sends of a key at once, the longer-lasting one neither lapsed nor of a killed pod."""
    sends = log.where(F.col("lane").eqNullSafe(CONCURRENT) & F.col("ordering_key").isNotNull()).join(pods.select("pod", "killed"), "pod", "left")
    excused = (_us("end") - _us("start") > lease_us(settings)) | F.coalesce("killed", F.lit(False))
    longest = F.struct(_us("end").alias("e"), (-_us("start")).alias("s"), (-F.col("row_id")).alias("r"), excused.alias("excused"))
    seen = running_max(sends, ["ordering_key"], ["start", "row_id", "attempt"], longest, "_long")
    return seen.where((_us("start") < F.col("_long.e") - SLACK_US) & ~F.col("_long.excused")).select(
        "ordering_key", (-F.col("_long.r")).alias("before"), F.col("row_id").alias("after")
    )


def key_inversions(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(ordering_key, earlier, later, excused): rows of a key first delivered after one of a higher id.

    Excused: the row had failed before the passing send, was held then, or has failed attempts in the table.
    """
    sends = log.where(F.col("lane").eqNullSafe(CONCURRENT) & F.col("ordering_key").isNotNull())
    first = sends.where(delivered()).groupBy("ordering_key", "row_id").agg(F.min(_us("start")).alias("first"))
    last = F.struct("first", "row_id")
    seen = running_max(first, ["ordering_key"], ["first", "row_id"], last, "_last").where(F.col("row_id") < F.col("_last.row_id"))
    failed = log.where(~delivered()).groupBy("row_id").agg(F.min(_us("end")).alias("_failed"))
    own = rows.select(F.col("id").alias("row_id"), "release_at", "attempts")
    joined = seen.join(failed, "row_id", "left").join(own, "row_id", "left")
    excused = (
        F.coalesce(F.col("_failed") < F.col("_last.first") + SLACK_US, F.lit(False))
        | F.coalesce(_us("release_at") > F.col("_last.first") - SLACK_US, F.lit(False))
        | F.coalesce(F.col("attempts") > 0, F.lit(False))
    )
    return joined.select("ordering_key", F.col("_last.row_id").alias("earlier"), F.col("row_id").alias("later"), excused.alias("excused"))


def _lane(concurrent: bool) -> Column:
    is_c = F.col("lane").eqNullSafe(CONCURRENT)
    return is_c if concurrent else ~is_c


def free_intervals(log: DataFrame, pods: DataFrame, now: datetime, concurrent: bool) -> DataFrame:
    """(pod, lo, hi) in microseconds: when a pod had a free slot of a lane.

    A sweep over sends that begin and end; busy slots between two instants are the running
    sum of the changes.  The ordered lane has one slot.
    """
    sends = log.where(_lane(concurrent))
    alive = pods.select("pod", _us("started").alias("_from"), F.coalesce(_us("stopped"), F.unix_micros(at(now))).alias("_to"), F.when(F.lit(concurrent), F.col("slots")).otherwise(1).alias("_slots"))
    changes = (
        sends.select("pod", _us("start").alias("at"), F.lit(1).alias("d"))
        .unionByName(sends.select("pod", _us("end").alias("at"), F.lit(-1).alias("d")))
        .unionByName(alive.select("pod", F.explode(F.array("_from", "_to")).alias("at"), F.lit(0).alias("d")))
        .groupBy("pod", "at").agg(F.sum("d").alias("d"))
    )
    busy = running_sum(changes, ["pod"], ["at"], F.col("d"), "busy")
    # The next instant is the least later one: a running maximum of the negated instants, backwards.
    step = running_max(busy, ["pod"], [F.desc("at")], -F.col("at"), "_next").withColumn("_next", -F.col("_next"))
    free = step.join(alive, "pod").where((F.col("busy") < F.col("_slots")) & F.col("_next").isNotNull())
    free = free.select("pod", F.greatest("at", "_from").alias("lo"), F.least("_next", "_to").alias("hi"))
    return free.where("lo < hi")


def free_time(log: DataFrame, pods: DataFrame, now: datetime) -> DataFrame:
    """(lane, free_us): how long some pod had a free slot of each lane."""
    both = [islands(free_intervals(log, pods, now, c).withColumn("lane", F.lit("concurrent" if c else "ordered")), ["lane"]) for c in (False, True)]
    return both[0].unionByName(both[1]).groupBy("lane").agg(F.sum(F.col("hi") - F.col("lo")).alias("free_us"))


def _minus(free: DataFrame, outages: DataFrame) -> DataFrame:
    """Free intervals (lane, lo, hi) without outages and the three seconds of reconnecting after them."""
    cut = outages.select(_us("lo").alias("lo"), (_us("hi") + 3_000_000).alias("hi")).withColumn("k", F.lit(0))
    cut = islands(cut, ["k"]).drop("k")
    lanes = free.select("lane").distinct()
    changes = (
        free.select("lane", F.col("lo").alias("at"), F.lit(1).alias("d"))
        .unionByName(free.select("lane", F.col("hi").alias("at"), F.lit(-1).alias("d")))
        .unionByName(lanes.withColumn("d", F.lit(0)).withColumn("at", F.lit(None).cast("long")).select("lane", "at", "d").where("false"))
    )
    stop = cut.select(F.explode(F.array(F.lit("concurrent"), F.lit("ordered"))).alias("lane"), "lo", "hi")
    changes = changes.unionByName(stop.select("lane", F.col("lo").alias("at"), F.lit(-2).alias("d"))).unionByName(stop.select("lane", F.col("hi").alias("at"), F.lit(2).alias("d")))
    changes = changes.groupBy("lane", "at").agg(F.sum("d").alias("d"))
    level = running_sum(changes, ["lane"], ["at"], F.col("d"), "level")
    step = running_max(level, ["lane"], [F.desc("at")], -F.col("at"), "_next").withColumn("_next", -F.col("_next"))
    return step.where("level = 1 AND _next IS NOT NULL").select("lane", F.col("at").alias("lo"), F.col("_next").alias("hi"))


def starved(rows: DataFrame, log: DataFrame, pods: DataFrame, outages: DataFrame, now: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """(id, wait_us, free_us): rows whose first send came later than bound, counted in time with a free slot.

    A row waits from its creation, its release, or the last send of its key's earlier
    rows, whichever is latest; a key whose head never went excuses the rows behind it.
    """
    sent = log.groupBy(F.col("row_id").alias("id")).agg(F.min(_us("start")).alias("_first"), F.max(_us("end")).alias("_done"))
    mine = rows.where(F.col("cancelled_on").isNull() & tracked()).select("id")
    joined = rows.select("id", "ordering_key", "lane", _us("created_on").alias("_created"), _us("release_at").alias("_release"), states.open_().alias("_open")).join(sent, "id", "left")
    keyed = joined.where("ordering_key IS NOT NULL")
    ahead = F.struct((F.col("_open") & F.col("_done").isNull()).cast("int").alias("stuck"))
    keyed = running_max(keyed, ["ordering_key"], ["id"], F.col("_done"), "_ahead")
    keyed = running_max(keyed, ["ordering_key"], ["id"], ahead["stuck"], "_stuck")
    plain = joined.where("ordering_key IS NULL").withColumns({"_ahead": F.lit(None).cast("long"), "_stuck": F.lit(None).cast("int")})
    first = F.coalesce("_first", F.when(F.col("_open"), F.unix_micros(at(now))))
    wait = keyed.unionByName(plain).join(mine, "id", "left_semi").withColumn("_start", first)
    wait = wait.withColumn("_from", F.greatest("_created", "_release", "_ahead"))
    wait = wait.where((F.coalesce("_stuck", F.lit(0)) == 0) & (F.col("_start") > F.col("_from")))
    wait = wait.withColumn("lane_name", F.when(F.col("lane").eqNullSafe(CONCURRENT), "concurrent").otherwise("ordered"))
    free = [islands(free_intervals(log, pods, now, c).withColumn("lane", F.lit("concurrent" if c else "ordered")), ["lane"]) for c in (False, True)]
    free = _minus(free[0].unionByName(free[1]), outages)
    # Free time up to an instant: of the last interval that began, what lay before it and what of it has passed.
    grown = running_sum(free, ["lane"], ["lo"], F.col("hi") - F.col("lo"), "before", through=False)
    marks = grown.select("lane", F.col("lo").alias("at"), F.struct(F.col("lo").alias("lo"), "hi", "before").alias("m"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("which"))
    none = F.lit(None).cast(marks.schema["m"].dataType)
    asks = wait.select(F.col("lane_name").alias("lane"), "id", F.explode(F.array(F.struct(F.col("_from").alias("at"), F.lit(1).alias("which")), F.struct(F.col("_start").alias("at"), F.lit(2).alias("which")))).alias("a"))
    asks = asks.select("lane", F.col("a.at").alias("at"), none.alias("m"), "id", F.col("a.which").alias("which"))
    both = marks.unionByName(asks)
    known = running_max(both, ["lane"], ["at", "which", "id"], F.col("m"), "last", through=True).where("which > 0")
    upto = F.coalesce(F.col("last.before") + F.least(F.col("at"), F.col("last.hi")) - F.col("last.lo"), F.lit(0))
    spans = known.groupBy("id").agg((F.max(F.when(F.col("which") == 2, upto)) - F.max(F.when(F.col("which") == 1, upto))).alias("free_us"))
    bound = F.lit(settings.sweep // timedelta(microseconds=1) + 1_000_000) + lease_us(settings)
    return wait.join(spans, "id").where(F.col("free_us") > bound).select("id", (F.col("_start") - F.col("_from")).alias("wait_us"), "free_us")


def gauge_differences(reported: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """Lanes where reported (lane, pending, parked, in_flight) differ from a recount of the table."""
    own = gauges(rows, now).select("lane", "pending", "parked", "in_flight")
    both = reported.select("lane", F.col("pending").alias("r1"), F.col("parked").alias("r2"), F.col("in_flight").alias("r3")).join(own, "lane", "full")
    same = F.col("r1").eqNullSafe(F.col("pending")) & F.col("r2").eqNullSafe(F.col("parked")) & F.col("r3").eqNullSafe(F.col("in_flight"))
    return both.where(~same).select("lane", "pending", "parked", "in_flight")


def counter_differences(counted: DataFrame, table: DataFrame) -> DataFrame:
    """Destinations where counted (destination, relayed, dropped) differ from the table's."""
    a, b = counted.groupBy("destination").agg(F.sum("relayed").alias("r1"), F.sum("dropped").alias("d1")), table
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = a.join(b, "destination", "full")
    return both.where((zero("r1") != zero("relayed")) | (zero("d1") != zero("dropped"))).select("destination", zero("relayed").alias("relayed"), zero("dropped").alias("dropped"))


def inconsistencies(rows: DataFrame, log: DataFrame, now: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """(id, problem): states and sends that must not be together.  One aggregate of the log, one join."""
    sent = log.groupBy(F.col("row_id").alias("id")).agg(
        F.max(_us("start")).alias("_last"), F.min(_us("start")).alias("_first"), F.count_if(~delivered()).alias("_failed"), F.count_if(F.col("outcome") == "TERMINAL").alias("_terminal")
    )
    joined = rows.join(sent, "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    booked = (F.col("attempts") > 0) & F.col("last_error").isNotNull()
    unsettled = F.col("relayed_on").isNull() & F.col("cancelled_on").isNull() & F.col("parked_on").isNull()
    rules = {
        "relayed and parked": F.col("relayed_on").isNotNull() & F.col("parked_on").isNotNull(),
        "sent after its cancel": F.col("_last") > _us("cancelled_on") + SLACK_US,
        "sent before its release": F.col("_first") < _us("release_at") - SLACK_US,
        "parked without a failure": F.col("parked_on").isNotNull() & ~booked & (n("_failed") == 0) & tracked(),
        "exhausted but not parked": unsettled & ((n("_terminal") > 0) | (n("_failed") >= settings.max_attempts)),
        "still leased": F.col("relayed_on").isNull() & (F.col("claimed_until") > at(now)),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return joined.select("id", F.explode(found).alias("problem"))


def late_turns(log: DataFrame, eligible: datetime, factor: float = 1.5, slack: timedelta = timedelta(seconds=10)) -> DataFrame:
    """(row_id, rank, waited_ms): rows that waited beyond their share of a drain.

    Claims go round by round over the keys, so a row's rank is its place in the order of
    rounds and keys; it may wait ``factor`` times its share plus slack.
    """
    first = log.where("ordering_key IS NOT NULL").groupBy("ordering_key", "row_id").agg(F.min(_us("start")).alias("first"), F.max(_us("end")).alias("done"))
    one = F.lit(1).cast("long")
    turn = running_sum(first, ["ordering_key"], ["row_id"], one, "round")
    ranked = running_sum(turn, [], ["round", "ordering_key"], one, "rank")
    n, done = first.agg(F.count(F.lit(1)), F.max("done")).first()
    if not n:
        return ranked.select("row_id", "rank", F.lit(0).cast("long").alias("waited_ms"))
    start = F.unix_micros(at(eligible))
    waited = F.floor((F.col("first") - start) / 1000)
    drain = F.floor((F.lit(done) - start) / 1000)
    share = drain * F.col("rank") / F.lit(n)
    return ranked.where(waited > F.lit(factor) * share + F.lit(slack // timedelta(milliseconds=1))).select("row_id", "rank", waited.alias("waited_ms"))


def claim_wraps(claims: DataFrame) -> DataFrame:
    """(pod, seq, premature) of every wrap in a claim log (pod, seq, statement, limit, count).

    A wrap is due only after a short first pass whose head keys were counted and short too.
    """
    is_ = lambda kind: F.col("statement") == kind
    # A claim opens a round; what a wrap is judged by is the last claim before it and the last head keys since.
    claim = F.when(is_("claim"), F.struct("seq", "limit", "count"))
    heads = F.when(is_("head_keys"), F.struct("seq", "count"))
    seen = running_max(running_max(claims, ["pod"], ["seq"], claim, "_claim"), ["pod"], ["seq"], heads, "_heads")
    limit, count = F.col("_claim.limit"), F.col("_claim.count")
    own = F.when(F.col("_heads.seq") > F.coalesce(F.col("_claim.seq"), F.lit(-1)), F.col("_heads.count"))
    early = (F.coalesce(count, F.lit(-1)) >= F.coalesce(limit, F.lit(-1))) | own.isNull() | (own >= F.coalesce(limit, F.lit(-1)))
    return seen.where(is_("wrap")).select("pod", "seq", early.alias("premature"))
