"""Registered queries over the derived outbox: one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import scalars
from tidegate.model import DEFAULTS, Settings
from tidegate.operators import analytics, claims, gauges, lists, maintenance, states, transitions
from tidegate.operators.running import SLICE_ROWS
from tidegate.plans import tables
from tidegate.sources import append, fixtures, sinks
from tidegate.streaming import control, relay, stateful

NOW = fixtures.NOW
MIDDLE = "https://hub/3"
_CUT = datetime(2024, 1, 13)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _micros(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds, small integers as int: the same in any engine."""
    as_ = lambda f: F.unix_micros(f.name).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name).cast("int").alias(f.name) if f.dataType.typeName() == "short" else F.col(f.name)
    return df.select(*[as_(f) for f in df.schema.fields])


def _on_outbox(name: str, columns: str = ""):
    """Registers a function of the outbox alone; ``columns`` are kept of its result."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: _micros(_kept(f(fixtures.outbox(spark, sf_dir)), columns))
        return f

    return register


def _on_log(name: str, columns: str = ""):
    """Registers a function of the outbox and the delivery log."""

    def register(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: _micros(_kept(f(fixtures.outbox(spark, sf_dir), fixtures.deliveries(spark, sf_dir)), columns))
        return f

    return register


def _kept(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*columns.split()) if columns else df


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


# --- sources and sinks


def s1_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    events = _events(spark, sf_dir)
    http = F.concat(F.lit("https://hub/"), F.col("user_id"))
    requests = events.select(
        "event_id", F.lit("user").alias("aggregate_type"), F.col("user_id").cast("string").alias("aggregate_id"), "event_type",
        F.when(e % 10 < 4, http).otherwise(F.concat(F.lit("topic-"), F.col("event_type"))).alias("destination"), F.col("props").alias("payload"),
        F.create_map(F.lit("x-n"), e.cast("string")).alias("headers"), _null("string").alias("client_profile"), _null("timestamp").alias("release_at"), _null("string").alias("reference"),
    )
    rows = append.appended(requests, NOW, e + 1000001, F.md5(e.cast("string")))
    return _micros(rows.select("id", "destination", "lane", "ordering_key", "created_on", "next_attempt_on", "attempts", "headers", "key_token"))


_QUERIES["s1_append"] = s1_append


@_on_outbox("s2_scan_page", "id destination created_on")
def s2_scan_page(o):
    return lists.page(lists.listed(o, "pending"), 100, 50)


@_on_outbox("s3_point_lookup", "id destination attempts next_attempt_on")
def s3_point_lookup(o):
    return lists.lookup(o, 42)


@_on_outbox("s5_kafka_records")
def s5_kafka_records(o):
    rows = sinks.stamped_headers(o.where(states.open_() & (scalars.route(F.col("destination")) == "kafka")))
    return rows.select("id", F.col("destination").alias("topic"), F.col("aggregate_id").alias("key"), F.size("sent_headers").alias("n_headers"), F.col("sent_headers")["x-idempotency-key"].alias("idempotency"))


@_on_outbox("s8_client_profile", "id profile")
def s8_client_profile(o):
    prefixes = o.sparkSession.createDataFrame([("https://", "any"), ("https://hub/1", "ones")], "prefix string, profile string")
    return sinks.longest_prefix(o, prefixes)


# --- claims


@_on_outbox("c1_ordered_claim", "id destination attempts")
def c1_ordered_claim(o):
    return claims.ordered_claim(o, NOW, 100)


@_on_outbox("c1_ordered_claim_10", "id destination attempts")
def c1_ordered_claim_10(o):
    return claims.ordered_claim(o, NOW, 10)


@_on_outbox("c2_keys_in_flight")
def c2_keys_in_flight(o):
    return claims.keys_in_flight(o, NOW)


@_on_outbox("c3_open_keys")
def c3_open_keys(o):
    return claims.open_keys(o, MIDDLE)


@_on_outbox("c4_heads", "ordering_key id")
def c4_heads(o):
    return claims.heads(o, NOW, 10)


@_on_outbox("c4_heads_after", "ordering_key id")
def c4_heads_after(o):
    return claims.heads(o, NOW, 100, MIDDLE)


@_on_outbox("c5_unkeyed")
def c5_unkeyed(o):
    return claims.unkeyed(o, NOW, 10)


@_on_outbox("c6_concurrent_claim", "id ordering_key")
def c6_concurrent_claim(o):
    return claims.concurrent_claim(o, NOW, 10)


@_on_outbox("c6_concurrent_claim_after", "id ordering_key")
def c6_concurrent_claim_after(o):
    return claims.concurrent_claim(o, NOW, 100, MIDDLE)


@_on_outbox("c7_wrap_claim", "id ordering_key")
def c7_wrap_claim(o):
    return claims.wrap_claim(o, NOW, 10, MIDDLE)


@_on_outbox("c8_head_keys")
def c8_head_keys(o):
    return claims.head_keys(o, NOW, 10, MIDDLE)


@_on_outbox("c9_cursor")
def c9_cursor(o):
    """Three passes: from the start, from a cursor, and one that takes all and wraps."""
    told = []
    for name, limit, cursor in (("start", 10, None), ("middle", 10, MIDDLE), ("wrap", 1_000_000, MIDDLE)):
        rows, after, wrapped = claims.claim_pass(o, NOW, limit, cursor)
        told.append((name, rows.count(), after, wrapped))
    return o.sparkSession.createDataFrame(told, "pass string, claimed long, next_cursor string, wrapped boolean")


@_on_outbox("c11_recheck", "id ordering_key")
def c11_recheck(o):
    return claims.recheck(o, o.where(states.open_() & states.keyed()), NOW)


@_on_outbox("c12_surviving", "id ordering_key")
def c12_surviving(o):
    found = claims.heads(o, NOW, 100).unionByName(claims.unkeyed(o, NOW, 100)).select("id", "ordering_key")
    locked = claims.head_keys(o, NOW, 100).where(F.substring_index("ordering_key", "/", -1).cast("long") % 2 == 0)
    return claims.surviving(found, locked, claims.all_heads(o, NOW))


@_on_outbox("c13_not_queued", "id ordering_key")
def c13_not_queued(o):
    return claims.not_queued(claims.unkeyed(o, NOW, 100), o.where(F.col("id") % 3 == 0).select("id"))


@_on_outbox("c14_lease_stamp", "id claimed_until next_attempt_on was_lapsed")
def c14_lease_stamp(o):
    return claims.stamp(claims.ordered_claim(o, NOW, 100), NOW)


@_on_outbox("c15_lease_length")
def c15_lease_length(o):
    own = F.when(F.col("id") % 5 == 0, F.make_dt_interval(secs=F.lit(30)))
    until = F.lit(NOW) + claims.lease_length(own)
    return o.select("id", (F.unix_micros(until) - F.unix_micros(F.lit(NOW))).alias("lease_us"))


@_on_outbox("c16_lapsed", "id")
def c16_lapsed(o):
    return o.where(states.due(NOW) & claims.lapsed())


@_on_outbox("c17_skip_window", "id")
def c17_skip_window(o):
    paused = scalars.route(F.col("destination")) == "kafka"
    return claims.skip_window(claims.ordered_claim, o, NOW, 20, claims.may_take(NOW, paused, F.lit(False)))


@_on_outbox("c18_may_take")
def c18_may_take(o):
    paused = scalars.route(F.col("destination")) == "kafka"
    return o.where(states.due(NOW)).select("id", claims.may_take(NOW, paused, F.col("id") % 2 == 0).alias("takes"))


# --- transitions


def _log(o: DataFrame, kind: str, stamp: Column | None = None, until: Column | None = None, since: Column | None = None, error: str | None = None, terminal: Column | None = None) -> DataFrame:
    """A log of one entry a row, at NOW."""
    return o.select(
        "id", F.lit(1).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(NOW).alias("at"),
        (_null("timestamp") if stamp is None else stamp).alias("stamp"), (_null("timestamp") if until is None else until).alias("until"),
        (_null("timestamp") if since is None else since).alias("since"), F.lit(error).cast("string").alias("error"), (F.lit(False) if terminal is None else terminal).alias("terminal"),
    )


_LATER = NOW + timedelta(minutes=1)


def _stale_stamp() -> Column:
    """The row's own lease, except every third row, whose sender holds an older one."""
    return F.when(F.col("id") % 3 == 0, F.lit(datetime(2020, 1, 1))).otherwise(F.col("claimed_until"))


@_on_outbox("t1_book_relayed", "id relayed_on claimed_until next_attempt_on")
def t1_book_relayed(o):
    return transitions.fold(o, _log(o, "RELAYED", _stale_stamp()))


@_on_outbox("t1_refused", "id")
def t1_refused(o):
    log = _log(o.where("claimed_until IS NOT NULL"), "RELAYED", _stale_stamp())
    return transitions.refused(transitions.fold(o, log), log)


@_on_outbox("t2_book_failed", "id attempts last_error parked_on next_attempt_on")
def t2_book_failed(o):
    return transitions.fold(o, _log(o, "FAILED", F.col("claimed_until"), error="E: x", terminal=F.col("id") % 5 == 0), Settings(max_attempts=3))


@_on_outbox("t4_drop", "id relayed_on")
def t4_drop(o):
    return transitions.fold(o, _log(o, "FAILED", F.col("claimed_until"), error="E: x"), Settings(max_attempts=3, exhausted="DROP"))


@_on_outbox("t7_renew", "id claimed_until sending_since next_attempt_on")
def t7_renew(o):
    return transitions.fold(o, _log(o, "RENEW", F.col("claimed_until"), F.lit(_LATER)))


@_on_outbox("t8_heartbeat", "id claimed_until sending_since")
def t8_heartbeat(o):
    log = _log(o, "HEARTBEAT", F.col("claimed_until"), F.lit(_LATER), F.lit(NOW - timedelta(seconds=5)))
    return transitions.fold(o, log).where(F.size("effective") > 0)


@_on_outbox("t9_release")
def t9_release(o):
    done = transitions.fold(o, _log(o, "RELEASE", F.col("claimed_until"))).where(F.size("effective") > 0)
    return done.select("id", "next_attempt_on", F.col("claimed_until").isNotNull().alias("still_leased"))


@_on_outbox("t10_cancel", "id verdict cancelled_on")
def t10_cancel(o):
    said = o.select("id", transitions.cancel_verdict(F.lit(NOW)).alias("verdict"))
    return transitions.fold(o, _log(o, "CANCEL")).join(said, "id")


@_on_outbox("t11_unpark", "id verdict attempts")
def t11_unpark(o):
    said = o.select("id", transitions.unpark_verdict().alias("verdict"))
    return transitions.fold(o, _log(o, "UNPARK")).join(said, "id")


@_on_outbox("t12_unpark_batch", "id parked_on")
def t12_unpark_batch(o):
    return maintenance.unpark_batch(o, "topic-click", 20, datetime(2024, 1, 5), datetime(2024, 1, 19), "sub-0")


@_on_outbox("t13_prune_relayed", "id relayed_on")
def t13_prune_relayed(o):
    return maintenance.prune_batch(o, "relayed", _CUT, 500)


@_on_outbox("t14_prune_cancelled", "id cancelled_on")
def t14_prune_cancelled(o):
    return maintenance.prune_batch(o, "cancelled", _CUT, 50)


@_on_outbox("t15_prunable")
def t15_prunable(o):
    return maintenance.prunable(o, _CUT)


@_on_outbox("t15_after_prune")
def t15_after_prune(o):
    return maintenance.pruned_all(o, _CUT).agg(F.count(F.lit(1)).alias("n"))


@_on_outbox("a11_pruned_counter")
def a11_pruned_counter(o):
    """What a prune in batches counts, by state."""
    done = maintenance.prune(o, NOW, NOW - _CUT)
    return o.sparkSession.createDataFrame([("relayed", done.relayed, done.more_to_prune), ("cancelled", done.cancelled, done.more_to_prune)], "state string, rows long, more_to_prune boolean")


# --- gauges and lists


@_on_outbox("a1_a6_gauges")
def a1_a6_gauges(o):
    return gauges.gauges(o, NOW)


@_on_log("a8_a9_counters")
def a8_a9_counters(o, log):
    return gauges.relayed_counters(o, log)


@_on_outbox("a10_attempts")
def a10_attempts(o):
    return gauges.attempts_summary(o)


@_on_outbox("a13_total")
def a13_total(o):
    return gauges.total(lists.listed(o, "PARKED"))


@_on_outbox("p1_row_view", "id lane ordering_key parked in_flight failure_kind reference")
def p1_row_view(o):
    return lists.row_view(o, NOW)


@_on_outbox("p2_state_lists")
def p2_state_lists(o):
    n = o.agg(*[F.count_if(p()).alias(s) for s, p in states.LISTS.items()])
    return n.unpivot([], list(states.LISTS), "state", "n")


@_on_outbox("p3_filters", "id")
def p3_filters(o):
    return lists.listed(o, "pending", {"eventType": "click", "createdOn.gte": datetime(2024, 1, 5), "createdOn.lt": datetime(2024, 1, 12), "parkedOn.isnull": True})


def p7_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return lists.verdicts(_events(spark, sf_dir).select((e % 120).alias("total"), (e % 70).alias("offset"), (1 + e % 60).alias("limit")))


_QUERIES["p7_verdicts"] = p7_verdicts


@_on_outbox("p8_payload")
def p8_payload(o):
    return lists.payload_view(o)


# --- scalar rules


@_on_outbox("f1_backoff")
def f1_backoff(o):
    return o.select("id", scalars.backoff_ms((F.col("id") % 40 + 1).cast("int")).alias("delay_ms"))


@_on_outbox("f2_f3_f4_stamp")
def f2_f3_f4_stamp(o):
    long_key = F.when(F.col("id") % 4 == 0, "  ").otherwise(F.repeat("destination", (F.col("id") % 30).cast("int")))
    return o.select("id", scalars.route(F.col("destination")).alias("route"), scalars.lane_of(F.col("destination")).alias("stamped_lane"), scalars.fitted_key(long_key).alias("fitted"))


@_on_outbox("f8_idempotency")
def f8_idempotency(o):
    return o.select("id", scalars.idempotency_key(F.lit("svc"), F.col("id"), F.col("key_token")).alias("idempotency"))


@_on_outbox("f10_f12_failures")
def f10_f12_failures(o):
    return o.select("id", scalars.failure_kind(F.col("last_error")).alias("kind"), scalars.failure_text(F.col("event_type"), F.col("last_error")).alias("told"))


@_on_outbox("f13_sanitized")
def f13_sanitized(o):
    host = F.when(scalars.is_http(F.col("destination")), F.concat(F.lit("https://user:pw@hub/path?q=1#x"))).otherwise(F.col("destination"))
    port = F.concat(F.lit("https://hub:"), F.col("id") % 9000, F.lit("/a"))
    url = F.when(F.col("id") % 3 == 0, host).when(F.col("id") % 3 == 1, port).otherwise(F.lit("https://bad host/x"))
    return o.select("id", scalars.sanitized_destination(url).alias("shown"))


@_on_outbox("f14_send_bound")
def f14_send_bound(o):
    bounds = {lease: scalars.send_bound(lease, timedelta(seconds=60)) // timedelta(microseconds=1) for lease in (DEFAULTS.lease, DEFAULTS.ordered_lease)}
    return o.select("id", F.when(states.concurrent(), bounds[DEFAULTS.lease]).otherwise(bounds[DEFAULTS.ordered_lease]).cast("long").alias("bound_us"))


@_on_outbox("f18_transport_down")
def f18_transport_down(o):
    inner = F.element_at(F.array(*[F.lit(c) for c in ("a.b.RetriableCommitException", "java.net.SocketTimeoutException", "x.Outer$TimeoutException", "java.io.IOException", "TimeoutExceptions")]), (F.col("id") % 5 + 1).cast("int"))
    return o.select("id", scalars.transport_down(F.array(F.lit("java.lang.RuntimeException"), inner)).alias("down"))


# --- stream rules over logs


@_on_log("w7_send_times")
def w7_send_times(o, log):
    took = F.unix_micros("end") - F.unix_micros("start")
    sends = log.select("pod", F.struct(F.unix_micros("start").alias("s"), "row_id", "attempt").alias("seq"), took.alias("took_us"))
    return control.mean_send_times(sends).select("pod", F.round("mean_us", 3).alias("mean_us"))


@_on_outbox("w11_renew_due")
def w11_renew_due(o):
    waited = F.make_dt_interval(secs=F.col("id") % 30)
    return o.select("id", control.renew_due(waited, DEFAULTS.lease).alias("renews"))


@_on_log("w13_verdicts")
def w13_verdicts(o, log):
    return log.select("row_id", "attempt", F.unix_micros("start").alias("start"), control.verdict(F.col("outcome"), F.col("interrupted"), F.col("row_id") % 4 == 0).alias("verdict"))


def w3_relay_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox after a relay has drained it in passes: every third send fails, and lapsed rows count as failed."""
    settings = Settings(batch=500)
    table = tables.EventTable(spark, tables.fresh_path(spark, "outbox"), settings)
    table.append(fixtures.outbox(spark, sf_dir))
    bad = F.col("id") % 3 == 0
    send = lambda rows: rows.select("id", F.when(bad, "FAIL").otherwise("OK").alias("outcome"), F.when(bad, "IOException: no").alias("error"))
    relay.Relay(table, send, settings, slots=8).drain(NOW)
    return _micros(table.read().select("id", "relayed_on", "attempts", "last_error", F.col("next_attempt_on") > F.lit(NOW)).toDF("id", "relayed_on", "attempts", "last_error", "waits"))


_QUERIES["w3_relay_drain"] = w3_relay_drain


def _verdict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    good = F.floor(e * 2654435761 / 65536) % 10 < 2
    return _events(spark, sf_dir).select(
        F.concat(F.lit("pod-"), e % 3).alias("pod"), F.when(e % 10 < 4, "http").otherwise("kafka").alias("transport"), e.alias("seq"), F.when(good, "success").otherwise("failure").alias("verdict")
    )


def w12_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.pauses(_verdict_log(spark, sf_dir))


_QUERIES["w12_pauses"] = w12_pauses


def w12_pause_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`w12_pauses` by the stream with keyed state: what it tells last of each pod and transport."""
    log = _verdict_log(spark, sf_dir)
    given, out, checkpoint = (tables.fresh_path(spark, name) for name in ("verdicts", "pauses", "checkpoint"))
    log.write.parquet(given)
    slices = 1 + spark.read.schema(log.schema).parquet(given).count() // SLICE_ROWS
    stateful.after_one_batch(stateful.pause_stream(spark.readStream.schema(log.schema).parquet(given), slices=slices), out, checkpoint)
    return stateful.last_pauses(spark.read.schema(stateful.PAUSE).parquet(out))


_QUERIES["w12_pause_stream"] = w12_pause_stream


def w14_clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rtt, off = 100 + e * 7919 % 5000, (e % 50 - 25) * 400 + e % 3
    trips = _events(spark, sf_dir).select(F.concat(F.lit("pod-"), e % 50).alias("pod"), F.lit(0).alias("sent_us"), (off + rtt / 2).alias("server_us"), rtt.alias("received_us"))
    return control.clock_offset(trips)


_QUERIES["w14_clock_offset"] = w14_clock_offset


@_on_outbox("w15_held", "id release_at")
def w15_held(o):
    return o.where(states.held(NOW))


@_on_log("w16_received_once")
def w16_received_once(o, log):
    key = scalars.idempotency_key(F.lit("svc"), F.col("id"), F.col("key_token")).alias("idempotency_key")
    got = relay.received_once(log.join(o.select(F.col("id").alias("row_id"), "id", "key_token"), "row_id").select(key))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idempotency_key").alias("n_keys"))


@_on_outbox("w18_traced")
def w18_traced(o):
    return o.select("id", scalars.has_trace(scalars.parsed_headers(F.col("headers"))).alias("traced"))


# --- delivery-log analytics


@_on_outbox("n1_never_relayed")
def n1_never_relayed(o):
    return analytics.never_relayed(o, o.where(F.col("id") % 10 == 0).select("id"))


def n2_never_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(analytics.never_received(fixtures.outbox(spark, sf_dir), fixtures.received(spark, sf_dir)))


_QUERIES["n2_never_received"] = n2_never_received


@_on_log("n3_duplicates")
def n3_duplicates(o, log):
    return analytics.duplicates(log, fixtures.pods(o.sparkSession), fixtures.outages(o.sparkSession))


@_on_log("n4_ordered_overlaps")
def n4_ordered_overlaps(o, log):
    return analytics.ordered_overlaps(log)


@_on_log("n5_ordered_inversions")
def n5_ordered_inversions(o, log):
    return analytics.ordered_inversions(o, log)


@_on_log("n6_key_overlaps")
def n6_key_overlaps(o, log):
    return analytics.key_overlaps(log, fixtures.pods(o.sparkSession))


@_on_log("n7_key_inversions")
def n7_key_inversions(o, log):
    return analytics.key_inversions(o, log)


@_on_log("n8_free_time")
def n8_free_time(o, log):
    return analytics.free_time(log, fixtures.pods(o.sparkSession), NOW)


@_on_log("n9_starved")
def n9_starved(o, log):
    return analytics.starved(o, log, fixtures.pods(o.sparkSession), fixtures.outages(o.sparkSession), NOW)


@_on_outbox("n10_gauge_differences")
def n10_gauge_differences(o):
    reported = gauges.gauges(o, NOW).withColumn("pending", F.col("pending") + F.when(F.col("lane") == "ordered", 1).otherwise(0))
    return analytics.gauge_differences(reported, o, NOW)


@_on_log("n11_counter_differences")
def n11_counter_differences(o, log):
    table = gauges.relayed_counters(o, log)
    return analytics.counter_differences(table.withColumn("dropped", F.lit(0).cast("long")), table)


@_on_log("n12_inconsistencies")
def n12_inconsistencies(o, log):
    return analytics.inconsistencies(o, log, NOW)


@_on_log("n13_late_turns")
def n13_late_turns(o, log):
    return analytics.late_turns(log, datetime(2024, 1, 1))


def n14_claim_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kinds = F.array(F.lit("claim"), F.lit("head_keys"), F.lit("wrap"))
    log = _events(spark, sf_dir).select(
        F.concat(F.lit("pod-"), e % 3).alias("pod"), e.alias("seq"), F.element_at(kinds, (F.floor(e / 3) % 3 + 1).cast("int")).alias("statement"), F.lit(100).cast("long").alias("limit"), (e * 7919 % 130).alias("count")
    )
    return analytics.claim_wraps(log)


_QUERIES["n14_claim_wraps"] = n14_claim_wraps


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
