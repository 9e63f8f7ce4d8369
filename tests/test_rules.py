"""Scalar rules, folds and driver rules on hand-made vectors."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegate.functions import scalars
from tidegate.model import OUTBOX, Settings
from tidegate.operators import claims, lists, maintenance, states, transitions
from tidegate.operators.gauges import GaugeSnapshot
from tidegate.operators.running import inside_any, islands, running_max, running_sum
from tidegate.streaming.control import ClaimPause, OffsetClock, depth, fastest_offset, heartbeats, mean_send_time, mean_send_times, pauses, room

NOW = datetime(2024, 1, 20)
S = timedelta(seconds=1)


def outbox(spark, *rows):
    base = {
        "aggregate_type": "a", "aggregate_id": "1", "event_type": "t", "destination": "topic-x", "payload": "{}", "created_on": NOW - 100 * S,
        "attempts": 0, "next_attempt_on": NOW - 50 * S, "lane": "ORDERED",
    }
    return spark.createDataFrame([tuple((base | r).get(f.name) for f in OUTBOX.fields) for r in rows], OUTBOX)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("attempts", "ms"), [(1, 5000), (2, 10_000), (4, 40_000), (30, 600_000)])
def test_backoff(spark, attempts, ms):
    assert one(spark, scalars.backoff_ms(F.lit(attempts))) == ms


def test_backoff_needs_an_attempt(spark):
    with pytest.raises(PySparkException):
        one(spark, scalars.backoff_ms(F.lit(0)))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (None, None), ("java.io.IOException: x", "java.io.IOException"), ("TimeoutException", "TimeoutException"), ("HttpError$NotFound: 404", "HttpError$NotFound"),
        ("Ann Smith: hello", "unclassified"), ("a.b.: x", "unclassified"), ("", "unclassified"), ("1Error: x", "unclassified"), ("x" * 198 + "Error", "unclassified"), ("no colon here", "unclassified"),
    ],
)
def test_failure_kind(spark, text, kind):
    assert one(spark, scalars.failure_kind(F.lit(text).cast("string"))) == kind


@pytest.mark.parametrize(
    ("url", "shown"),
    [("topic-a", "topic-a"), ("https://u:p@h:8080/a?b#c", "https://h:8080"), ("http://h", "http://h"), ("https://bad host/", "unparsed"), ("://x", "unparsed"), (None, "null")],
)
def test_sanitized(spark, url, shown):
    assert one(spark, scalars.sanitized_destination(F.lit(url).cast("string"))) == shown


def test_key_fits_by_utf16_length(spark):
    assert one(spark, scalars.fitted_key(F.lit("😀" * 127))) == "😀" * 127
    assert one(spark, scalars.fitted_key(F.lit("😀" * 128))).startswith("sha256:")
    assert one(spark, scalars.fitted_key(F.lit("  "))) is None


def test_headers_replace_namesakes(spark):
    stored, own = F.create_map(F.lit("X-A"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("x-a"), F.lit("9"))
    assert one(spark, scalars.merged_headers(stored, own)) == {"X-A": "1", "b": "2", "x-a": "9"}
    assert one(spark, scalars.merged_headers(stored, own, True)) == {"b": "2", "x-a": "9"}


def test_timeouts():
    assert scalars.http_timeouts(timedelta(minutes=2)) == (10 * S, 98 * S)
    assert scalars.http_timeouts(8 * S) == (2 * S, 5 * S)
    with pytest.raises(ValueError):
        scalars.http_timeouts(10 * S, connect=10 * S)
    assert scalars.kafka_bounds() == (timedelta(seconds=121, milliseconds=5), timedelta(seconds=181, milliseconds=5))


def test_null_lane_is_ordered_and_release_holds(spark):
    rows = outbox(spark, {"id": 1, "lane": None}, {"id": 2, "release_at": NOW + S}, {"id": 3, "claimed_until": NOW + S}, {"id": 4, "claimed_until": NOW}, {"id": 5, "parked_on": NOW})
    assert [r.id for r in claims.ordered_claim(rows, NOW, 10).collect()] == [1, 4]
    assert [r.id for r in rows.where(states.held(NOW)).collect()] == [2]


def test_cancelled_row_under_lease_blocks_its_key(spark):
    keyed = {"lane": "CONCURRENT", "ordering_key": "k"}
    rows = outbox(spark, keyed | {"id": 1, "cancelled_on": NOW, "claimed_until": NOW + S}, keyed | {"id": 2})
    assert claims.heads(rows, NOW, 10).count() == 0
    assert rows.where(states.leased_counted(NOW)).count() == 0


def test_two_limits_differ_from_one(spark):
    key = lambda i, k: {"id": i, "lane": "CONCURRENT", "ordering_key": k}
    rows = outbox(spark, key(1, "z"), key(2, "y"), key(3, "a"), key(4, "b"))
    assert sorted(r.id for r in claims.concurrent_claim(rows, NOW, 2).collect()) == [3, 4]
    got, cursor, wrapped = claims.claim_pass(rows, NOW, 3, "x")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3] and wrapped and cursor == "a"


def entry(i, seq, kind, at=NOW, stamp=None, until=None, error=None, terminal=False):
    return (i, seq, kind, at, stamp, until, None, error, terminal)


def test_fold_depends_on_effective_entries(spark):
    lease, later = NOW + 15 * S, NOW + 20 * S
    rows = outbox(spark, {"id": 1}, {"id": 2}, {"id": 3}, {"id": 4, "cancelled_on": NOW - S, "claimed_until": lease, "next_attempt_on": lease})
    log = spark.createDataFrame([
        entry(1, 1, "CLAIM", until=lease), entry(1, 2, "CLAIM", until=later), entry(1, 3, "RELAYED", NOW + S, later), entry(1, 4, "RELAYED", NOW + 2 * S, lease),
        entry(2, 1, "CLAIM", until=lease), entry(2, 2, "FAILED", NOW + S, lease, error="E: 1"), entry(2, 3, "RELAYED", NOW + 2 * S, lease),
        entry(3, 1, "CLAIM", until=lease), entry(3, 2, "FAILED", NOW + S, lease, error="E: 1", terminal=True), entry(3, 3, "UNPARK", NOW + 3 * S),
        entry(4, 1, "FAILED", NOW + S, lease, error="E: 2"), entry(9, 1, "CANCEL"),
    ], transitions.LOG)
    done = {r.id: r for r in transitions.fold(rows, log).collect()}
    assert done[1].effective == [1, 4] and done[1].relayed_on == NOW + 2 * S
    assert done[2].effective == [1, 2] and done[2].attempts == 1 and done[2].next_attempt_on == NOW + 6 * S and done[2].claimed_until is None
    assert done[3].effective == [1, 2, 3] and done[3].attempts == 0 and done[3].parked_on is None and done[3].last_error == "E: 1"
    assert done[4].attempts == 1 and done[4].next_attempt_on == NOW + S and done[4].parked_on is None
    assert {(r.id, r.seq) for r in transitions.refused(transitions.fold(rows, log), log).collect()} == {(1, 2), (1, 3), (2, 3), (9, 1)}


def test_prune_stops_at_its_budget(spark):
    old = NOW - timedelta(days=9)
    rows = outbox(spark, *({"id": i, "relayed_on": old} for i in range(5)), {"id": 9, "cancelled_on": old}, {"id": 10})
    got = maintenance.prune(rows, NOW, settings=Settings(maintenance_batch=2))
    assert (got.relayed, got.cancelled, got.more_to_prune, got.rows.count()) == (5, 1, False, 1)
    for batches, want in ((0, (0, 0, True, 7)), (1, (2, 0, True, 5)), (2, (4, 0, True, 3)), (3, (5, 0, True, 2)), (4, (5, 1, False, 1))):
        got = maintenance.prune(rows, NOW, settings=Settings(maintenance_batch=2), batches=batches)
        assert (got.relayed, got.cancelled, got.more_to_prune, got.rows.count()) == want


def test_pages_and_filters(spark):
    assert lists.verdict(0, 0, 50) == (200, "items */0")
    assert lists.verdict(10, 0, 50) == (200, "items 0-9/10")
    assert lists.verdict(100, 50, 20) == (206, "items 50-69/100")
    assert lists.verdict(10, 10, 5) == (416, "items */10")
    assert lists.page_bounds(0, 9999) == (0, 500)
    for bad in ({"nope": 1}, {"createdOn.gte": "x"}, {"relayedOn.isnull": 1}):
        with pytest.raises(lists.BadFilter):
            lists.field_filter(bad)
    with pytest.raises(lists.BadFilter):
        lists.state_filter("lost")
    with pytest.raises(lists.NotFound):
        lists.inspect(outbox(spark, {"id": 1}), 2)


def test_pause_and_queue_rules():
    p = ClaimPause(Settings(pause_after=2))
    p.failed(0)
    assert p.may_take(0)
    p.failed(0)
    assert p.paused and not p.may_take(4.9) and p.may_take(5) and not p.may_take(14) and p.may_take(15)
    p.succeeded()
    assert p.may_take(15.1)
    assert mean_send_time(None, 8) == 8 and mean_send_time(8, 16) == 9
    assert depth(100, 8, None) == 0 and depth(100, 8, 0.1) == 80 and depth(50, 8, 0.1) == 50
    assert room(100, 3, 0, 10) == 13 and room(100, 3, 6, 10) == 0
    assert heartbeats(100, 30 * S, 60 * S) == (5, True)


def test_clock_follows_the_fastest_trip():
    ms, at = timedelta(milliseconds=1), iter(range(0, 10_000, 7))
    clock = OffsetClock(lambda: NOW + 500 * ms, lambda: NOW + next(at) * ms, trips=2)
    clock()
    assert 400 * ms < clock.offset < 500 * ms
    assert fastest_offset([(NOW, NOW + 2 * ms, NOW + 4 * ms), (NOW, NOW + 900 * ms, NOW + 90 * ms)]) == timedelta(0)
    assert fastest_offset([(NOW, NOW + 50 * ms, NOW + 10 * ms)]) == 45 * ms


def test_gauges_are_one_snapshot_or_unknown(spark):
    import math

    table = {"rows": outbox(spark, {"id": 1}, {"id": 2, "lane": "CONCURRENT", "parked_on": NOW})}
    shown = GaugeSnapshot(lambda: table["rows"])
    assert all(map(math.isnan, shown.values.values())) and math.isnan(shown.age_s(NOW))
    assert shown.refresh(NOW) and (shown.values["ordered.open"], shown.values["concurrent.parked"], shown.values["ordered.relay_lag_s"]) == (1, 1, 100)
    del table["rows"]
    assert not shown.refresh(NOW + 5 * S) and all(map(math.isnan, shown.values.values())) and shown.age_s(NOW + 5 * S) == 5


def test_claim_pushes_its_filters_and_takes_the_top(spark, tmp_path):
    outbox(spark, {"id": 1}).write.parquet(str(tmp_path / "t"))
    plan = claims.ordered_claim(spark.read.parquet(str(tmp_path / "t")), NOW, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    for part in ("IsNull(relayed_on)", "IsNull(cancelled_on)", "IsNull(parked_on)", "LessThanOrEqual(next_attempt_on"):
        assert part in plan


def test_running_values_across_slices(spark):
    df = spark.createDataFrame([("a", i, (i * 7) % 10) for i in range(30)] + [(None, 1, 5), (None, 20, 3)], "k string, t long, v long")
    small = {"slice_rows": 5}
    got = {(r.k, r.t): (r.m, r.s) for r in running_sum(running_max(df, ["k"], ["t"], F.col("v"), "m", **small), ["k"], ["t"], F.col("v"), "s", **small).collect()}
    assert [r.n for r in running_sum(df, [], ["t", "v"], F.lit(1).cast("long"), "n", **small).orderBy("n").collect()] == list(range(1, 33))
    for k, rows in (("a", [(i, (i * 7) % 10) for i in range(30)]), (None, [(1, 5), (20, 3)])):
        for n, (t, _) in enumerate(rows):
            before = [v for _, v in rows[:n]]
            assert got[k, t] == (max(before) if before else None, sum(before) + rows[n][1])


def test_islands_and_ranges(spark):
    iv = spark.createDataFrame([("a", 0, 10), ("a", 5, 12), ("a", 12, 13), ("a", 40, 50), ("b", 0, 1)], "k string, lo long, hi long")
    assert sorted(map(tuple, islands(iv, ["k"], slice_rows=2).collect())) == [("a", 0, 13), ("a", 40, 50), ("b", 0, 1)]
    ranges = spark.createDataFrame([(NOW, NOW + 5 * S), (NOW + 3 * S, NOW + 4000 * S)], "lo timestamp, hi timestamp")
    points = spark.createDataFrame([(NOW - 2 * S,), (NOW + 4 * S,), (NOW + 4001 * S,), (NOW + 5000 * S,)], "t timestamp")
    got = inside_any(points, "t", ranges, "lo", "hi", "x", slack_us=1_000_000).orderBy("t").collect()
    assert [r.x for r in got] == [False, True, True, False]


@pytest.mark.parametrize("after", [0, 1, 3])
def test_logs_fold_by_slices(spark, after):
    settings, rows = Settings(pause_after=after), [("ab"[i % 2], "t", i, None if i % 11 == 0 else "success" if i * i % 13 == 3 and i < 90 else "failure") for i in range(120)]
    want = {}
    for pod, _, _, said in rows:
        p, begun = want.get(pod, (ClaimPause(settings), 0))
        was = p.paused
        if said:
            p.failed(0) if said == "failure" else p.succeeded()
        want[pod] = p, begun + (p.paused and not was)
    log = spark.createDataFrame(rows, "pod string, transport string, seq long, verdict string").repartition(5)
    for rows_each in (1000, 30, 3):
        got = {r.pod: (r.failures, r.paused, r.begun) for r in pauses(log, settings, rows_each).collect()}
        assert got == {k: (p.failures, p.paused, n) for k, (p, n) in want.items()}


def test_send_times_fold_by_slices(spark):
    rows, want = [("ab"[i % 2], i, 1000 + i * 7919 % 5000) for i in range(120)], {}
    for pod, _, took in rows:
        want[pod] = mean_send_time(want.get(pod), took)
    log = spark.createDataFrame(rows, "pod string, seq long, took_us long").repartition(5)
    for rows_each in (1000, 30, 3):
        assert {r.pod: r.mean_us for r in mean_send_times(log, rows_each).collect()} == pytest.approx(want)
