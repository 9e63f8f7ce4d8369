"""The relay end to end: stored claims, sends, retries, lapses, pauses, commands, and a stream of appended rows."""

import re
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tests.test_rules import outbox
from tidegate.model import CONCURRENT, ORDERED, Settings
from tidegate.operators import claims
from tidegate.plans.tables import EventTable, Writer
from tidegate.sources import sinks
from tidegate.streaming import ops
from tidegate.streaming.publishers import Publisher, out_of_reach, stamped
from tidegate.streaming.relay import Relay, _Renewing

NOW = datetime(2024, 1, 20)


def _failing_threes(rows):
    bad = F.col("id") % 3 == 0
    return rows.select("id", F.when(bad, "FAIL").otherwise("OK").alias("outcome"), F.when(bad, "IOException: no").alias("error"))


def _table(spark, path, *rows, **options):
    table = EventTable(spark, f"file://{path}/outbox", **options)
    table.append(outbox(spark, *rows))
    return table


def _rows(table):
    return {r.id: r for r in table.read().collect()}


def _key(i):
    return {"id": i, "lane": "CONCURRENT", "ordering_key": f"k{i % 2}", "destination": "https://h/x"}


def _ok(rows):
    return rows.select("id", F.lit("OK").alias("outcome"), F.lit(None).cast("string").alias("error"))


def _failing_with(error):
    return lambda rows: rows.select("id", F.lit("FAIL").alias("outcome"), F.lit(error).alias("error"))


def _claim(relay, now):
    return relay.claim(now, ORDERED), relay.claim(now, CONCURRENT)


def test_passes_book_and_retry(spark, tmp_path):
    settings = Settings(max_attempts=2)
    table = _table(spark, tmp_path, {"id": 1}, {"id": 3}, *map(_key, (10, 11, 12, 14)), settings=settings)
    relay = Relay(table, _failing_threes, settings, compact_after=5)
    assert relay.drain(NOW) == 6
    rows = _rows(table)
    assert all(rows[i].relayed_on == NOW for i in (1, 10, 11, 14))
    assert rows[3].attempts == 1 and rows[3].next_attempt_on == NOW + timedelta(seconds=5)
    assert relay.drain(NOW + timedelta(seconds=6)) == 2
    rows = _rows(table)
    assert rows[3].parked_on and rows[12].parked_on and table.version() > 0 and len(rows) == 6
    assert relay.mean_s is not None and relay.room() <= settings.batch
    assert table.log().where("id >= 0").groupBy("id", "seq").count().where("count > 1").isEmpty()


def test_small_batches_take_every_key_in_order(spark, tmp_path):
    settings = Settings(batch=4)
    rows = [{**_key(i), "ordering_key": f"k{i % 7}"} for i in range(10, 40)]
    table = _table(spark, tmp_path, *rows, *({"id": i} for i in range(9)), settings=settings)
    sent = []
    relay = Relay(table, _ok, settings, slots=2, compact_after=7)
    relay._learn, learn = (lambda mine, *a: (sent.extend(mine.values()), learn(mine, *a))), relay._learn
    assert relay.drain(NOW) == 39 and all(r.relayed_on == NOW for r in _rows(table).values())
    for key in {c.key for c in sent if c.key}:
        ids = [c.id for c in sent if c.key == key]
        assert ids == sorted(ids)
    assert len(sent) == len({c.id for c in sent}) == 39 and max(p["claimed"] for p in relay.passes) <= 4


def test_a_pass_that_dies_comes_back_when_its_lease_ends(spark, tmp_path):
    table, later = _table(spark, tmp_path, {"id": 1}, {"id": 2, "destination": "https://h/x", "lane": "CONCURRENT"}), NOW + timedelta(minutes=5)
    dead = Relay(table, _failing_threes)
    mine = _claim(dead, NOW)  # and nothing after it
    rows = _rows(table)
    assert [[c.id for c in x] for x in mine] == [[1], [2]] and rows[1].claimed_until == NOW + timedelta(seconds=15) and rows[2].claimed_until == NOW + timedelta(minutes=2)
    assert Relay(table, _failing_threes).drain(NOW + timedelta(seconds=1)) == 0
    # Killed before its sends were seen to run: sent again, no attempt counted.
    heir = Relay(table, _failing_threes)
    mine = [c for x in _claim(heir, later) for c in x]
    assert len(mine) == 2 and heir.passes[-1]["lapsed"] == 0
    # This one dies between send and booking, after a renewal.
    _Renewing(heir, mine, later, lambda: later + timedelta(seconds=5)).beat()
    assert _rows(table)[1].sending_since == later
    last, after = Relay(table, _failing_threes), later + timedelta(minutes=5)
    assert last.drain(after) == 2 and sum(p["lapsed"] for p in last.passes) == 2
    rows = _rows(table)
    assert all(r.attempts == 1 and r.relayed_on is None and r.last_error.startswith("LeaseLapsed") and r.next_attempt_on == after + timedelta(seconds=5) for r in rows.values())
    assert last.drain(after + timedelta(seconds=6)) == 2 and all(r.relayed_on for r in _rows(table).values())


SHORT = Settings(ordered_lease=timedelta(seconds=3), kafka_lease=timedelta(seconds=3), send_timeout=timedelta(seconds=2))


def test_long_sends_renew_their_leases(spark, tmp_path):
    table = _table(spark, tmp_path, {"id": 1}, settings=SHORT)
    relay = Relay(table, lambda rows: sinks.send_with(rows, lambda r: time.sleep(3)), SHORT)
    assert relay.run_pass(ORDERED) == 1
    kinds = [r.kind for r in table.log().orderBy("seq").collect()]
    assert kinds[0] == "CLAIM" and "HEARTBEAT" in kinds and kinds[-1] == "RELAYED" and _rows(table)[1].relayed_on


def test_a_renewal_that_fails_fails_the_pass(spark, tmp_path):
    table = _table(spark, tmp_path, {"id": 1}, settings=SHORT)
    relay = Relay(table, lambda rows: sinks.send_with(rows, lambda r: time.sleep(3)), SHORT)
    book = relay._book
    relay._book = lambda rows, kind, *a, **k: (_ for _ in ()).throw(OSError("no store")) if kind == "HEARTBEAT" else book(rows, kind, *a, **k)
    with pytest.raises(OSError):
        relay.run_pass(ORDERED)
    assert _rows(table)[1].relayed_on is None


def test_a_hung_send_is_left_and_counts(spark, tmp_path):
    def hang(r):
        time.sleep(30 if r["id"] == 1 else 0)

    settings = Settings(pause_after=1)
    kafka = Publisher("kafka", lambda rows: sinks.send_with(rows, hang, bound_s=1.0), settings, transport="kafka", down=out_of_reach)
    table = _table(spark, tmp_path, {"id": 2}, {"id": 1}, settings=settings)
    relay = Relay(table, settings=settings, publishers=(kafka,))
    began = time.monotonic()
    assert relay.drain(NOW) == 2 and time.monotonic() - began < 25
    rows = _rows(table)
    assert rows[2].relayed_on and rows[1].attempts == 1 and rows[1].last_error.startswith("InterruptedError")
    assert not relay.pauses["kafka"].paused  # the send after it reached its receiver
    table.append(outbox(spark, {"id": 3}))
    kafka = Publisher("kafka", lambda rows: sinks.send_with(rows, lambda r: time.sleep(30), bound_s=1.0), settings, transport="kafka", down=out_of_reach)
    again = Relay(table, settings=settings, publishers=(kafka,))
    assert again.drain(NOW) == 1 and again.pauses["kafka"].paused


def test_give_back_and_a_cursor_that_survives(spark, tmp_path):
    table = _table(spark, tmp_path, {"id": 1}, *map(_key, (10, 11)))
    relay = Relay(table, _failing_threes)
    for mine in _claim(relay, NOW):
        relay.give_back(mine, NOW)
    assert all(r.claimed_until is None and r.attempts == 0 for r in _rows(table).values())
    assert relay.cursor == "k1" and Relay(table, _failing_threes).cursor == "k1"
    seq = relay.writer.seq
    relay.writer.compact()
    heir = Relay(table, _failing_threes)
    assert heir.cursor == "k1" and heir.writer.seq == seq and heir.drain(NOW) == 3
    stopped = Relay(_table(spark, tmp_path / "b", {"id": 1}), _failing_threes)
    stopped.stop()
    assert stopped.drain(NOW) == 0
    idle = Relay(_table(spark, tmp_path / "c", _key(1)), _failing_threes, slots=0)
    assert idle.drain(NOW) == 0 and _rows(idle.table)[1].claimed_until is None


def test_policies_and_hooks(spark, tmp_path):
    told = []
    http = Publisher("http", _failing_with("java.net.TimeoutException: late"), Settings(max_attempts=1, exhausted="DROP"), timedelta(minutes=1), on_exhausted=lambda rows: told.extend(r.id for r in rows.collect()))
    kafka = Publisher("kafka", _ok, on_booked=lambda rows: told.extend(-r.id for r in rows.collect()))
    rows = [{"id": i, "destination": f"https://h/{i}", "lane": "CONCURRENT", "next_attempt_on": NOW} for i in range(10, 14)]
    table = _table(spark, tmp_path, {"id": 1}, *rows)
    relay = Relay(table, publishers=(http, kafka))
    mine = relay.claim(NOW, CONCURRENT)
    assert _rows(table)[10].claimed_until == NOW + timedelta(minutes=1)
    relay.deliver(mine, CONCURRENT, lambda: NOW)
    assert relay.drain(NOW) == 1
    rows = _rows(table)
    assert sorted(told) == [-1, 10, 11, 12, 13] and all(rows[i].relayed_on and rows[i].attempts == 1 for i in range(10, 14))
    own = Publisher("kafka", _ok, lane=F.lit("CONCURRENT"), key=F.col("reference"))
    got = {r.id: r for r in stamped(outbox(spark, {"id": 1, "reference": "r"}, {"id": 2, "destination": "https://h/x", "lane": "CONCURRENT", "ordering_key": "k"}), (http, own)).collect()}
    assert (got[1].lane, got[1].ordering_key, got[2].lane, got[2].ordering_key) == ("CONCURRENT", "r", "CONCURRENT", "k")


def test_a_dead_receiver_holds_up_nobody(spark, tmp_path):
    """HTTP names no transport: rows for other receivers go, however many sends to one of them fail."""
    dead = F.col("destination") == "https://dead/x"
    send = lambda rows: rows.select("id", F.when(dead, "FAIL").otherwise("OK").alias("outcome"), F.when(dead, "java.net.SocketTimeoutException: late").alias("error"))
    settings = Settings(pause_after=3)
    rows = [{"id": i, "destination": "https://dead/x" if i % 3 == 0 else f"https://h/{i % 5}", "lane": "CONCURRENT", "next_attempt_on": NOW} for i in range(1, 301)]
    table = _table(spark, tmp_path, *rows, settings=settings)
    relay = Relay(table, send, settings)
    assert relay.drain(NOW) == 300 and relay.pauses == {}
    assert all(bool(r.relayed_on) == (r.id % 3 != 0) for r in _rows(table).values())


def test_a_lost_transport_pauses_and_probes_with_one_row(spark, tmp_path):
    settings, second = Settings(pause_after=3), timedelta(seconds=1)
    table = _table(spark, tmp_path, *({"id": i, "next_attempt_on": NOW} for i in range(3)), settings=settings)
    relay = Relay(table, _failing_with("java.net.TimeoutException: late"), settings)
    assert relay.drain(NOW) == 3
    assert relay.pauses["kafka"].paused and relay.gauges() == {"claims.paused.kafka": 1, "relay.running": 0}
    # Its time comes and no fresh row is due: the probe isn't spent.
    due = NOW + 6 * second
    failed = relay.claim(due, ORDERED)
    assert failed == [] and relay.pauses["kafka"].probe_at <= due.timestamp()
    table.append(outbox(spark, *({"id": i, "next_attempt_on": NOW} for i in (20, 21, 22)), {"id": 30, "destination": "https://h/9", "lane": "CONCURRENT", "next_attempt_on": NOW}))
    assert [c.id for c in relay.claim(due, ORDERED)] == [20]
    assert relay.claim(due + second, ORDERED) == []  # the next probe is later
    assert [c.id for c in relay.claim(due, CONCURRENT)] == [30]
    assert [c.id for c in relay.claim(NOW + timedelta(minutes=9), ORDERED)] == [0, 1, 2, 20, 21, 22]  # left too long by all
    healthy = Relay(table, _ok, settings)
    healthy.pauses = relay.pauses
    healthy.drain(NOW + timedelta(minutes=30))
    assert not relay.pauses["kafka"].paused


def test_claims_scan_no_closed_file_and_prunes_drop_days(spark, tmp_path):
    day = timedelta(days=1)
    done = [{"id": 100 + i, "relayed_on": NOW - (i % 10) * day, "created_on": NOW - 20 * day} for i in range(40)]
    table = _table(spark, tmp_path, {"id": 1}, _key(2), *done, {"id": 50, "cancelled_on": NOW - 9 * day}, {"id": 51, "cancelled_on": NOW - 9 * day, "claimed_until": NOW})
    writer = Writer(table)
    writer.compact()
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "/closed" not in plan(claims.ordered_claim(table.live(), NOW, 10)) and "/closed" not in plan(claims.concurrent_claim(table.live(), NOW, 10))
    assert sorted(r.id for r in table.live().collect()) == [1, 2, 51] and len(_rows(table)) == 44 and len(table.days()) == 10
    done = ops.prune(writer, NOW + timedelta(hours=1), 7 * day)
    # Those relayed on the cut's own day, but before it, are gone too.
    assert (done.relayed, done.cancelled, done.more_to_prune) == (12, 2, False) and len(_rows(table)) == 30
    assert table.days()[0] == (NOW - 7 * day).date() and len(table.days()) == 8
    text = plan(table.read())
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2024-01-13", text)
    writer.compact()
    assert len(_rows(table)) == 30 and table.pruned_until() == NOW + timedelta(hours=1) - 7 * day
    again = ops.prune(writer, NOW + timedelta(hours=1), 7 * day)
    assert (again.relayed, again.cancelled) == (0, 0)


def test_a_compaction_that_dies_loses_nothing(spark, tmp_path):
    table = _table(spark, tmp_path, {"id": 1, "relayed_on": NOW}, _key(2))
    relay = Relay(table, _failing_threes)
    relay.drain(NOW)
    before = _rows(table)
    relay.writer.compact()
    v = table.version()
    relay.writer.mark("CURSOR", "k9")
    relay.writer.compact()
    table.remove(f"base={v + 1}/_SUCCESS")  # it died before the end
    heir = Relay(table, _failing_threes)
    assert table.version() == v and _rows(table) == before and heir.cursor == "k9"
    heir.writer.compact()
    assert _rows(table) == before and heir.writer.table.cursor() == "k9"


def test_commands(spark, tmp_path):
    settings = Settings(maintenance_batch=2)
    parked = [{"id": i, "parked_on": NOW - timedelta(hours=i), "attempts": 3, "reference": "r" if i % 2 else None} for i in range(10, 15)]
    old = [{"id": i, "relayed_on": NOW - timedelta(days=9)} for i in range(20, 23)]
    table = _table(spark, tmp_path, {"id": 1}, {"id": 2, "claimed_until": NOW + timedelta(minutes=1)}, *parked, *old, {"id": 30, "cancelled_on": NOW - timedelta(days=8)}, settings=settings)
    writer = Writer(table)
    ops.cancel(writer, 1, NOW)
    assert _rows(table)[1].cancelled_on == NOW
    writer.compact()  # what is closed is refused alike
    for bad, error in ((99, ops.NotFound), (1, ops.WrongState), (2, ops.WrongState), (20, ops.WrongState)):
        with pytest.raises(error):
            ops.cancel(writer, bad, NOW)
    ops.unpark(writer, 10, NOW)
    assert _rows(table)[10].parked_on is None and _rows(table)[10].attempts == 0
    with pytest.raises(ops.WrongState):
        ops.unpark(writer, 10, NOW)
    assert [ops.STATUS[e] for e in (ops.NotFound, ops.WrongState, ops.BadFilter)] == [404, 409, 400]
    some = ops.UnparkFilter.of({"destination": "topic-x", "parkedFrom": "2024-01-19T08:00:00-02:00", "parkedTo": "2024-01-19T12:30:00Z", "other": 1})
    ticks = iter([0.0, 1.0, 99.0])
    assert ops.unpark_all(writer, some, NOW, lambda: next(ticks)) == (2, True)  # of three in the range, one batch in time
    assert ops.unpark_all(writer, some, NOW) == (1, False) and ops.unpark_all(writer, ops.UnparkFilter.of({"destination": "topic-x"}), NOW) == (1, False)
    assert {i for i, r in _rows(table).items() if r.parked_on} == set()
    ticks = iter([0.0, 1.0, 99.0])
    done = ops.prune(writer, NOW, clock=lambda: next(ticks))
    assert (done.relayed, done.cancelled, done.more_to_prune) == (3, 0, True)  # a day in time
    done = ops.prune(writer, NOW)
    assert (done.relayed, done.cancelled, done.more_to_prune) == (0, 1, False) and set(_rows(table)) == {1, 2, *range(10, 15)}
    assert {r.state: r.rows for r in ops.pruned_counter(table).collect()} == {"relayed": 3, "cancelled": 1}


def test_commands_beside_a_relay(spark, tmp_path):
    """Cancels, unparks and prunes while passes and compactions run: none is lost, and no number is used twice."""
    settings = Settings(batch=10, sweep=timedelta(seconds=1))
    parked = [{"id": 500 + i, "parked_on": NOW - timedelta(hours=1), "attempts": 9} for i in range(8)]
    held = [{"id": 600 + i, "release_at": NOW + timedelta(days=1)} for i in range(8)]
    old = [{"id": 700 + i, "relayed_on": NOW - timedelta(days=9)} for i in range(5)]
    table = _table(spark, tmp_path, *({"id": i} for i in range(30)), *map(_key, range(100, 116)), *parked, *held, *old, settings=settings)
    relay = Relay(table, _ok, settings, slots=2, compact_after=6)
    relay.writer.compact()
    stream = spark.readStream.schema(outbox(spark, {"id": 1}).schema).parquet(f"file://{_folder(tmp_path, 'in')}")
    run = relay.start(stream, f"{tmp_path}/cp", clock=lambda: NOW)
    asked = {}
    for i in range(4):
        asked[ops.submit(table, "CANCEL", NOW, 600 + i)] = 200
        asked[ops.submit(table, "UNPARK", NOW, 500 + i)] = 200
    asked[ops.submit(table, "CANCEL", NOW, 4711)] = 404
    asked[ops.submit(table, "UNPARK", NOW, 601)] = 409
    asked[ops.submit(table, "FLY", NOW, 1)] = 400
    prune = ops.submit(table, "PRUNE", NOW)
    bulk = ops.submit(table, "UNPARK_ALL", NOW, wanted=ops.UnparkFilter("topic-x"))
    told = {c: ops.answer(table, c, 120) for c in [*asked, prune, bulk]}
    run.idle(120)
    run.stop()
    assert {c: told[c].status for c in asked} == asked and (told[prune].relayed, told[prune].more) == (5, False) and told[bulk].unparked == 4
    rows = _rows(table)
    assert table.version() > 1 and len(rows) == 62 and relay.writer.seq == Relay(table, _ok).writer.seq
    assert all(rows[i].relayed_on == NOW and rows[i].attempts == 0 for i in [*range(30), *range(100, 116), *range(500, 508)])
    assert all(bool(rows[600 + i].cancelled_on) == (i < 4) and rows[600 + i].relayed_on is None for i in range(8))
    assert table.log().where("id >= 0").groupBy("id", "seq").count().where("count > 1").isEmpty()
    # A command that comes again is neither done nor answered again.
    n = spark.read.parquet(f"file://{tmp_path}/outbox/answers").count()
    ops.execute(relay.writer, spark.read.schema(ops.COMMAND).parquet(f"file://{tmp_path}/outbox/inbox"), NOW)
    assert spark.read.parquet(f"file://{tmp_path}/outbox/answers").count() == n == len(asked) + 2


@pytest.mark.parametrize("body", [{}, {"destination": ""}, {"destination": False}, {"destination": "x", "reference": 1}, {"destination": "x", "parkedFrom": 1705708800}, {"destination": "x", "parkedFrom": "2024-01-20T00:00:00"}, {"destination": "x", "parkedTo": "yesterday"}, {"destination": ["x"]}, {"destination": {"x": 1}}, {"destination": "x", "parkedTo": "2024-01-20"}])
def test_bodies_of_a_bulk_unpark(body):
    with pytest.raises(ops.BadFilter):
        ops.UnparkFilter.of(body)


def _folder(tmp_path, name):
    (tmp_path / name).mkdir()
    return tmp_path / name


def test_stream_appends_once(spark, tmp_path):
    rows = outbox(spark, {"id": 1}, {"id": 2})
    rows.write.parquet(f"{tmp_path}/in/a")
    rows.write.parquet(f"{tmp_path}/in/b")  # the same rows again
    table = EventTable(spark, f"file://{tmp_path}/outbox")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in").dropDuplicates(["id"])
    relay = Relay(table, _failing_threes)
    run = relay.start(stream, f"{tmp_path}/cp", clock=lambda: NOW)
    run.idle()
    assert relay.gauges()["relay.running"] == 1
    run.stop()
    assert sorted((r.id, r.relayed_on) for r in table.read().collect()) == [(1, NOW), (2, NOW)] and relay.gauges()["relay.running"] == 0
    # The batch runs again: before and after a compaction, and after its rows were pruned.
    assert not relay.writer.append_once(rows, "appends", 0) and table.ledger() == {"appends": 0}
    assert not Writer(table).append_once(rows, "appends", 0)
    relay.writer.compact()
    assert not Writer(table).append_once(rows, "appends", 0) and len(_rows(table)) == 2
    assert ops.prune(relay.writer, NOW + timedelta(days=9)).relayed == 2
    assert not Writer(table).append_once(rows, "appends", 0) and table.read().isEmpty()
    # One that died before its mark is written again in its place.
    table.append_batch(rows, "appends", 1)
    assert Writer(table).append_once(rows, "appends", 1) and table.appended().count() == 2


def test_a_slow_ordered_batch_holds_up_no_concurrent_row(spark, tmp_path):
    kafka = Publisher("kafka", lambda rows: sinks.send_with(rows, lambda r: time.sleep(0.15)))
    table = _table(spark, tmp_path, *({"id": i} for i in range(100)))
    relay = Relay(table, publishers=(Publisher("http", _ok), kafka), settings=Settings(sweep=timedelta(seconds=1)))
    source = _folder(tmp_path, "in")
    stream = spark.readStream.schema(outbox(spark, {"id": 1}).schema).option("recursiveFileLookup", "true").parquet(f"file://{source}")
    run = relay.start(stream, f"{tmp_path}/cp", clock=lambda: NOW)
    while not any(p["lane"] == ORDERED and p["claimed"] for p in relay.passes):
        time.sleep(0.05)
    began = time.monotonic()
    outbox(spark, _key(1000)).write.mode("append").parquet(f"file://{source}/a")
    while not (table.there("new=0/appends-0") and 1000 in (rows := _rows(table)) and rows[1000].relayed_on):
        assert time.monotonic() - began < 14
        time.sleep(0.1)
    assert not _rows(table)[0].relayed_on  # the ordered batch is still being sent
    run.idle(90)
    run.stop()
    assert all(r.relayed_on for r in _rows(table).values())


def test_a_stop_keeps_its_grace(spark, tmp_path):
    kafka = Publisher("kafka", lambda rows: sinks.send_with(rows, lambda r: time.sleep(60)))
    table = _table(spark, tmp_path, {"id": 1}, {"id": 2})
    relay = Relay(table, publishers=(kafka,))
    stream = spark.readStream.schema(outbox(spark, {"id": 1}).schema).parquet(f"file://{_folder(tmp_path, 'in')}")
    run = relay.start(stream, f"{tmp_path}/cp")
    while not relay.passes:
        time.sleep(0.05)
    time.sleep(1)
    began = time.monotonic()
    run.stop(timedelta(seconds=2))
    assert time.monotonic() - began < 15
    rows = _rows(table)
    assert all(r.claimed_until is None and r.attempts == 0 and r.relayed_on is None for r in rows.values())
    assert Relay(table, _ok).drain() == 2


class _Receiver(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        self.seen.append((self.path, self.headers["x-idempotency-key"], self.rfile.read(int(self.headers["Content-Length"]))))
        self.send_response({"/ok": 204, "/moved": 302}.get(self.path, 500))
        self.send_header("Location", "/ok")
        self.end_headers()

    def log_message(self, *args):
        pass


def test_http_sink(spark):
    server = HTTPServer(("127.0.0.1", 0), _Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    rows = outbox(spark, {"id": 1, "destination": f"{url}/ok", "key_token": "t"}, {"id": 2, "destination": f"{url}/moved"}, {"id": 3, "destination": f"{url}/ok", "client_profile": "nobody"}, {"id": 4, "destination": f"{url}/no"})
    got = {r.id: r.outcome for r in sinks.send_http(rows).collect()}
    server.shutdown()
    assert got == {1: "OK", 2: "FAIL", 3: "TERMINAL", 4: "FAIL"}
    assert ("/ok", "service:outbox:1:t", b"{}") in _Receiver.seen
