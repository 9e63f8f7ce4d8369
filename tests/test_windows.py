"""What a relay's look serves: the rows behind heads too, in their keys' order, and what passes write."""

from collections import defaultdict
from datetime import timedelta

from pyspark.sql import functions as F

from tests.test_relay import NOW, _failing_threes, _ok, _rows, _table
from tidegate.model import CONCURRENT, ORDERED, Settings
from tidegate.operators import claims
from tidegate.streaming.relay import Relay


def _keyed(n, keys, **more):
    return [{"id": i, "lane": "CONCURRENT", "ordering_key": f"k{i % keys}", "destination": "https://h/x", **more} for i in range(n)]


def _counting(relay):
    """How often each lane looks, and the waves' rows in order."""
    looks, sent = defaultdict(int), []
    look, learn = relay._look, relay._learn
    relay._look = lambda now, lane: (looks.__setitem__(lane, looks[lane] + 1), look(now, lane))[1]
    relay._learn = lambda mine, *a: (sent.append([(c.key, c.id) for c in mine.values()]), learn(mine, *a))[1]
    return looks, sent


def test_a_look_serves_the_rows_behind_heads(spark, tmp_path):
    settings = Settings(batch=4)
    table = _table(spark, tmp_path, *_keyed(24, 3), settings=settings)
    relay = Relay(table, _failing_threes, settings)
    looks, sent = _counting(relay)
    passes = 0
    while n := relay.run_pass(CONCURRENT, NOW):  # one row of each key, eight times
        assert n == 3
        passes += 1
    assert passes == 8 and looks[CONCURRENT] == 2  # before: nine
    assert all(len({k for k, _ in wave}) == len(wave) for wave in sent)
    for key in ("k0", "k1", "k2"):
        ids = [i for wave in sent for k, i in wave if k == key]
        assert ids == sorted(ids) and len(ids) == 8
    assert all(bool(r.relayed_on) == (i % 3 != 0) and r.attempts == (i % 3 == 0) for i, r in _rows(table).items())


def test_a_row_that_is_due_again_goes_before_those_behind_it(spark, tmp_path):
    table = _table(spark, tmp_path, *_keyed(3, 1), {"id": -5, "lane": "CONCURRENT", "ordering_key": "k0", "destination": "https://h/x", "next_attempt_on": NOW + timedelta(seconds=20)})
    relay = Relay(table, _failing_threes)
    _, sent = _counting(relay)
    after = lambda s: NOW + timedelta(seconds=s)
    relay.run_pass(CONCURRENT, NOW)  # 0 fails, for five seconds
    relay.run_pass(CONCURRENT, after(1))
    relay.run_pass(CONCURRENT, after(6))  # 0 again, not 2
    assert [w[0][1] for w in sent] == [0, 1, 0]
    relay = Relay(table, _failing_threes)
    _, sent = _counting(relay)
    relay.run_pass(CONCURRENT, after(7))
    relay.run_pass(CONCURRENT, after(20))  # due by now: -5, not 0 whose turn it is too
    assert [w[0][1] for w in sent] == [2, -5]


def test_rows_given_back_hold_those_behind_them(spark, tmp_path):
    table = _table(spark, tmp_path, *_keyed(4, 2))
    relay = Relay(table, _ok)
    mine = relay.claim(NOW, CONCURRENT)
    assert [c.id for c in mine] == [0, 1] and relay.claim(NOW, CONCURRENT) == []  # their keys are in flight
    relay.give_back(mine, NOW)
    assert [c.id for c in relay.claim(NOW, CONCURRENT)] == [0, 1]


def test_followers_are_next_to_their_heads(spark, tmp_path):
    rows = _table(spark, tmp_path, *_keyed(12, 3), {"id": 50, "lane": "CONCURRENT", "ordering_key": "k0", "destination": "https://h/x", "next_attempt_on": NOW + timedelta(seconds=9)}).read()
    got = claims.followers(rows, NOW, 100, 2).select("ordering_key", "id", "_rank", "_again").collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(f"k{k}", k + 3 * n, n) for k in range(3) for n in (1, 2)]
    assert {r[3] for r in got if r[0] == "k0"} == {NOW + timedelta(seconds=9)} and {r[3] for r in got if r[0] != "k0"} == {None}
    assert sorted(r.id for r in claims.followers(rows, NOW, 3, 3).collect()) == [3, 4, 5]


def test_an_ordered_pass_is_one_write(spark, tmp_path):
    settings = Settings(batch=3)
    lapsed = {"claimed_until": NOW - timedelta(minutes=1), "sending_since": NOW - timedelta(minutes=2)}
    table = _table(spark, tmp_path, *({"id": i, **(lapsed if i % 4 == 0 else {})} for i in range(12)), settings=settings)
    relay = Relay(table, _ok, settings)
    looks, _ = _counting(relay)
    assert relay.drain(NOW) == 12 and relay.writer.writes == 5 and looks[ORDERED] == 2  # before: twelve writes
    assert [r.relayed_on is None for _, r in sorted(_rows(table).items())] == [i % 4 == 0 for i in range(12)]


def test_what_is_not_there_is_no_scan(spark, tmp_path):
    table = _table(spark, tmp_path, {"id": 1})
    plan = table.appended().where(F.col("id") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Union" not in plan
    assert table.log().isEmpty() and table.closed().isEmpty() and table.counters().isEmpty()
