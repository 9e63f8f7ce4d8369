"""The HTTP sink as Spark's data source: outcomes by commit, retried tasks, repeated batches, bookings."""

import os
import threading
from collections import Counter
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tests.test_rules import outbox
from tidegate.model import OUTBOX
from tidegate.plans.tables import EventTable, Writer
from tidegate.sources import http_sink, sinks
from tidegate.streaming.publishers import Publisher
from tidegate.streaming.relay import Relay

NOW = datetime(2024, 1, 20)
LEASE = NOW + timedelta(minutes=1)


@pytest.fixture
def receiver():
    seen = Counter()

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            seen[self.headers["x-idempotency-key"]] += 1
            self.send_response({"/ok": 204, "/moved": 302}.get(self.path, 500))
            self.send_header("Location", "/ok")
            self.end_headers()

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def _leased(spark, url, ids, **more):
    paths = ("ok", "moved", "no")
    return outbox(spark, *[{"id": i, "destination": f"{url}/{paths[i % 3]}", "claimed_until": LEASE, "next_attempt_on": LEASE, **more} for i in ids])


def test_outcomes_of_a_table(spark, receiver, tmp_path):
    url, seen = receiver
    send = http_sink.sender(f"file://{tmp_path}/out", {"known": {"x-a": "b"}})
    rows = _leased(spark, url, range(20)).withColumn("client_profile", F.when(F.col("id") == 3, "nobody").when(F.col("id") == 6, "known"))
    got = send(rows.repartition(4))
    want = {i: "TERMINAL" if i == 3 else "OK" if i % 3 == 0 else "FAIL" for i in range(20)}
    for _ in range(2):  # evaluated again, nothing is sent again
        assert {r.id: r.outcome for r in got.collect()} == want
    assert sum(seen.values()) == 19
    assert {r.stamp for r in got.collect()} == {LEASE}
    assert {r.id: r.outcome for r in http_sink.outcomes(spark, f"file://{tmp_path}/out").collect()} == want
    plain = {r.id: r.outcome for r in sinks.send_http(rows, {"known": {"x-a": "b"}}).collect()}
    assert plain == want
    assert send(rows.where("false")).count() == 0
    with pytest.raises(Exception, match="outcomes"):
        sinks.http_requests(rows).write.format(http_sink.FORMAT).mode("append").save()
    with pytest.raises(Exception, match="missing: claimed_until"):
        sinks.http_requests(rows).drop("claimed_until").write.format(http_sink.FORMAT).mode("append").option("outcomes", f"file://{tmp_path}/out").save()


def test_uncommitted_files_and_repeated_batches_count_for_nothing(spark, receiver, tmp_path):
    """A task that ran twice wrote two files: the one its message names is listed, and a batch is listed once."""
    url, _ = receiver
    folder = f"file://{tmp_path}/out"
    rows = [r.asDict() for r in sinks.http_requests(_leased(spark, url, range(6))).collect()]
    schema = sinks.http_requests(_leased(spark, url, [1])).schema
    writer = http_sink._StreamWriter({"outcomes": folder}, schema)
    lost, first, again = writer.write(iter(rows[:3])), writer.write(iter(rows[:3])), writer.write(iter(rows[3:]))
    assert len({lost.file, first.file, again.file}) == 3
    writer.commit([first, None, writer.write(iter([]))], 0)
    writer.commit([again], 0)
    assert sorted(r.id for r in http_sink.outcomes(spark, folder).collect()) == [0, 1, 2]
    writer.abort([again, None], 1)
    assert not os.path.exists(f"{tmp_path}/out/outcomes/{again.file}")
    writer.commit([], 2)
    assert http_sink.outcomes(spark, folder).count() == 3


def test_a_stream_is_sent_and_booked(spark, receiver, tmp_path):
    url, seen = receiver
    table = EventTable(spark, f"file://{tmp_path}/outbox")
    table.append(_leased(spark, url, range(12)))
    # Row 99's lease has ended since: what came of it has no effect.
    table.append(_leased(spark, url, [99], attempts=1).withColumn("claimed_until", F.lit(NOW)))
    folder = f"file://{tmp_path}/out"
    os.makedirs(f"{tmp_path}/in")
    os.makedirs(f"{tmp_path}/out/batches")
    stream = spark.readStream.schema(OUTBOX).parquet(f"{tmp_path}/in")
    writer = Writer(table)
    sent = 0
    for ids in (range(6), [*range(6, 12), 99]):  # the second time both queries go on from their checkpoints
        _leased(spark, url, ids).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sending = http_sink.stream_to(stream, folder, f"{tmp_path}/cp-send")
        sending.processAllAvailable()
        sending.stop()
        booking = http_sink.book(writer, folder, f"{tmp_path}/cp-book")
        booking.processAllAvailable()
        booking.stop()
        sent += len(ids)
        assert sum(seen.values()) == sent
    rows = {r.id: r for r in table.read().collect()}
    for i in range(12):
        assert (rows[i].relayed_on is not None) == (i % 3 == 0)
        assert rows[i].attempts == (0 if i % 3 == 0 else 1) and rows[i].claimed_until is None
    assert rows[99].attempts == 1 and rows[99].claimed_until == NOW
    # Booked once more, nothing changes.
    http_sink.book(writer, folder, f"{tmp_path}/cp-again").processAllAvailable()
    assert {r.id: (r.attempts, r.relayed_on) for r in table.read().collect()} == {i: (r.attempts, r.relayed_on) for i, r in rows.items()}
    for q in spark.streams.active:
        q.stop()


def test_a_relay_sends_through_the_sink(spark, receiver, tmp_path):
    url, seen = receiver
    table = EventTable(spark, f"file://{tmp_path}/outbox")
    table.append(outbox(spark, *[{"id": i, "destination": f"{url}/ok", "lane": "CONCURRENT", "ordering_key": f"k{i % 3}"} for i in range(10)]))
    relay = Relay(table, publishers=(Publisher("http", http_sink.sender(f"file://{tmp_path}/out")),))
    assert relay.drain(NOW) == 10
    assert all(r.relayed_on is not None for r in table.read().collect())
    assert len(seen) == 10 and set(seen.values()) == {1}
