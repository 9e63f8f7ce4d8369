"""Pauses and due times in keyed state: the same as by aggregates, over restarts, and at their time."""

import os
import time
from datetime import datetime, timedelta

from tidegate.model import Settings
from tidegate.streaming import control, stateful

VERDICT = "pod string, transport string, seq long, verdict string"


def _start(spark, stream, path):
    def on_batch(batch, _):
        batch.write.mode("append").parquet(f"{path}/out")

    with stateful.keyed_state(spark):
        return stream.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", f"{path}/cp").trigger(processingTime="1 second").start()


def _until(spark, path, holds, seconds=60):
    """Waits until what came out satisfies ``holds``: a query with timers never has nothing to do."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if os.path.isdir(f"{path}/out") and (rows := spark.read.schema(holds[0]).parquet(f"{path}/out").collect()) is not None and holds[1](rows):
            return rows
        time.sleep(0.5)
    raise TimeoutError


def _verdicts(n, start=0):
    kinds = ("failure", "success", None, "failure", "failure", "failure", "failure")
    return [(f"pod-{i % 3}", ("http", "kafka")[i % 2], i, kinds[i * 7919 % 7 if i % 3 else 3]) for i in range(start, start + n)]


def test_pauses_are_those_of_the_log_over_a_restart(spark, tmp_path):
    parts = [_verdicts(60), _verdicts(60, 60)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(VERDICT).parquet(f"{tmp_path}/in")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, VERDICT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = _start(spark, stateful.pause_stream(stream), tmp_path)
        last = {(p, t): max(s for q, u, s, v in part if (p, t) == (q, u) and v) for p, t, _, v in part if v}
        _until(spark, tmp_path, (stateful.PAUSE, lambda rows: all(any((r.pod, r.transport, r.seq) == (*k, n) for r in rows) for k, n in last.items())))
        query.stop()
        want = control.pauses(spark.createDataFrame(sum(parts[: k + 1], []), VERDICT))
        got = stateful.last_pauses(spark.read.parquet(f"{tmp_path}/out"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert any(r.paused for r in got.collect()) and any(r.begun for r in got.collect())


def test_probes_come_at_doubling_intervals(spark, tmp_path):
    settings = Settings(pause_after=2, pause_first=timedelta(seconds=1), pause_max=timedelta(seconds=2))
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("p", "kafka", i, "failure") for i in range(2)], VERDICT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = _start(spark, stateful.pause_stream(spark.readStream.schema(VERDICT).parquet(f"{tmp_path}/in"), settings), tmp_path)
    _until(spark, tmp_path, (stateful.PAUSE, lambda rows: sum(bool(r.probe) for r in rows) >= 2))
    spark.createDataFrame([("p", "kafka", 9, "success")], VERDICT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    n = sum(bool(r.probe) for r in _until(spark, tmp_path, (stateful.PAUSE, lambda rows: any(r.seq == 9 for r in rows))))
    time.sleep(3)
    query.stop()
    told = spark.read.parquet(f"{tmp_path}/out")
    assert told.where("probe").count() == n and not stateful.last_pauses(told).first().paused


def test_rows_leave_at_their_time(spark, tmp_path):
    schema = "id long, seq long, next_attempt_on timestamp, release_at timestamp"
    now, day = datetime.now(), timedelta(days=1)
    soon = now + timedelta(seconds=12)
    rows = [(1, 1, now - day, None), (2, 1, now - day, soon), (3, 1, soon, now - day), (4, 1, now - day, now + day), (5, 1, now + day, None), (5, 2, now - day, None), (6, 1, None, None)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame([*rows, *((i, 1, now - day, now + day) for i in range(100, 400))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = _start(spark, stateful.due_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), tmp_path)
    ids = lambda rows: sorted(r.id for r in rows)
    got = ids(_until(spark, tmp_path, (stateful.DUE, lambda rows: len(rows) >= 2)))
    assert got == [1, 5] or datetime.now() >= soon
    assert ids(_until(spark, tmp_path, (stateful.DUE, lambda rows: len(rows) >= 4))) == [1, 2, 3, 5] and datetime.now() >= soon
    # Cancelled while it waits: told with no time, it never leaves; told anew, at once.
    spark.createDataFrame([(4, 2, None, None), (100, 2, now - day, now - day)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert ids(_until(spark, tmp_path, (stateful.DUE, lambda rows: len(rows) >= 5))) == [1, 2, 3, 5, 100]
    read = sum(p["numInputRows"] for p in query.recentProgress)
    query.stop()
    assert read == spark.read.schema(schema).parquet(f"{tmp_path}/in").count()  # waiting rows are read once
