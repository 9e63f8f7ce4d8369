"""Pauses and due times as keyed state of streams: each key's state and timers are in Spark's state store.

A restart from the checkpoint goes on with what was there.  Timers are of processing time:
the store finds those that have come without looking at the others.
"""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegate.model import DEFAULTS, Settings

#: A pause after some events: ``probe`` where its time for one has come, else null.
PAUSE = "pod string, transport string, seq long, failures int, paused boolean, begun int, probe boolean"
#: A range of a key's events: failures before its first success, successes, failures after the last one, and how many runs after the first success begin a pause.
PIECE = "pod string, transport string, from_seq long, seq long, first long, good long, last long, begun long"
DUE = "id long, due_on timestamp"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class _Pauses(StatefulProcessor):
    """``after`` failures in a row begin a pause, a success ends it; while it lasts, a probe's time comes at doubling intervals."""

    def __init__(self, settings: Settings):
        self.after, self.first, self.most = settings.pause_after, int(settings.pause_first.total_seconds() * 1000), int(settings.pause_max.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pause", "failures int, paused boolean, begun int, wait_ms long, seq long")

    def _wait(self, now_ms: int, wait_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now_ms + wait_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        failures, paused, begun, wait_ms, seq = self.state.get() if self.state.exists() else (0, False, 0, 0, -1)
        for p in sorted(rows, key=lambda p: p["from_seq"]):
            seq, failures, begins = max(seq, p["seq"]), failures + p["first"], False
            if self.after and p["first"] and not paused and failures >= self.after:
                paused, begun, begins = True, begun + 1, True
            if p["good"]:
                failures, begun = p["last"], begun + p["begun"]
                paused = begins = bool(self.after) and failures >= self.after
            if begins:
                wait_ms = self.first
                self._wait(timerValues.getCurrentProcessingTimeInMs(), wait_ms)
        self.state.update((failures, paused, begun, wait_ms, seq))
        yield Row(pod=key[0], transport=key[1], seq=seq, failures=failures, paused=paused, begun=begun, probe=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        failures, paused, begun, wait_ms, seq = self.state.get()
        if paused:
            wait_ms = min(2 * wait_ms, self.most)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait_ms)
            self.state.update((failures, paused, begun, wait_ms, seq))
            yield Row(pod=key[0], transport=key[1], seq=seq, failures=failures, paused=True, begun=begun, probe=True)

    def close(self) -> None:
        pass


def _pieces(after: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns a partition's events into one piece for each key: its own runs of failures as counts, the first and the last by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = pa.Table.from_batches(list(batches), schema=_EVENT)
        if not events.num_rows:
            return
        code = np.zeros(len(events), dtype=np.int64)
        for name in ("pod", "transport"):
            values = pc.dictionary_encode(events[name].combine_chunks(), null_encoding="encode")
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            code = code * len(values.dictionary) + values.indices.to_numpy(zero_copy_only=False)
        seq, good = events["seq"].to_numpy(), events["good"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((good, seq, code))
        code, seq, good = code[order], seq[order], good[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        told = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(code)], strict=True):
            # Failures between successes: the run before the first, those between, and the one after the last.
            at = np.flatnonzero(good[lo:hi])
            runs = np.diff(np.r_[-1, at, hi - lo]) - 1
            begun = int((runs[1:] >= after).sum()) if after else 0
            told.append((int(order[lo]), int(seq[lo]), int(seq[hi - 1]), int(runs[0]), len(at), int(runs[-1]) if len(at) else 0, begun))
        rows, *columns = zip(*told, strict=True)
        own = events.select(["pod", "transport"]).take(pa.array(rows))
        yield from pa.table([*own.columns, *(pa.array(c, pa.int64()) for c in columns)], names=_PIECE).to_batches()

    return run


_EVENT = pa.schema([("pod", pa.string()), ("transport", pa.string()), ("seq", pa.int64()), ("good", pa.bool_())])
_PIECE = [c.split()[0] for c in PIECE.split(", ")]


def pause_stream(verdicts: DataFrame, settings: Settings = DEFAULTS, slices: int | None = None) -> DataFrame:
    """The pauses of (pod, transport) over a stream of (pod, transport, seq, verdict): a row after each batch that has events, and one at each probe's time.

    verdict: as :func:`~tidegate.streaming.control.verdict` tells; null verdicts count for
    nothing.  Of a batch, a key's events count in order of seq.  A batch is cut into ranges
    of seq (``slices``; else as many as Spark shuffles into), each a task that counts its
    runs; a key's state takes a row of each range, so no task holds a key's events.  Start
    the query within :func:`keyed_state`.
    """
    good = F.col("verdict") == "success"
    events = verdicts.where(F.col("verdict").isin("success", "failure")).select(F.col("pod").cast("string"), F.col("transport").cast("string"), F.col("seq").cast("long"), good.alias("good"))
    dealt = events.repartitionByRange("seq") if slices is None else events.repartitionByRange(slices, "seq")
    pieces = dealt.mapInArrow(_pieces(settings.pause_after), PIECE)
    return pieces.groupBy("pod", "transport").transformWithState(_Pauses(settings), PAUSE, "Update", "ProcessingTime")


def last_pauses(told: DataFrame) -> DataFrame:
    """(pod, transport, failures, paused, begun) as the latest of a pause stream's rows say."""
    last = told.groupBy("pod", "transport").agg(F.max(F.struct("seq", "begun", "failures", "paused")).alias("s"))
    return last.select("pod", "transport", "s.failures", "s.paused", "s.begun")


class _Due(StatefulProcessor):
    """A row waits for its time; a later word on it replaces the earlier one, a null time ends the wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("due", "due_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: r["seq"])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due, now = last["due_us"], timerValues.getCurrentProcessingTimeInMs()
        if due is None:
            self.state.clear()
        elif due <= 1000 * now:
            self.state.clear()
            yield Row(id=key[0], due_us=due)
        else:
            self.state.update((due,))
            self.handle.registerTimer(-(-due // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            due = self.state.get()[0]
            self.state.clear()
            yield Row(id=key[0], due_us=due)

    def close(self) -> None:
        pass


def due_stream(rows: DataFrame) -> DataFrame:
    """(id, due_on) of rows at the time they are due, over a stream of (id, seq, next_attempt_on, release_at).

    A row that is held or backs off costs nothing until then: no sweep looks at it.  A row
    told again (its next attempt, say) waits for the new time; null in both columns ends its
    wait.  Start the query within :func:`keyed_state`.
    """
    due = F.unix_micros(F.greatest("next_attempt_on", "release_at")).alias("due_us")
    waits = rows.select("id", "seq", due).groupBy("id").transformWithState(_Due(), "id long, due_us long", "Update", "ProcessingTime")
    return waits.select("id", F.timestamp_micros("due_us").alias("due_on"))


def after_one_batch(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what a stream with timers tells of all that is there, and ends it: by itself it never has nothing to do."""
    done = threading.Event()

    def on_batch(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(out)
        done.set()

    with keyed_state(stream.sparkSession):
        query = stream.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    while query.isActive and not done.wait(0.2):
        pass
    if (error := query.exception()) is not None:
        raise error
    query.stop()
