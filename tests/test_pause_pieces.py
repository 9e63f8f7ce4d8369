"""The pause stream holds no key's events in one task: ranges of them are counted first, and join exactly."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_stateful import VERDICT
from tidegate.model import Settings
from tidegate.streaming import control, stateful


class _State:
    def __init__(self):
        self.value, self.timers = None, []

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, value: setattr(self, "value", value)
    listTimers = lambda self: list(self.timers)
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)
    getCurrentProcessingTimeInMs = lambda self: 1000


@pytest.mark.parametrize("after", [0, 1, 3])
def test_pieces_join_to_what_single_events_come_to(after):
    """Against the rule event by event, over several batches cut into ranges anyhow."""
    dice = random.Random(after)
    for _ in range(200):
        settings = Settings(pause_after=after)
        state = _State()
        p = stateful._Pauses(settings)
        p.handle = p.state = state
        failures, paused, begun, seq = 0, False, 0, 0
        for _ in range(3):
            events = [(seq + i, dice.random() < 0.3) for i in range(dice.randint(1, 12))]
            seq += len(events)
            for _, good in events:
                failures, paused = (0, False) if good else (failures + 1, paused)
                if not good and after and not paused and failures >= after:
                    paused, begun = True, begun + 1
            cuts = sorted({0, len(events), *(dice.randint(0, len(events)) for _ in range(3))})
            pieces = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = dice.sample(events[lo:hi], hi - lo)
                batch = pa.RecordBatch.from_arrays([pa.array([None] * len(part), pa.string()), pa.array(["t"] * len(part)), pa.array([s for s, _ in part], pa.int64()), pa.array([g for _, g in part])], schema=stateful._EVENT)
                pieces += [r for b in stateful._pieces(after)(iter([batch])) for r in b.to_pylist()]
            assert len(pieces) == len(cuts) - 1
            (told,) = p.handleInputRows(("p", "t"), iter(dice.sample(pieces, len(pieces))), state)
            assert (told.failures, told.paused, told.begun, told.seq) == (failures, paused, begun, seq - 1)
            assert not paused or state.timers == [1000 + p.first]


def test_a_key_gets_a_row_of_each_range(spark, tmp_path, monkeypatch):
    """20,000 events of one key in four ranges: its state sees four rows (before: 20,000)."""
    seen = f"{tmp_path}/seen"

    class Counted(stateful._Pauses):
        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            with open(seen, "a") as f:
                f.write(f"{len(rows)}\n")
            return super().handleInputRows(key, iter(rows), timerValues)

    monkeypatch.setattr(stateful, "_Pauses", Counted)
    i = F.col("id")
    log = spark.range(20_000).select(F.lit("p").alias("pod"), F.lit("kafka").alias("transport"), i.alias("seq"), F.when(i * 7919 % 11 < 2, "success").when(i % 5 > 0, "failure").alias("verdict"))
    log.write.parquet(f"{tmp_path}/in")
    stream = stateful.pause_stream(spark.readStream.schema(VERDICT).parquet(f"{tmp_path}/in"), slices=4)
    stateful.after_one_batch(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = stateful.last_pauses(spark.read.schema(stateful.PAUSE).parquet(f"{tmp_path}/out"))
    assert list(map(tuple, got.collect())) == list(map(tuple, control.pauses(log).collect()))
    with open(seen) as f:
        assert [int(n) for n in f] == [4]
