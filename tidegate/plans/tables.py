"""The outbox as Parquet datasets in a shared folder, and intermediate results there."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator, Mapping
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.model import DEFAULTS, OUTBOX, Settings, at, conform
from tidegate.operators.transitions import LOG, entries, fold, folding


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset, one in the warehouse.

    A warehouse on the driver's own disk is shared in local mode alone.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_checkpoints"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def settled(df: DataFrame, label: str = "settled") -> DataFrame:
    """``df`` written to the shared folder, and a scan of it.

    Computed once for several uses; what follows survives the loss of any executor and never
    computes ``df`` again.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone; the folder stays for whoever keeps the shared store
            return


#: Entries that no row has and compactions carry on: where the concurrent claim goes on, up to
#: which instant rows are pruned, and the last batch of each stream that was appended.
CURSOR, PRUNED, APPENDED = "CURSOR", "PRUNED", "APPENDED"
_COUNTED = T.StructType([T.StructField("destination", T.StringType()), T.StructField("relayed", T.LongType()), T.StructField("dropped", T.LongType())])
_CLOSED = T.StructType([*OUTBOX.fields, T.StructField("version", T.IntegerType()), T.StructField("state", T.StringType()), T.StructField("day", T.DateType())])


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows of the driver's as a table, by Arrow, so that no Python worker reads them."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "integer": pa.int32(), "short": pa.int16(), "string": pa.string(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
    plain = lambda v: v.astimezone(UTC) if isinstance(v, datetime) else v
    columns = [pa.array([plain(r[k]) for r in rows], kinds[f.dataType.typeName()]) for k, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that plans lose; an empty list would be an RDD, scanned by tasks with Python workers."""
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


class EventTable:
    """An outbox in a shared folder, as Parquet datasets that only grow between compactions.

    ``base=N`` are its live rows as of version N, ``new=N`` rows appended and ``log=N`` the
    transitions booked since; ``counted=N`` sums up what was relayed and dropped before.  Rows that a compaction finds relayed, or cancelled without a
    lease, are final and move to ``closed``, by version, state and day; version N counts
    once its base has Spark's success mark.  Claims scan live rows only (:meth:`live`), so
    their cost doesn't grow with what was ever relayed.  A prune moves one instant and drops
    whole days.  One :class:`Writer` at a time.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULTS, policies: Mapping[str, Settings] | None = None):
        self.spark, self.path, self.settings, self.policies = spark, path.rstrip("/"), settings, dict(policies or {})
        self._steps: tuple = ()
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{name}"))] if self.there(name) else []

    def version(self) -> int:
        return max((int(n[5:]) for n in self._names() if n.startswith("base=") and self.there(f"{n}/_SUCCESS")), default=0)

    def _part(self, name: str, schema: T.StructType, version: int) -> DataFrame:
        name = f"{name}={version}"
        if not self.there(name):
            return no_rows(self.spark, schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        return self._part("log", LOG, self.version())

    def appended(self) -> DataFrame:
        """Live rows as they were written: their transitions since are not in them."""
        v = self.version()
        return self._part("base", OUTBOX, v).unionByName(self._part("new", OUTBOX, v))

    def live(self) -> DataFrame:
        """All rows but those in ``closed``; the log is folded into the rows it names, the others are scanned as they are."""
        same, changed = self._parted()
        return same.unionByName(changed.drop("effective"))

    def _parted(self) -> tuple[DataFrame, DataFrame]:
        """Live rows that the log doesn't name, and those it does, folded."""
        rows, log = self.appended(), self.log().where("id >= 0")
        named = log.select("id").distinct()
        return rows.join(named, "id", "left_anti"), self.folded(rows.join(named, "id", "left_semi"), log)

    def _ended(self, changed: DataFrame) -> DataFrame:
        """Folded rows with ``_by``: the kind of the entry that came last of those that took effect."""
        kinds = self.log().groupBy("id", F.col("seq").alias("_seq")).agg(F.first("kind").alias("_by"))
        return changed.withColumn("_seq", F.try_element_at("effective", F.lit(-1))).join(kinds, ["id", "_seq"], "left").drop("_seq", "effective")

    def _counted(self, rows: DataFrame) -> DataFrame:
        """The counters after the bookings that ended ``rows`` (destination, relayed_on, _by)."""
        is_ = lambda kind: F.count_if(F.col("_by") == kind)
        more = rows.where("relayed_on IS NOT NULL AND _by IS NOT NULL").groupBy("destination").agg(is_("RELAYED").alias("relayed"), is_("FAILED").alias("dropped"))
        both = self._part("counted", _COUNTED, self.version()).unionByName(more)
        return both.groupBy("destination").agg(F.sum("relayed").alias("relayed"), F.sum("dropped").alias("dropped"))

    def counters(self) -> DataFrame:
        """(destination, relayed, dropped) of all bookings there were, of rows pruned since too; what exhaustion dropped isn't relayed.

        A sum kept with each version, and the bookings since.  Rows that came in relayed don't count.
        """
        return self._counted(self._ended(self._parted()[1]))

    def folded(self, rows: DataFrame, log: DataFrame) -> DataFrame:
        key = tuple(self.policies.items())
        if not self._steps or self._steps[0] != key:
            self._steps = (key, folding(self.settings, self.policies))
        return fold(rows, log, self.settings, self.policies, self._steps[1])

    def closed(self) -> DataFrame:
        """Final rows, with the partition columns version, state and day."""
        if not self.there("closed"):
            return no_rows(self.spark, _CLOSED)
        return self.spark.read.schema(_CLOSED).parquet(f"{self.path}/closed").where(F.col("version") <= self.version())

    def read(self) -> DataFrame:
        until = self.pruned_until()
        rows = self.live().unionByName(_since(self.closed(), until).select(*OUTBOX.names))
        return rows if until is None else rows.where(_unpruned(until))

    def append(self, rows: DataFrame) -> None:
        conform(rows).write.mode("append").parquet(f"{self.path}/new={self.version()}")

    def append_batch(self, rows: DataFrame, source: str, batch: int) -> None:
        """Rows of a stream's batch, in a place of their own: writing them again replaces them."""
        conform(rows).write.mode("overwrite").parquet(f"{self.path}/new={self.version()}/{source}-{batch}")

    def book(self, entries: DataFrame) -> None:
        entries.write.mode("append").parquet(f"{self.path}/log={self.version()}")

    def last_seq(self) -> int:
        return self.log().agg(F.max("seq")).first()[0] or 0

    def _marks(self) -> list:
        """The last mark of each kind (and stream): a few rows."""
        found = self.log().where("id < 0").groupBy("kind", F.when(F.col("kind") == APPENDED, F.substring_index("error", "\t", 1)).alias("of"))
        return found.agg(F.max_by("error", "seq").alias("told"), F.max("at").alias("at")).collect()

    def cursor(self) -> str | None:
        """The last booked cursor of the concurrent claim."""
        return next((m["told"] for m in self._marks() if m["kind"] == CURSOR), None)

    def pruned_until(self) -> datetime | None:
        return next((m["at"] for m in self._marks() if m["kind"] == PRUNED), None)

    def ledger(self) -> dict[str, int]:
        """The last batch that was appended of each stream."""
        told = (m["told"].split("\t") for m in self._marks() if m["kind"] == APPENDED)
        return {source: int(batch) for source, batch in told}

    def compact(self, seq: int | None = None) -> int:
        """Writes the next version: closes final rows, and folds the log into the others.

        The marks go along, under ``seq``, and are there before the version counts.  The base
        before stays for running readers.
        """
        v, marks, seq = self.version(), self._marks(), self.last_seq() if seq is None else seq
        until = next((m["at"] for m in marks if m["kind"] == PRUNED), None)
        same, changed = self._parted()
        every = same.withColumn("_by", F.lit(None).cast("string")).unionByName(self._ended(changed))
        rows = settled(every, "compacted")
        self._counted(rows).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counted={v + 1}")
        rows = rows.drop("_by")
        rows = rows if until is None else rows.where(_unpruned(until))
        final = F.col("relayed_on").isNotNull() | (F.col("cancelled_on").isNotNull() & F.col("claimed_until").isNull())
        state = F.when(F.col("relayed_on").isNotNull(), "relayed").otherwise("cancelled")
        done = rows.where(final).withColumns({"state": state, "day": F.to_date(F.coalesce("relayed_on", "cancelled_on"))})
        done.repartition("state", "day", F.pmod("id", F.lit(8))).write.mode("overwrite").partitionBy("state", "day").parquet(f"{self.path}/closed/version={v + 1}")
        self.remove(f"new={v + 1}")
        self.remove(f"log={v + 1}")
        if marks:
            told = [(-1, seq, m["kind"], m["at"], None, None, None, m["told"], None) for m in marks]
            local_rows(self.spark, told, LOG).coalesce(1).write.parquet(f"{self.path}/log={v + 1}")
        conform(rows.where(~final)).write.mode("overwrite").parquet(f"{self.path}/base={v + 1}")
        for old in range(max(0, v - 2), v):
            for name in ("base", "new", "log", "counted"):
                self.remove(f"{name}={old}")
        return v + 1

    def days(self) -> list[date]:
        """Days that have closed rows."""
        found = {d for v in self._names("closed") if v.startswith("version=") for s in self._names(f"closed/{v}") if s.startswith("state=") for d in self._names(f"closed/{v}/{s}") if d.startswith("day=")}
        return sorted(date.fromisoformat(d[4:]) for d in found)

    def drop_days(self, before: date) -> None:
        """Removes the partitions of days before one."""
        for v in self._names("closed"):
            for s in self._names(f"closed/{v}") if v.startswith("version=") else ():
                for d in self._names(f"closed/{v}/{s}") if s.startswith("state=") else ():
                    if d.startswith("day=") and date.fromisoformat(d[4:]) < before:
                        self.remove(f"closed/{v}/{s}/{d}")


def _unpruned(until: datetime) -> Column:
    keep = lambda c: F.col(c).isNull() | (F.col(c) >= at(until))
    return keep("relayed_on") & keep("cancelled_on")


def _since(closed: DataFrame, until: datetime | None) -> DataFrame:
    """Closed rows without the days that are pruned whole."""
    return closed if until is None else closed.where(F.col("day") >= F.lit(until.date()))


class _Ticket:
    """Entries that wait to be written, and how that went."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.done, self.error = rows, False, None


class Writer:
    """The only one who books into a table: one counter for the log, one lock for all threads.

    A relay has one, and whoever else wants something done beside it sends a command (see
    :mod:`tidegate.streaming.ops`).  foreign: how often rows changed by others than lanes.
    """

    def __init__(self, table: EventTable):
        self.table, self.lock = table, threading.RLock()
        self.seq, self.ledger, self.foreign = table.last_seq(), table.ledger(), 0
        self._waiting: list[_Ticket] = []
        self._gate = threading.Lock()
        self._held: list[_Ticket] | None = None
        self.writes = 0

    def book(self, rows: DataFrame, kind: str | Column, when: Column, **values: Column) -> int:
        """Entries of one kind for a table's rows, under the next number."""
        with self.lock:
            self.seq += 1
            self.foreign += 1
            self.table.book(entries(rows, self.seq, kind, when, **values).coalesce(1))
            return self.seq

    def book_rows(self, rows: list[tuple]) -> None:
        """Entries (id, kind, at, stamp, until, since, error, terminal) of the driver's rows; returns when they are stored, or within :meth:`together` at once.

        What several threads book meanwhile is one write.
        """
        mine = _Ticket(rows)
        with self._gate:
            self._waiting.append(mine)
        with self.lock:
            if self._held is not None:
                self._held.append(mine)
                return
            if not mine.done and mine.error is None:
                self._write()
        if mine.error is not None:
            raise mine.error

    @contextlib.contextmanager
    def together(self) -> Iterator[None]:
        """What a thread books within, with the lock, is stored as one write at the end; the table doesn't tell of it before."""
        with self.lock:
            if self._held is not None:
                yield
                return
            self._held = held = []
            try:
                yield
            finally:
                self._held = None
                if any(not t.done and t.error is None for t in held):
                    self._write()
            for t in held:
                if t.error is not None:
                    raise t.error

    def _write(self) -> None:
        """Stores what waits."""
        with self._gate:
            tickets, self._waiting = self._waiting, []
        told = []
        for t in tickets:
            self.seq += 1
            told += [(r[0], self.seq, *r[1:]) for r in t.rows]
        try:
            self.table.book(local_rows(self.table.spark, told, LOG).coalesce(1))
            self.writes += 1
            for t in tickets:
                t.done = True
        except BaseException as e:
            for t in tickets:
                t.error = e

    def mark(self, kind: str, told: str | None = None, when: datetime | None = None) -> None:
        self.book_rows([(-1, kind, when, None, None, None, told, None)])

    def append(self, rows: DataFrame) -> None:
        with self.lock:
            self.table.append(rows)

    def append_once(self, rows: DataFrame, source: str, batch: int) -> bool:
        """Appends a stream's batch unless it was before; reads no table, so rows pruned since stay away too."""
        with self.lock:
            if batch <= self.ledger.get(source, -1):
                return False
            self.table.append_batch(rows, source, batch)
            self.mark(APPENDED, f"{source}\t{batch}")
            self.ledger[source] = batch
            return True

    def compact(self) -> int:
        """Nothing is booked while the log is folded, so nothing is lost."""
        with self.lock:
            return self.table.compact(self.seq)

    def prune(self, cutoff: datetime, within: timedelta | None = None, clock=None) -> tuple[int, int, bool]:
        """(relayed, cancelled, whether rows are left) of a prune, day by day until its time is over.

        Rows before an instant are gone once it is booked; days that are pruned whole are
        then dropped as partitions, the rest of a day with the next compaction.
        """
        with self.lock:
            self.foreign += 1
            table, before = self.table, self.table.pruned_until()
            until = F.lit(cutoff)
            stamp = F.when(F.col("relayed_on") < until, F.col("relayed_on")).when(F.col("cancelled_on") < until, F.col("cancelled_on"))
            state = F.when(F.col("relayed_on") < until, "relayed").otherwise("cancelled")
            old = _since(table.closed(), before).where(F.col("day") <= F.lit(cutoff.date())).select(*OUTBOX.names).unionByName(table.live())
            old = old if before is None else old.where(_unpruned(before))
            counts = old.select(state.alias("state"), F.to_date(stamp).alias("day")).where("day IS NOT NULL").groupBy("state", "day").agg(F.count(F.lit(1)).alias("n")).collect()
            end = None if within is None else clock() + within.total_seconds()
            done = {"relayed": 0, "cancelled": 0}
            for day in sorted({c["day"] for c in counts}):
                if end is not None and clock() >= end:
                    return done["relayed"], done["cancelled"], True
                reached = min(cutoff, datetime.combine(day + timedelta(days=1), datetime.min.time()))
                self.mark(PRUNED, when=reached)
                for c in counts:
                    if c["day"] == day:
                        done[c["state"]] += c["n"]
                table.drop_days(reached.date())
            return done["relayed"], done["cancelled"], False
