"""The HTTP sink as a data source of Spark, ``tidegate_http``, for tables and streams.

``df.write.format("tidegate_http")`` or ``df.writeStream.format("tidegate_http")`` posts rows
of :func:`~tidegate.sources.sinks.http_requests`.  Options: ``outcomes``, a shared folder;
``timeout_s``; ``profiles``, JSON of client profiles; for tables ``batch``, a name.

Outcomes don't pass the driver: each task writes its own to a file, in parts, and its commit
message names the file.  A commit lists the files of its batch, so outcomes of tasks that
failed, or ran twice, are in no list.  A batch that Spark runs again sends again (delivery
is at least once) and keeps its first list.  :func:`book` writes them to the log of a table:
an outcome counts only under the lease its row was sent with, so whatever is booked twice
has no second effect.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidegate.model import DEFAULTS, Settings
from tidegate.plans.tables import Writer
from tidegate.sources.sinks import OUTCOME, http_poster, http_requests

FORMAT = "tidegate_http"
#: stamp: the lease a row was sent under; ended: when its send did.
STORED = f"{OUTCOME}, stamp timestamp, ended timestamp"
_LISTED = "batch string, file string, rows long"
#: Outcomes that a task holds before it writes them.
PART = 10_000


@dataclass
class Sent(WriterCommitMessage):
    file: str
    rows: int


class _Posting:
    """What both kinds of writer do."""

    def __init__(self, options: Mapping[str, str], schema: StructType):
        if not options.get("outcomes"):
            raise ValueError(f"{FORMAT} needs the option outcomes, a folder that driver and executors share")
        missing = {"id", "destination", "client_profile", "payload", "sent_headers", "claimed_until"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"{FORMAT} takes rows of http_requests; missing: {', '.join(sorted(missing))}")
        self.folder, self.name = options["outcomes"].rstrip("/"), options.get("batch") or uuid.uuid4().hex
        self.timeout_s, self.profiles = float(options.get("timeout_s", "10")), json.loads(options.get("profiles", "{}"))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.parquet as pq

        kinds = pa.schema([
            ("id", pa.int64()), ("outcome", pa.string()), ("error", pa.string()), ("took_us", pa.int64()), ("interrupted", pa.bool_()),
            ("stamp", pa.timestamp("us", "UTC")), ("ended", pa.timestamp("us", "UTC")),
        ])
        post, held, n = http_poster(self.profiles, self.timeout_s), [], 0
        files, base = self._files()
        files.create_dir(f"{base}/outcomes", recursive=True)
        file = f"{uuid.uuid4().hex}.parquet"  # each attempt of a task has its own
        utc = lambda t: None if t is None else t.astimezone(UTC)
        with files.open_output_stream(f"{base}/outcomes/{file}") as out, pq.ParquetWriter(out, kinds) as writer:
            part = lambda: writer.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in held], schema=kinds))
            for r in iterator:
                held.append((*post(r["id"], r["destination"], r["client_profile"], r["payload"], r["sent_headers"]), utc(r["claimed_until"]), datetime.now(UTC)))
                n += 1
                if len(held) == PART:
                    part()
                    held.clear()
            part()
        return Sent(file, n)

    def _listed(self, messages: list, batch: str) -> None:
        """Lists a batch's files under its name, whole or not at all; a batch that has a list keeps it."""
        from pyarrow import fs

        files, base = self._files()
        files.create_dir(f"{base}/batches", recursive=True)
        files.create_dir(f"{base}/_new", recursive=True)
        to, new = f"{base}/batches/{batch}.json", f"{base}/_new/{uuid.uuid4().hex}"
        if files.get_file_info(to).type != fs.FileType.NotFound:
            return
        with files.open_output_stream(new) as out:
            for m in messages:
                if m is not None and m.rows:
                    out.write((json.dumps({"batch": batch, "file": m.file, "rows": m.rows}) + "\n").encode())
        files.move(new, to)

    def _dropped(self, messages: list) -> None:
        files, base = self._files()
        for m in messages:
            if m is not None:
                files.delete_file(f"{base}/outcomes/{m.file}")


class _TableWriter(_Posting, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._listed(messages, self.name)

    def abort(self, messages: list) -> None:
        self._dropped(messages)


class _StreamWriter(_Posting, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803  Spark's name
        self._listed(messages, f"{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._dropped(messages)


class HttpSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError(f"{FORMAT} only appends: what was sent can't be replaced")
        return _TableWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802  Spark's name
        return _StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSink)


def _of(spark: SparkSession, folder: str, lists: DataFrame) -> DataFrame:
    """The outcomes in the files of ``lists``, one a task."""
    names = [f"{folder}/outcomes/{r['file']}" for r in lists.collect()]
    return spark.read.schema(STORED).parquet(*names) if names else spark.createDataFrame([], STORED)


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, id, outcome, error, took_us, interrupted, stamp, ended) of all batches committed to a folder."""
    listed = spark.read.schema(_LISTED).json(f"{folder}/batches").select("batch", "file")
    found = spark.read.schema(STORED).parquet(f"{folder}/outcomes").withColumn("file", F.col("_metadata.file_name"))
    return found.join(listed, "file").drop("file")


def sender(folder: str, profiles: Mapping[str, Mapping[str, str]] | None = None, timeout_s: float = 10.0, settings: Settings = DEFAULTS) -> Callable[[DataFrame], DataFrame]:
    """A publisher's sender: rows go when it is called, and what it returns is read from files, however often."""

    def send(rows: DataFrame) -> DataFrame:
        spark, name = rows.sparkSession, uuid.uuid4().hex
        register(spark)
        told = {"outcomes": folder, "batch": name, "timeout_s": str(timeout_s), "profiles": json.dumps(profiles or {})}
        http_requests(rows, settings).write.format(FORMAT).mode("append").options(**told).save()
        return _of(spark, folder, spark.read.schema(_LISTED).json(f"{folder}/batches/{name}.json"))

    return send


def stream_to(rows: DataFrame, folder: str, checkpoint: str, profiles: Mapping[str, Mapping[str, str]] | None = None, timeout_s: float = 10.0, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Posts a stream of leased rows as it comes."""
    register(rows.sparkSession)
    told = {"outcomes": folder, "timeout_s": str(timeout_s), "profiles": json.dumps(profiles or {}), "checkpointLocation": checkpoint}
    return http_requests(rows, settings).writeStream.format(FORMAT).outputMode("append").options(**told).start()


def book(writer: Writer, folder: str, checkpoint: str) -> StreamingQuery:
    """Books outcomes into a table's log as batches of the sink are committed; ``folder`` has had one before."""
    spark = writer.table.spark
    kind = F.when(F.col("outcome") == "OK", "RELAYED").otherwise("FAILED")

    def on_lists(lists: DataFrame, _: int) -> None:
        found = _of(spark, folder, lists)
        writer.book(found, kind, F.col("ended"), stamp=F.col("stamp"), error=F.col("error"), terminal=F.col("outcome") == "TERMINAL")

    return spark.readStream.schema(_LISTED).json(f"{folder}/batches").writeStream.foreachBatch(on_lists).option("checkpointLocation", checkpoint).start()
