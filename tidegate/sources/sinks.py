"""Sinks: what is sent, and how.  Delivery is at least once; receivers drop repeats by idempotency key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import scalars
from tidegate.model import DEFAULTS, Settings

#: took_us: the time of the send; interrupted: it ran into its bound.
OUTCOME = "id long, outcome string, error string, took_us long, interrupted boolean"
_COLUMNS = ["id", "outcome", "error", "took_us", "interrupted"]


def stamped_headers(rows: DataFrame, settings: Settings = DEFAULTS, fold_case: bool = False) -> DataFrame:
    """``rows`` with ``sent_headers``: stored headers, and the three the relay stamps in place of their namesakes."""
    key = scalars.idempotency_key(F.lit(settings.service), F.col("id"), F.col("key_token"))
    own = F.create_map(F.lit("x-event-type"), F.col("event_type"), F.lit("x-aggregate-type"), F.col("aggregate_type"), F.lit("x-idempotency-key"), key)
    return rows.withColumn("sent_headers", scalars.merged_headers(scalars.parsed_headers(F.col("headers")), own, fold_case))


def kafka_records(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(topic, key, value, headers) as Spark's Kafka sink takes them."""
    told = F.transform(F.map_entries("sent_headers"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")))
    return stamped_headers(rows, settings).select(F.col("destination").alias("topic"), F.col("aggregate_id").cast("binary").alias("key"), F.col("payload").cast("binary").alias("value"), told.alias("headers"))


def write_kafka(rows: DataFrame, servers: str, settings: Settings = DEFAULTS) -> None:
    """Needs Spark's Kafka package on the class path."""
    kafka_records(rows, settings).write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").save()


def http_client(profile: str | None, resolvers: Mapping[str, Mapping[str, str]]) -> Mapping[str, str]:
    """Extra headers of a named client profile; none for no name.  An unknown name raises: a terminal failure."""
    if profile is None:
        return {}
    if profile not in resolvers:
        raise LookupError(f"unknown client profile {profile}")
    return resolvers[profile]


def longest_prefix(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``rows`` (id, destination) with the profile of the longest prefix (prefix, profile) of the destination, or null.

    An equi-join on each prefix of a destination that has a listed length.
    """
    sizes = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]  # a client table's lengths
    tried = F.array(*[F.when(F.length("destination") >= n, F.substring("destination", 1, n)) for n in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    found = rows.select("id", F.explode(tried).alias("prefix")).join(prefixes, "prefix").groupBy("id").agg(F.max_by("profile", F.length("prefix")).alias("profile"))
    return rows.join(found, "id", "left")


def http_requests(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """What an HTTP send needs of rows: (id, destination, client_profile, payload, sent_headers, claimed_until)."""
    return stamped_headers(rows, settings, fold_case=True).select("id", "destination", "client_profile", "payload", "sent_headers", "claimed_until")


def http_poster(profiles: Mapping[str, Mapping[str, str]], timeout_s: float) -> Callable[..., tuple]:
    """A function of (id, destination, client_profile, payload, sent_headers) that posts a row and returns its outcome.

    Only 2xx is a success and no redirect is followed.
    """
    import time
    import urllib.error
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args, **kwargs):
            return None

    opener = urllib.request.build_opener(Stay)

    def post(id_, destination, profile, payload, headers) -> tuple:
        try:
            extra = http_client(profile, profiles)
        except LookupError as e:
            return (id_, "TERMINAL", f"LookupError: {e}", 0, False)
        began, late = time.monotonic(), False
        try:
            ask = urllib.request.Request(destination, (payload or "").encode(), {"Content-Type": "application/json", **dict(headers or {}), **extra}, method="POST")
            with opener.open(ask, timeout=timeout_s) as got:
                ok = 200 <= got.status < 300
                said = None if ok else f"HTTPError: {got.status}"
        except urllib.error.HTTPError as e:
            ok, said = False, f"HTTPError: {e.code}"
        except Exception as e:  # whatever a send raises is its outcome
            ok, said, late = False, f"{type(e).__name__}: {e}"[: scalars.ERROR_LENGTH], isinstance(e, TimeoutError)
        return (id_, "OK" if ok else "FAIL", said, int(1e6 * (time.monotonic() - began)), late)

    return post


def send_http(rows: DataFrame, profiles: Mapping[str, Mapping[str, str]] | None = None, timeout_s: float = 10.0, settings: Settings = DEFAULTS) -> DataFrame:
    """Posts each row's payload; returns (id, outcome, error).

    Runs where the rows are, in their partitions' order, whenever the result is evaluated: a
    lost task sends again.  :mod:`tidegate.sources.http_sink` stores what came of the sends.
    """
    known = dict(profiles or {})

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        post = http_poster(known, timeout_s)
        for pdf in batches:
            told = [post(r.id, r.destination, None if pd.isna(r.client_profile) else r.client_profile, r.payload, r.sent_headers) for r in pdf.itertuples()]
            yield pd.DataFrame(told, columns=_COLUMNS)

    return http_requests(rows, settings).drop("claimed_until").mapInPandas(run, OUTCOME)


def send_with(rows: DataFrame, publish: Callable[[dict], None], bound_s: float | None = None) -> DataFrame:
    """Outcomes of a Python publisher called for each row; what it raises is a failure, LookupError terminal.

    bound_s: a send that runs longer is left to itself and counts as interrupted; the next
    row goes on without it.
    """

    def run(batches: Iterator) -> Iterator:
        import threading
        import time

        import pandas as pd

        def send(r: dict) -> tuple:
            began = time.monotonic()
            told: tuple = ("OK", None)
            try:
                publish(r)
            except LookupError as e:
                told = ("TERMINAL", f"{type(e).__name__}: {e}")
            except Exception as e:  # whatever a send raises is its outcome
                told = ("FAIL", f"{type(e).__name__}: {e}"[: scalars.ERROR_LENGTH])
            return (r["id"], *told, int(1e6 * (time.monotonic() - began)), False)

        def bounded(r: dict) -> tuple:
            if bound_s is None:
                return send(r)
            got: list[tuple] = []
            worker = threading.Thread(target=lambda: got.append(send(r)), daemon=True)
            worker.start()
            worker.join(bound_s)
            return got[0] if got else (r["id"], "FAIL", f"InterruptedError: no answer in {bound_s} s", int(1e6 * bound_s), True)

        for pdf in batches:
            yield pd.DataFrame([bounded(r) for r in pdf.to_dict("records")], columns=_COLUMNS)

    return rows.mapInPandas(run, OUTCOME)
