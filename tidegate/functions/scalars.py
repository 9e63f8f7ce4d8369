"""Scalar rules as column expressions, all in generated code; plain Python where a driver needs one."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.model import CONCURRENT, DEFAULTS, Settings

_MS = timedelta(milliseconds=1)
UNCLASSIFIED = "unclassified"
KIND_LENGTH = 200
ERROR_LENGTH = 4000
KEY_LENGTH = 255
# HTTP-status exception names that don't end in Exception or Error.
HTTP_STATUS_NAMES = (
    "BadGateway", "BadRequest", "Conflict", "Forbidden", "GatewayTimeout", "Gone", "InternalServerError", "MethodNotAllowed",
    "NotAcceptable", "NotFound", "NotImplemented", "ServiceUnavailable", "TooManyRequests", "Unauthorized",
    "UnprocessableContent", "UnprocessableEntity", "UnsupportedMediaType",
)


def backoff_ms(attempts: Column, settings: Settings = DEFAULTS) -> Column:
    """Milliseconds until the next try after ``attempts`` failures (at least 1, else an error): base * factor^(n-1), capped."""
    grown = F.lit(settings.backoff_base / _MS) * F.pow(F.lit(settings.backoff_factor), attempts.cast("double") - 1)
    ms = F.least(grown, F.lit(settings.backoff_cap / _MS)).cast("long")
    return F.when(attempts >= 1, ms).otherwise(F.raise_error(F.lit("attempts must be at least 1")).cast("long"))


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def fitted_key(key: Column) -> Column:
    """An ordering key that fits its column: blank is none, a long one becomes its SHA-256."""
    long_key = F.concat(F.lit("sha256:"), F.sha2(key, 256))
    return F.when(F.trim(key) == "", None).when(utf16_length(key) <= KEY_LENGTH, key).otherwise(long_key)


def is_http(destination: Column) -> Column:
    return destination.startswith("http://") | destination.startswith("https://")


def route(destination: Column) -> Column:
    """The first publisher that takes a destination."""
    return F.when(is_http(destination), F.lit("http")).otherwise(F.lit("kafka"))


def lane_of(destination: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(is_http(destination), F.lit(CONCURRENT)).otherwise(F.lit(settings.kafka_lane))


def key_of(destination: Column, aggregate_id: Column, settings: Settings = DEFAULTS) -> Column:
    """Ordering key of the concurrent lane: the URL, or the aggregate where topics are sent concurrently and by it."""
    by_aggregate = settings.kafka_lane == CONCURRENT and settings.kafka_key == "AGGREGATE_ID"
    return fitted_key(F.when(is_http(destination), destination).otherwise(aggregate_id if by_aggregate else F.lit(None).cast("string")))


def own_lease_s(destination: Column, settings: Settings = DEFAULTS) -> Column:
    """The lease a publisher names, in seconds: none for HTTP and for topics on the ordered lane."""
    kafka = settings.kafka_lease.total_seconds() if settings.kafka_lane == CONCURRENT else None
    return F.when(~is_http(destination), F.lit(kafka).cast("double"))


def idempotency_key(service: Column, row_id: Column, token: Column) -> Column:
    return F.concat_ws(":", service, F.lit("outbox"), row_id, token)


def merged_headers(stored: Column, stamped: Column, fold_case: bool = False) -> Column:
    """Stored headers without those that a stamped one replaces, then the stamped ones (maps of strings).

    fold_case: header names match whatever their case, as HTTP's do.
    """
    name = (lambda k: F.lower(k)) if fold_case else (lambda k: k)
    taken = F.transform(F.map_keys(stamped), name)
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(taken, name(k)))
    return F.map_concat(kept, stamped)


def parsed_headers(headers: Column) -> Column:
    return F.from_json(headers, "map<string,string>")


def failure_text(type_name: Column, message: Column) -> Column:
    """``Type: message``, or the type alone; at most ERROR_LENGTH characters."""
    return F.substring(F.when(message.isNull(), type_name).otherwise(F.concat(type_name, F.lit(": "), message)), 1, ERROR_LENGTH)


def failure_kind(error: Column) -> Column:
    """The exception type an error text begins with, ``unclassified`` for other texts, null for none."""
    token = F.substring_index(error, ":", 1)
    shape = r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*\z"
    simple = F.regexp_extract(token, r"([^.$]*)\z", 1)
    throwable = simple.endswith("Exception") | simple.endswith("Error") | simple.isin(*HTTP_STATUS_NAMES)
    good = (F.length(token) <= KIND_LENGTH) & token.rlike(shape) & throwable
    return F.when(error.isNull(), None).when(good, token).otherwise(UNCLASSIFIED)


def sanitized_destination(destination: Column) -> Column:
    """A URL as scheme://host[:port], no user, path, query or fragment; ``unparsed`` if it is none; a topic as it is."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@\s]*@)?([A-Za-z0-9._-]+|\[[0-9A-Fa-f:.]+\])(:[0-9]*)?(?:[/?#][^\s]*)?\z"
    part = lambda k: F.regexp_extract(destination, shape, k)
    port = F.when(part(3) == ":", "").otherwise(part(3))
    url = F.when(destination.rlike(shape), F.concat(part(1), F.lit("://"), part(2), port)).otherwise(F.lit("unparsed"))
    return F.when(destination.isNull(), "null").when(~destination.contains("://"), destination).otherwise(url)


def has_trace(headers: Column) -> Column:
    """Whether a header map carries a trace context, whatever its name's case."""
    return F.coalesce(F.exists(F.map_keys(headers), lambda k: F.lower(k) == "traceparent"), F.lit(False))


def transport_down(causes: Column) -> Column:
    """Whether an array of exception class names, outermost first, says that the transport is out of reach."""
    last = lambda c: F.substring_index(F.substring_index(c, ".", -1), "$", -1)
    return F.coalesce(F.exists(causes, lambda c: last(c).rlike("Retriable") | last(c).endswith("TimeoutException")), F.lit(False))


def send_bound(lease: timedelta, send_timeout: timedelta) -> timedelta:
    return max(lease, send_timeout)


def http_timeouts(bound: timedelta, connect: timedelta | None = None, read: timedelta | None = None) -> tuple[timedelta, timedelta]:
    """(connect, read) that end before the bound; positive, or an error."""
    connect = min(timedelta(seconds=10), bound / 4) if connect is None else connect
    read = bound - connect - max(bound / 10, timedelta(seconds=1)) if read is None else read
    if connect <= timedelta(0) or read <= timedelta(0) or connect + read >= bound:
        raise ValueError("HTTP timeouts must be positive and end before the send bound")
    return connect, read


def kafka_bounds(delivery_ms: int = 120_000, linger_ms: int = 5, block_ms: int = 60_000, transactional: bool = False, settings: Settings = DEFAULTS) -> tuple[timedelta, timedelta]:
    """(wait for an acknowledgement, whole send) from producer settings."""
    wait = max((delivery_ms + linger_ms) * _MS + timedelta(seconds=1), settings.send_timeout)
    return wait, max(wait + block_ms * _MS * (3 if transactional else 1), settings.send_timeout)
