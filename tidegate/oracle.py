"""SQL for DuckDB that says what each registered query returns, over the same Parquet tables."""

from __future__ import annotations

#: The fixture tables of tidegate.sources.fixtures, as common table expressions.
BASE = """
WITH ev AS (SELECT *, event_id AS e, event_id % 10 < 4 AS http, event_id % 5 < 3 AS done, epoch_us(ts) AS us, md5(CAST(event_id AS VARCHAR)) AS m FROM events),
k AS (SELECT epoch_us(TIMESTAMP '2024-01-20 00:00:00') AS now),
outbox AS (
  SELECT e + 1 AS id, 'user' AS aggregate_type, CAST(user_id AS VARCHAR) AS aggregate_id, event_type,
    CASE WHEN http THEN 'https://hub/' || user_id ELSE 'topic-' || event_type END AS destination,
    CASE WHEN http AND e % 19 = 0 THEN 'profile-' || (e % 3) END AS client_profile,
    props AS payload,
    CASE WHEN e % 6 = 1 THEN '{"TraceParent":"00-' || e || '","x-kind":"a"}' END AS headers,
    us AS created_on, CAST(e % 4 AS INTEGER) AS attempts, us + (e % 3600) * 1000000 AS next_attempt_on,
    CASE WHEN done THEN us + (e % 120) * 1000000 END AS relayed_on,
    CASE WHEN e % 4 > 0 THEN (['java.io.IOException: refused', 'org.example.client.HttpError$ServiceUnavailable: 503', 'receiver said no', 'TimeoutException', 'a.b.: broken', 'Ann Smith: hello'])[e % 6 + 1] END AS last_error,
    CASE WHEN e % 11 = 0 THEN us + 86400000000 END AS release_at,
    CASE WHEN e % 23 = 0 OR e % 39 = 13 THEN us + 60000000 END AS cancelled_on,
    CASE WHEN e % 17 = 0 AND NOT done THEN us + 3600000000 END AS parked_on,
    CASE WHEN e % 7 < 3 THEN 'sub-' || (e % 7) END AS reference,
    CASE WHEN e % 13 = 0 AND NOT done THEN now + (e % 7 - 3) * 60000000 END AS claimed_until,
    CASE WHEN e % 7 <> 0 THEN CASE WHEN http THEN 'CONCURRENT' ELSE 'ORDERED' END END AS lane,
    CASE WHEN e % 7 <> 0 AND http AND e % 3 <> 0 THEN 'https://hub/' || user_id END AS ordering_key,
    CASE WHEN e % 2 = 0 AND e % 13 = 0 AND NOT done THEN now + (e % 7 - 3) * 60000000 - 60000000 END AS sending_since,
    CASE WHEN e % 4 <> 0 THEN substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) END AS key_token
  FROM ev, k),
o AS (
  SELECT outbox.*, now,
    relayed_on IS NULL AND cancelled_on IS NULL AND parked_on IS NULL AS is_open,
    lane IS NOT DISTINCT FROM 'CONCURRENT' AS conc,
    coalesce(relayed_on IS NULL AND claimed_until > now, false) AS leased
  FROM outbox, k),
d AS (SELECT * FROM o WHERE is_open AND next_attempt_on <= now AND coalesce(release_at <= now, true) AND coalesce(claimed_until <= now, true)),
heads AS (
  SELECT ordering_key, min(id) AS id FROM d WHERE conc AND ordering_key IS NOT NULL
    AND ordering_key NOT IN (SELECT ordering_key FROM o WHERE leased AND conc AND ordering_key IS NOT NULL)
  GROUP BY 1),
del0 AS (
  SELECT id - 1 AS e, *, 0 AS again FROM outbox WHERE (id - 1) % 5 < 3 OR (id - 1) % 10 = 7
  UNION ALL SELECT id - 1 AS e, *, 1 AS again FROM outbox WHERE (id - 1) % 29 = 0),
del1 AS (
  SELECT id AS row_id, destination, ordering_key, coalesce(lane, 'ORDERED') AS lane, 'pod-' || (e % 3) AS pod, CAST(1 + e % 2 + again AS INTEGER) AS attempt,
    created_on + (e % 120) * 500000 + again * 30000000 + CASE WHEN e % 37 = 0 THEN 259200000000 ELSE 0 END AS s, e, again,
    (['OK', 'OK', 'OK', 'HANG', 'HOLD', 'OK', 'DEAF', 'FAIL', 'OK', 'TERMINAL'])[e % 10 + 1] AS outcome, e % 50 = 0 AS interrupted
  FROM del0),
log AS (
  SELECT *, s + (e * 7919 % 4000) * 1000 + CASE WHEN e % 31 = 0 THEN 180000000 ELSE 0 END + CASE WHEN e % 29 = 0 AND again = 0 THEN 45000000 ELSE 0 END AS f,
    NOT interrupted AND outcome IN ('OK', 'HANG', 'HOLD', 'DEAF') AS ok,
    CASE WHEN lane = 'CONCURRENT' THEN 120000000 ELSE 15000000 END AS lease
  FROM del1),
pods(pod, started, stopped, slots, killed) AS (VALUES
  ('pod-0', epoch_us(TIMESTAMP '2024-01-01'), NULL, 2, false), ('pod-1', epoch_us(TIMESTAMP '2024-01-01'), NULL, 1, false),
  ('pod-2', epoch_us(TIMESTAMP '2024-01-02'), epoch_us(TIMESTAMP '2024-01-15'), 2, true)),
outages(lo, hi) AS (VALUES (epoch_us(TIMESTAMP '2024-01-03'), epoch_us(TIMESTAMP '2024-01-03 06:00:00')), (epoch_us(TIMESTAMP '2024-01-10 12:00:00'), epoch_us(TIMESTAMP '2024-01-10 13:00:00')))
"""

_UNKEYED = "SELECT ordering_key, id FROM d WHERE conc AND ordering_key IS NULL ORDER BY id LIMIT {n}"
_FIRST = "SELECT * FROM (SELECT * FROM heads {where} ORDER BY ordering_key LIMIT {n})"
_KIND = """CASE WHEN last_error IS NULL THEN NULL WHEN length(split_part(last_error, ':', 1)) <= 200
  AND regexp_full_match(split_part(last_error, ':', 1), '[A-Za-z_$][A-Za-z0-9_$]*(\\.[A-Za-z_$][A-Za-z0-9_$]*)*')
  AND (regexp_matches(split_part(last_error, ':', 1), '(Exception|Error)$')
    OR regexp_matches(split_part(last_error, ':', 1), '(^|[.$])(BadGateway|BadRequest|Conflict|Forbidden|GatewayTimeout|Gone|InternalServerError|MethodNotAllowed|NotAcceptable|NotFound|NotImplemented|ServiceUnavailable|TooManyRequests|Unauthorized|UnprocessableContent|UnprocessableEntity|UnsupportedMediaType)$'))
  THEN split_part(last_error, ':', 1) ELSE 'unclassified' END"""
_FREE = """, lanes(lane) AS (VALUES ('concurrent'), ('ordered')),
chg0 AS (
  SELECT CASE WHEN lane = 'CONCURRENT' THEN 'concurrent' ELSE 'ordered' END AS lane, pod, s AS tm, 1 AS dl FROM log
  UNION ALL SELECT CASE WHEN lane = 'CONCURRENT' THEN 'concurrent' ELSE 'ordered' END, pod, f, -1 FROM log
  UNION ALL SELECT lanes.lane, pod, started, 0 FROM pods, lanes
  UNION ALL SELECT lanes.lane, pod, coalesce(stopped, now), 0 FROM pods, lanes, k),
chg AS (SELECT lane, pod, tm, sum(dl) AS dl FROM chg0 GROUP BY lane, pod, tm),
lvl AS (SELECT lane, pod, tm, sum(dl) OVER (PARTITION BY lane, pod ORDER BY tm) AS busy, lead(tm) OVER (PARTITION BY lane, pod ORDER BY tm) AS nxt FROM chg),
free0 AS (
  SELECT lane, greatest(tm, started) AS lo, least(nxt, coalesce(stopped, now)) AS hi FROM lvl JOIN pods USING (pod), k
  WHERE busy < CASE WHEN lane = 'concurrent' THEN slots ELSE 1 END AND nxt IS NOT NULL),
free1 AS (SELECT * FROM free0 WHERE lo < hi),
isl0 AS (SELECT *, max(hi) OVER (PARTITION BY lane ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM free1),
isl1 AS (SELECT *, sum(CASE WHEN upto IS NULL OR lo > upto THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM isl0),
isl AS (SELECT lane, min(lo) AS lo, max(hi) AS hi FROM isl1 GROUP BY lane, g)"""

QUERIES: dict[str, str] = {
    "s2_scan_page": "SELECT id, destination, created_on FROM o WHERE relayed_on IS NULL AND cancelled_on IS NULL ORDER BY id LIMIT 50 OFFSET 100",
    "s3_point_lookup": "SELECT id, destination, attempts, next_attempt_on FROM o WHERE id = 42",
    "s1_append": """SELECT e + 1000001 AS id, CASE WHEN http THEN 'https://hub/' || user_id ELSE 'topic-' || event_type END AS destination,
      CASE WHEN http THEN 'CONCURRENT' ELSE 'ORDERED' END AS lane, CASE WHEN http THEN 'https://hub/' || user_id END AS ordering_key,
      now AS created_on, now AS next_attempt_on, CAST(0 AS INTEGER) AS attempts, '{"x-n":"' || e || '"}' AS headers, m AS key_token FROM ev, k""",
    "s5_kafka_records": """SELECT id, destination AS topic, aggregate_id AS key, CASE WHEN headers IS NULL THEN 3 ELSE 5 END AS n_headers,
      'service:outbox:' || id || coalesce(':' || key_token, '') AS idempotency FROM o WHERE destination LIKE 'topic-%' AND is_open""",
    "s8_client_profile": """SELECT id, CASE WHEN starts_with(destination, 'https://hub/1') THEN 'ones' WHEN starts_with(destination, 'https://') THEN 'any' END AS profile FROM o""",
    "c1_ordered_claim": "SELECT id, destination, attempts FROM d WHERE NOT conc ORDER BY id LIMIT 100",
    "c1_ordered_claim_10": "SELECT id, destination, attempts FROM d WHERE NOT conc ORDER BY id LIMIT 10",
    "c2_keys_in_flight": "SELECT DISTINCT ordering_key FROM o WHERE leased AND conc AND ordering_key IS NOT NULL",
    "c3_open_keys": "SELECT ordering_key, min(id) AS id FROM o WHERE is_open AND conc AND ordering_key > 'https://hub/3' GROUP BY 1",
    "c4_heads": _FIRST.format(where="", n=10),
    "c4_heads_after": _FIRST.format(where="WHERE ordering_key > 'https://hub/3'", n=100),
    "c5_unkeyed": _UNKEYED.format(n=10),
    "c6_concurrent_claim": f"SELECT id, ordering_key FROM (({_FIRST.format(where='', n=10)}) UNION ALL ({_UNKEYED.format(n=10)})) ORDER BY id LIMIT 10",
    "c6_concurrent_claim_after": f"SELECT id, ordering_key FROM (({_FIRST.format(where="WHERE ordering_key > 'https://hub/3'", n=100)}) UNION ALL ({_UNKEYED.format(n=100)})) ORDER BY id LIMIT 100",
    "c7_wrap_claim": f"SELECT id, ordering_key FROM ({_FIRST.format(where="WHERE ordering_key <= 'https://hub/3'", n=10)}) ORDER BY id LIMIT 10",
    "c8_head_keys": f"SELECT ordering_key FROM ({_FIRST.format(where="WHERE ordering_key > 'https://hub/3'", n=10)})",
    "c9_cursor": f"""
      SELECT 'start' AS pass, count(*) AS claimed, max(ordering_key) AS next_cursor, false AS wrapped FROM (SELECT * FROM (({_FIRST.format(where='', n=10)}) UNION ALL ({_UNKEYED.format(n=10)})) ORDER BY id LIMIT 10)
      UNION ALL SELECT 'middle', count(*), coalesce(max(ordering_key), 'https://hub/3'), false FROM (SELECT * FROM (({_FIRST.format(where="WHERE ordering_key > 'https://hub/3'", n=10)}) UNION ALL ({_UNKEYED.format(n=10)})) ORDER BY id LIMIT 10)
      UNION ALL SELECT 'wrap', (SELECT count(*) FROM heads) + (SELECT count(*) FROM d WHERE conc AND ordering_key IS NULL), (SELECT max(ordering_key) FROM heads WHERE ordering_key <= 'https://hub/3'), true""",
    "c11_recheck": "SELECT id, ordering_key FROM heads",
    "c12_surviving": f"""SELECT id, ordering_key FROM (({_FIRST.format(where='', n=100)}) UNION ALL ({_UNKEYED.format(n=100)}))
      WHERE ordering_key IS NULL OR CAST(split_part(ordering_key, '/', 4) AS BIGINT) % 2 = 0""",
    "c13_not_queued": f"SELECT id, ordering_key FROM ({_UNKEYED.format(n=100)}) WHERE id % 3 <> 0",
    "c14_lease_stamp": """SELECT id, now + 15000000 AS claimed_until, now + 15000000 AS next_attempt_on, claimed_until IS NOT NULL AND sending_since IS NOT NULL AS was_lapsed FROM d WHERE NOT conc ORDER BY id LIMIT 100""",
    "c15_lease_length": "SELECT id, CASE WHEN id % 5 = 0 THEN 30000000 WHEN conc THEN 120000000 ELSE 15000000 END AS lease_us FROM o",
    "c16_lapsed": "SELECT id FROM d WHERE claimed_until IS NOT NULL AND sending_since IS NOT NULL",
    "c17_skip_window": """SELECT id FROM (SELECT * FROM d WHERE NOT conc ORDER BY id LIMIT 200) WHERE destination NOT LIKE 'topic-%' OR greatest(next_attempt_on, coalesce(release_at, next_attempt_on)) < now - 60000000 ORDER BY id LIMIT 20""",
    "c18_may_take": """SELECT id, NOT (destination LIKE 'topic-%') OR greatest(next_attempt_on, coalesce(release_at, next_attempt_on)) < now - 60000000 OR (id % 2 = 0 AND attempts = 0) AS takes FROM d""",
    "t1_book_relayed": """SELECT id, CASE WHEN claimed_until IS NOT NULL AND relayed_on IS NULL AND id % 3 <> 0 THEN now ELSE relayed_on END AS relayed_on,
      CASE WHEN claimed_until IS NOT NULL AND relayed_on IS NULL AND id % 3 <> 0 THEN NULL ELSE claimed_until END AS claimed_until,
      CASE WHEN claimed_until IS NOT NULL AND relayed_on IS NULL AND id % 3 <> 0 THEN now ELSE next_attempt_on END AS next_attempt_on FROM o""",
    "t1_refused": "SELECT id FROM o WHERE claimed_until IS NOT NULL AND (relayed_on IS NOT NULL OR id % 3 = 0)",
    "t2_book_failed": """SELECT id, CASE WHEN hit THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN hit THEN 'E: x' ELSE last_error END AS last_error,
      CASE WHEN hit AND NOT stop AND spent THEN now ELSE parked_on END AS parked_on,
      CASE WHEN NOT hit THEN next_attempt_on WHEN stop OR spent THEN now ELSE now + CAST(least(5000 * pow(2, attempts), 600000) AS BIGINT) * 1000 END AS next_attempt_on
      FROM (SELECT *, claimed_until IS NOT NULL AND relayed_on IS NULL AS hit, cancelled_on IS NOT NULL AS stop, id % 5 = 0 OR attempts + 1 >= 3 AS spent FROM o)""",
    "t4_drop": "SELECT id, CASE WHEN claimed_until IS NOT NULL AND relayed_on IS NULL AND cancelled_on IS NULL AND attempts + 1 >= 3 THEN now ELSE relayed_on END AS relayed_on FROM o",
    "t7_renew": """SELECT id, CASE WHEN NOT hit THEN claimed_until WHEN cancelled_on IS NULL THEN now + 60000000 END AS claimed_until, CASE WHEN NOT hit THEN sending_since WHEN cancelled_on IS NULL THEN now END AS sending_since,
      CASE WHEN NOT hit THEN next_attempt_on WHEN cancelled_on IS NULL THEN now + 60000000 ELSE now END AS next_attempt_on FROM (SELECT *, claimed_until IS NOT NULL AND relayed_on IS NULL AS hit FROM o)""",
    "t8_heartbeat": """SELECT id, now + 60000000 AS claimed_until, coalesce(sending_since, now - 5000000) AS sending_since FROM o WHERE claimed_until IS NOT NULL AND relayed_on IS NULL""",
    "t9_release": "SELECT id, now AS next_attempt_on, claimed_until IS NOT NULL AND false AS still_leased FROM o WHERE claimed_until IS NOT NULL AND relayed_on IS NULL",
    "t10_cancel": """SELECT id, CASE WHEN relayed_on IS NOT NULL THEN 'already relayed' WHEN cancelled_on IS NOT NULL THEN 'already cancelled' WHEN claimed_until > now THEN 'in flight' ELSE 'cancelled' END AS verdict,
      CASE WHEN relayed_on IS NULL AND cancelled_on IS NULL AND coalesce(claimed_until <= now, true) THEN now ELSE cancelled_on END AS cancelled_on FROM o""",
    "t11_unpark": """SELECT id, CASE WHEN relayed_on IS NOT NULL THEN 'already relayed' WHEN cancelled_on IS NOT NULL THEN 'cancelled' WHEN parked_on IS NULL THEN 'not parked' ELSE 'unparked' END AS verdict,
      CASE WHEN relayed_on IS NULL AND cancelled_on IS NULL AND parked_on IS NOT NULL THEN 0 ELSE attempts END AS attempts FROM o""",
    "t12_unpark_batch": """SELECT id, parked_on FROM o WHERE parked_on IS NOT NULL AND relayed_on IS NULL AND cancelled_on IS NULL AND destination = 'topic-click' AND reference = 'sub-0'
      AND parked_on >= epoch_us(TIMESTAMP '2024-01-05') AND parked_on < epoch_us(TIMESTAMP '2024-01-19') ORDER BY parked_on, id LIMIT 20""",
    "t13_prune_relayed": "SELECT id, relayed_on FROM o WHERE relayed_on < epoch_us(TIMESTAMP '2024-01-13') ORDER BY relayed_on, id LIMIT 500",
    "t14_prune_cancelled": "SELECT id, cancelled_on FROM o WHERE cancelled_on < epoch_us(TIMESTAMP '2024-01-13') ORDER BY cancelled_on, id LIMIT 50",
    "t15_prunable": """SELECT CASE WHEN relayed_on < epoch_us(TIMESTAMP '2024-01-13') THEN 'relayed' ELSE 'cancelled' END AS state, count(*) AS n FROM o
      WHERE relayed_on < epoch_us(TIMESTAMP '2024-01-13') OR cancelled_on < epoch_us(TIMESTAMP '2024-01-13') GROUP BY 1""",
    "t15_after_prune": "SELECT count(*) AS n FROM o WHERE coalesce(relayed_on >= epoch_us(TIMESTAMP '2024-01-13'), true) AND coalesce(cancelled_on >= epoch_us(TIMESTAMP '2024-01-13'), true)",
    "a1_a6_gauges": """SELECT CASE WHEN conc THEN 'concurrent' ELSE 'ordered' END AS lane, count(*) FILTER (is_open) AS open, count(*) FILTER (parked_on IS NOT NULL) AS parked, count(*) AS pending,
      min(greatest(created_on, coalesce(release_at, created_on))) AS oldest_open_since, count(*) FILTER (leased) AS in_flight,
      greatest(0.0, (any_value(now) - min(greatest(created_on, coalesce(release_at, created_on)))) / 1e6) AS relay_lag_s FROM o WHERE relayed_on IS NULL AND cancelled_on IS NULL GROUP BY 1""",
    "a8_a9_counters": """SELECT destination, count(*) FILTER (NOT dropped) AS relayed, count(*) FILTER (dropped) AS dropped FROM (
      SELECT o.destination, coalesce(n > 0 AND reached = 0, false) AS dropped FROM o LEFT JOIN (SELECT row_id, count(*) AS n, count(*) FILTER (ok) AS reached FROM log GROUP BY 1) x ON row_id = id WHERE relayed_on IS NOT NULL) GROUP BY 1""",
    "a10_attempts": "SELECT count(*) AS n, sum(attempts + 1)::BIGINT AS total, max(attempts + 1)::BIGINT AS most, quantile_cont(attempts + 1, 0.5) AS median FROM o WHERE relayed_on IS NOT NULL",
    "a13_total": "SELECT count(*) AS total FROM o WHERE parked_on IS NOT NULL AND cancelled_on IS NULL",
    "p1_row_view": f"""SELECT id, lane, ordering_key, parked_on IS NOT NULL AS parked, leased AS in_flight, {_KIND} AS failure_kind, reference FROM o""",
    "p3_filters": "SELECT id FROM o WHERE relayed_on IS NULL AND cancelled_on IS NULL AND event_type = 'click' AND created_on >= epoch_us(TIMESTAMP '2024-01-05') AND created_on < epoch_us(TIMESTAMP '2024-01-12') AND parked_on IS NULL",
    "p2_state_lists": """SELECT 'pending' AS state, count(*) FILTER (relayed_on IS NULL AND cancelled_on IS NULL) AS n FROM o UNION ALL SELECT 'parked', count(*) FILTER (parked_on IS NOT NULL AND cancelled_on IS NULL) FROM o
      UNION ALL SELECT 'relayed', count(relayed_on) FROM o UNION ALL SELECT 'cancelled', count(cancelled_on) FROM o""",
    "p7_verdicts": """SELECT t AS total, f AS "offset", l AS "limit", CASE WHEN t > 0 AND f >= t THEN 416 WHEN t = 0 OR (f = 0 AND l >= t) THEN 200 ELSE 206 END AS status,
      CASE WHEN t > 0 AND f < t THEN f END AS first_item, CASE WHEN t > 0 AND f < t THEN least(f + l, t) - 1 END AS last_item
      FROM (SELECT event_id % 120 AS t, event_id % 70 AS f, 1 + event_id % 60 AS l FROM events)""",
    "p8_payload": "SELECT id, payload, last_error FROM o",
    "f1_backoff": "SELECT id, CAST(least(5000 * pow(2, id % 40), 600000) AS BIGINT) AS delay_ms FROM o",
    "f2_f3_f4_stamp": """SELECT id, CASE WHEN http THEN 'http' ELSE 'kafka' END AS route, CASE WHEN http THEN 'CONCURRENT' ELSE 'ORDERED' END AS stamped_lane,
      CASE WHEN length(x) <= 255 THEN CASE WHEN trim(x) <> '' THEN x END ELSE 'sha256:' || sha256(x) END AS fitted
      FROM (SELECT id, starts_with(destination, 'http://') OR starts_with(destination, 'https://') AS http, CASE WHEN id % 4 = 0 THEN '  ' ELSE repeat(destination, CAST(id % 30 AS INTEGER)) END AS x FROM o)""",
    "f8_idempotency": "SELECT id, 'svc:outbox:' || id || coalesce(':' || key_token, '') AS idempotency FROM o",
    "f10_f12_failures": f"SELECT id, {_KIND} AS kind, left(event_type || coalesce(': ' || last_error, ''), 4000) AS told FROM o",
    "f13_sanitized": """SELECT id, CASE WHEN id % 3 = 0 THEN destination WHEN id % 3 = 1 THEN 'https://hub:' || (id % 9000) ELSE 'unparsed' END AS shown FROM (
      SELECT id, CASE WHEN starts_with(destination, 'http') THEN 'https://hub' ELSE destination END AS destination FROM o)""",
    "f14_send_bound": "SELECT id, CAST(CASE WHEN conc THEN 120000000 ELSE 60000000 END AS BIGINT) AS bound_us FROM o",
    "f18_transport_down": "SELECT id, id % 5 IN (0, 1, 2) AS down FROM o",
    "a11_pruned_counter": """SELECT * FROM (VALUES ('relayed'), ('cancelled')) s(state), LATERAL (SELECT count(*) AS rows FROM o
      WHERE CASE WHEN relayed_on < epoch_us(TIMESTAMP '2024-01-13') THEN 'relayed' WHEN cancelled_on < epoch_us(TIMESTAMP '2024-01-13') THEN 'cancelled' END = s.state), (SELECT false AS more_to_prune)""",
    "w11_renew_due": "SELECT id, id % 30 >= 12 AS renews FROM o",
    "w13_verdicts": """SELECT row_id, attempt, s AS start, CASE WHEN interrupted THEN 'failure' WHEN outcome IN ('OK', 'HANG', 'HOLD', 'DEAF') THEN 'success' WHEN outcome = 'TERMINAL' THEN NULL WHEN row_id % 4 = 0 THEN 'failure' END AS verdict FROM log""",
    "w3_relay_drain": """SELECT id, CASE WHEN took AND NOT lapsed AND id % 3 <> 0 THEN now ELSE relayed_on END AS relayed_on,
      CAST(attempts + CASE WHEN took AND (lapsed OR id % 3 = 0) THEN 1 ELSE 0 END AS INTEGER) AS attempts,
      CASE WHEN took AND lapsed THEN 'LeaseLapsedException: the send outlived its lease' WHEN took AND id % 3 = 0 THEN 'IOException: no' ELSE last_error END AS last_error,
      CASE WHEN took THEN lapsed OR id % 3 = 0 ELSE next_attempt_on > now END AS waits
    FROM (SELECT o.*, o.claimed_until IS NOT NULL AND o.sending_since IS NOT NULL AS lapsed, o.id IN (SELECT id FROM d WHERE NOT conc OR ordering_key IS NULL
        OR ordering_key NOT IN (SELECT ordering_key FROM o WHERE leased AND conc AND ordering_key IS NOT NULL)) AS took FROM o)""",
    "w7_send_times": """SELECT pod, round(sum(took * w), 3) AS mean_us FROM (SELECT pod, CAST(f - s AS DOUBLE) AS took, CASE WHEN row_number() OVER (PARTITION BY pod ORDER BY s, row_id, attempt) = 1 THEN pow(0.875, n - 1) ELSE 0.125 * pow(0.875, n - row_number() OVER (PARTITION BY pod ORDER BY s, row_id, attempt)) END AS w
      FROM (SELECT *, count(*) OVER (PARTITION BY pod) AS n FROM log)) GROUP BY pod""",
    "w12_pauses": """SELECT pod, transport, arg_max(run, seq) AS failures, arg_max(run, seq) >= 5 AS paused, count(*) FILTER (run = 5) AS begun FROM (
      SELECT pod, transport, seq, CASE WHEN good THEN 0 ELSE row_number() OVER (PARTITION BY pod, transport, g ORDER BY seq) - CASE WHEN g > 0 THEN 1 ELSE 0 END END AS run FROM (
        SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY pod, transport ORDER BY seq) AS g FROM (
          SELECT 'pod-' || (e % 3) AS pod, CASE WHEN http THEN 'http' ELSE 'kafka' END AS transport, e AS seq, CAST(floor(e * 2654435761 / 65536.0) AS BIGINT) % 10 < 2 AS good FROM ev))) GROUP BY pod, transport""",
    "w14_clock_offset": """SELECT pod, CASE WHEN abs(off) <= rtt / 2.0 + 1000 THEN 0 ELSE off END AS offset_us FROM (SELECT pod, arg_min(off, rtt * 1000000 + off) AS off, min(rtt) AS rtt FROM (
      SELECT 'pod-' || (e % 50) AS pod, 100 + e * 7919 % 5000 AS rtt, CAST(floor((e % 50 - 25) * 400 + e % 3) AS BIGINT) AS off FROM ev) GROUP BY pod)""",
    "w15_held": "SELECT id, release_at FROM o WHERE relayed_on IS NULL AND cancelled_on IS NULL AND release_at > now",
    "w16_received_once": "SELECT count(*) AS n, count(DISTINCT key) AS n_keys FROM (SELECT DISTINCT 'svc:outbox:' || id || coalesce(':' || key_token, '') AS key FROM o JOIN log ON row_id = id)",
    "w18_traced": "SELECT id, headers IS NOT NULL AS traced FROM o",
    "n1_never_relayed": "SELECT id, destination, attempts FROM o WHERE is_open AND id % 10 <> 0",
    "n2_never_received": "SELECT id, destination FROM o WHERE relayed_on IS NOT NULL AND id NOT IN (SELECT row_id FROM log WHERE row_id % 97 <> 0)",
    "n3_duplicates": """SELECT row_id, count(*) FILTER (ok) AS delivered, count(*) FILTER (f - s > lease OR killed OR EXISTS (SELECT 1 FROM outages WHERE f BETWEEN lo - 1000000 AND hi + 1000000)) AS unbookable,
      count(*) FILTER (ok) - 1 > count(*) FILTER (f - s > lease OR killed OR EXISTS (SELECT 1 FROM outages WHERE f BETWEEN lo - 1000000 AND hi + 1000000)) AS unexplained
      FROM log JOIN pods USING (pod) GROUP BY 1 HAVING count(*) FILTER (ok) > 1""",
    "n4_ordered_overlaps": """SELECT pod, before, row_id AS after FROM (SELECT pod, row_id, s, lag(row_id) OVER w AS before, lag(f) OVER w AS pf FROM log WHERE lane <> 'CONCURRENT' WINDOW w AS (PARTITION BY pod ORDER BY s, row_id, attempt)) WHERE s < pf - 50000""",
    "n5_ordered_inversions": """SELECT pod, row_id, last FROM (SELECT pod, row_id, max(row_id) OVER (PARTITION BY pod ORDER BY s, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
      FROM log WHERE lane <> 'CONCURRENT' AND attempt = 1 AND row_id IN (SELECT id FROM outbox WHERE release_at IS NULL) AND row_id NOT IN (SELECT row_id FROM log WHERE NOT ok)) WHERE row_id < last""",
    "n6_key_overlaps": """SELECT ordering_key, l.r AS before, row_id AS after FROM (
      SELECT ordering_key, row_id, s, max(struct_pack(f := f, s := -s, r0 := -row_id, r := row_id, ex := f - s > lease OR killed)) OVER (PARTITION BY ordering_key ORDER BY s, row_id, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
      FROM log JOIN pods USING (pod) WHERE lane = 'CONCURRENT' AND ordering_key IS NOT NULL) WHERE s < l.f - 50000 AND NOT l.ex""",
    "n7_key_inversions": """SELECT x.ordering_key, earlier, later, coalesce(ff < efirst + 50000, false) OR coalesce(release_at > efirst - 50000, false) OR attempts > 0 AS excused FROM (
        SELECT ordering_key, row_id AS later, lag(row_id) OVER w AS earlier, lag(first) OVER w AS efirst FROM (SELECT ordering_key, row_id, min(s) AS first FROM log WHERE lane = 'CONCURRENT' AND ordering_key IS NOT NULL AND ok GROUP BY 1, 2) WINDOW w AS (PARTITION BY ordering_key ORDER BY first, row_id)) x
      LEFT JOIN (SELECT row_id, min(f) AS ff FROM log WHERE NOT ok GROUP BY 1) y ON later = y.row_id JOIN outbox ON id = later WHERE later < earlier""",
    "n8_free_time": "SELECT lane, sum(hi - lo)::BIGINT AS free_us FROM isl GROUP BY 1",
    "n10_gauge_differences": """SELECT lane, pending, parked, in_flight FROM (SELECT CASE WHEN conc THEN 'concurrent' ELSE 'ordered' END AS lane, count(*) AS pending, count(*) FILTER (parked_on IS NOT NULL) AS parked, count(*) FILTER (leased) AS in_flight
      FROM o WHERE relayed_on IS NULL AND cancelled_on IS NULL GROUP BY 1) WHERE lane = 'ordered'""",
    "n11_counter_differences": """SELECT destination, count(*) FILTER (NOT dropped) AS relayed, count(*) FILTER (dropped) AS dropped FROM (
      SELECT o.destination, coalesce(n > 0 AND reached = 0, false) AS dropped FROM o LEFT JOIN (SELECT row_id, count(*) AS n, count(*) FILTER (ok) AS reached FROM log GROUP BY 1) x ON row_id = id WHERE relayed_on IS NOT NULL) GROUP BY 1 HAVING count(*) FILTER (dropped) > 0""",
    "n12_inconsistencies": """SELECT id, problem FROM (
      SELECT id, unnest([CASE WHEN relayed_on IS NOT NULL AND parked_on IS NOT NULL THEN 'relayed and parked' END, CASE WHEN last_s > cancelled_on + 50000 THEN 'sent after its cancel' END, CASE WHEN first_s < release_at - 50000 THEN 'sent before its release' END,
        CASE WHEN parked_on IS NOT NULL AND NOT (attempts > 0 AND last_error IS NOT NULL) AND coalesce(failed, 0) = 0 THEN 'parked without a failure' END,
        CASE WHEN is_open AND (coalesce(term, 0) > 0 OR coalesce(failed, 0) >= 10) THEN 'exhausted but not parked' END, CASE WHEN leased THEN 'still leased' END]) AS problem
      FROM o LEFT JOIN (SELECT row_id, max(s) AS last_s, min(s) AS first_s, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (outcome = 'TERMINAL') AS term FROM log GROUP BY 1) x ON row_id = id) WHERE problem IS NOT NULL""",
    "n13_late_turns": """SELECT row_id, rank, waited_ms FROM (SELECT row_id, CAST(row_number() OVER (ORDER BY round, ordering_key) AS BIGINT) AS rank, CAST(floor((first - epoch_us(TIMESTAMP '2024-01-01')) / 1000) AS BIGINT) AS waited_ms, count(*) OVER () AS n, floor((max(done) OVER () - epoch_us(TIMESTAMP '2024-01-01')) / 1000) AS drain
      FROM (SELECT *, row_number() OVER (PARTITION BY ordering_key ORDER BY row_id) AS round FROM (SELECT ordering_key, row_id, min(s) AS first, max(f) AS done FROM log WHERE ordering_key IS NOT NULL GROUP BY 1, 2))) WHERE waited_ms > 1.5 * (drain * rank / n) + 10000""",
    "n14_claim_wraps": """SELECT pod, seq, coalesce(cnt, -1) >= coalesce(lim, -1) OR heads IS NULL OR heads >= coalesce(lim, -1) AS premature FROM (
      SELECT *, last_value(CASE WHEN statement = 'claim' THEN lim0 END IGNORE NULLS) OVER w AS lim, last_value(CASE WHEN statement = 'claim' THEN cnt0 END IGNORE NULLS) OVER w AS cnt, last_value(CASE WHEN statement = 'head_keys' THEN cnt0 END IGNORE NULLS) OVER w AS heads FROM (
        SELECT *, sum(CASE WHEN statement = 'claim' THEN 1 ELSE 0 END) OVER (PARTITION BY pod ORDER BY seq) AS round FROM (
          SELECT 'pod-' || (e % 3) AS pod, e AS seq, (['claim', 'head_keys', 'wrap'])[(e // 3) % 3 + 1] AS statement, 100 AS lim0, e * 7919 % 130 AS cnt0 FROM ev))
      WINDOW w AS (PARTITION BY pod, round ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE statement = 'wrap'""",
}

_N9 = """, cut AS (SELECT lo, hi + 3000000 AS hi FROM outages),
fd AS (SELECT lane, tm, sum(dl) AS dl FROM (SELECT lane, lo AS tm, 1 AS dl FROM isl UNION ALL SELECT lane, hi, -1 FROM isl UNION ALL SELECT lane, lo, -2 FROM cut, lanes UNION ALL SELECT lane, hi, 2 FROM cut, lanes) GROUP BY 1, 2),
fl AS (SELECT lane, tm AS lo, lead(tm) OVER (PARTITION BY lane ORDER BY tm) AS hi, sum(dl) OVER (PARTITION BY lane ORDER BY tm) AS lv FROM fd),
fr AS (SELECT lane, lo, hi FROM fl WHERE lv = 1 AND hi IS NOT NULL),
cum AS (SELECT *, coalesce(sum(hi - lo) OVER (PARTITION BY lane ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fr),
snt AS (SELECT row_id, min(s) AS first_s, max(f) AS done_f FROM log GROUP BY 1),
j AS (SELECT o.*, first_s, done_f FROM o LEFT JOIN snt ON row_id = id),
w0 AS (SELECT *, CASE WHEN ordering_key IS NOT NULL THEN max(done_f) OVER w END AS ahead, CASE WHEN ordering_key IS NOT NULL THEN max(CASE WHEN is_open AND done_f IS NULL THEN 1 ELSE 0 END) OVER w END AS stuck,
  coalesce(first_s, CASE WHEN is_open THEN now END) AS st FROM j WINDOW w AS (PARTITION BY ordering_key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w1 AS (SELECT *, greatest(created_on, coalesce(release_at, created_on), coalesce(ahead, created_on)) AS fr0, CASE WHEN conc THEN 'concurrent' ELSE 'ordered' END AS ln FROM w0 WHERE cancelled_on IS NULL AND coalesce(stuck, 0) = 0),
w2 AS (SELECT * FROM w1 WHERE st > fr0),
a1 AS (SELECT w2.id, coalesce(before + least(fr0, hi) - lo, 0) AS u FROM w2 ASOF LEFT JOIN cum ON w2.ln = cum.lane AND w2.fr0 >= cum.lo),
a2 AS (SELECT w2.id, coalesce(before + least(st, hi) - lo, 0) AS u FROM w2 ASOF LEFT JOIN cum ON w2.ln = cum.lane AND w2.st >= cum.lo)"""
_N9_LAST = "SELECT w2.id, st - fr0 AS wait_us, (a2.u - a1.u)::BIGINT AS free_us FROM w2 JOIN a1 USING (id) JOIN a2 USING (id) WHERE a2.u - a1.u > 6000000 + CASE WHEN conc THEN 120000000 ELSE 15000000 END"


def oracle_sql() -> dict[str, str]:
    out = {name: f"{BASE}{_FREE if name == 'n8_free_time' else ''} {sql}" for name, sql in QUERIES.items()}
    out["w12_pause_stream"] = out["w12_pauses"]
    out["n9_starved"] = f"{BASE}{_FREE}{_N9} {_N9_LAST}"
    return out
