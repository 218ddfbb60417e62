"""Queries over scores, status transitions, request logs and whole cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..config import CycleConfig, QueueConfig, ScoreConfig, ServiceConfig
from ..functions import score as S
from ..functions.keys import cycle_id, dedupe_hash
from ..functions.text import epoch_ms, iso_text, minutes_since
from ..operators import admission, history, merge, stats, transitions
from ..schemas import ENDPOINTS, conform
from ..session import cut_lineage, spread
from ..sources import jobs as job_source
from ..streaming.jobs import retry_failed
from .cycle import CycleInputs, run_cycle
from .queries_parse import FEED, source_catalogue
from .registry import TS, half_up, iso, query


def clamp_sql(value: str, low: str, high: str) -> str:
    return f"least(greatest({value}, {low}), {high})"


def score_sql(p: dict[str, str]) -> dict[str, str]:
    """SQL of the score and its factors; ``p`` gives the input expressions."""
    speed = f"""CASE WHEN {p['latency']} IS NULL OR {p['latency']} <= 0 THEN 0.0 WHEN {p['latency']} <= 200 THEN 1.0
      WHEN {p['latency']} >= 3000 THEN 0.0 ELSE CAST(3000 - {p['latency']} AS DOUBLE) / 2800 END"""
    fresh = f"CASE WHEN {p['minutes']} IS NULL THEN 0.0 WHEN {p['minutes']} <= 0 THEN 1.0 ELSE pow(0.5, {p['minutes']} / 45.0) END"
    solid = f"""CASE WHEN {p['checks']} <= 0 THEN CASE WHEN {p['passed']} THEN 0.5 ELSE 0.0 END
      ELSE {clamp_sql(f"CAST({p['passes']} AS DOUBLE) / {p['checks']}", '0.0', '1.0')} END"""
    service = f"CASE {p['service']} WHEN 'passed' THEN 1.0 WHEN 'untested' THEN 0.45 WHEN 'failed' THEN 0.1 WHEN 'blocked' THEN 0.0 ELSE 0.3 END"
    level = f"CASE {p['anonymity']} WHEN 'elite' THEN 1.0 WHEN 'anonymous' THEN 0.75 WHEN 'transparent' THEN 0.4 ELSE 0.6 END"
    quality = f"CAST({p['trust']} AS DOUBLE) * 0.6 + CAST({level} AS DOUBLE) * 0.4"
    points = f"""least(60.0, least(40.0, greatest(0, {p['fails']} - 1) * 12.0 + CASE WHEN {p['fails']} > 0 THEN 6.0 ELSE 0.0 END)
      + CASE WHEN {p['service']} = 'blocked' THEN 25.0 ELSE 0.0 END)"""
    dbl = lambda x: f"CAST(({x}) AS DOUBLE)"
    total = (
        f"({dbl(solid)} * CAST(0.35 AS DOUBLE) + {dbl(speed)} * CAST(0.2 AS DOUBLE) + {dbl(fresh)} * CAST(0.15 AS DOUBLE)"
        f" + {dbl(service)} * CAST(0.25 AS DOUBLE) + ({quality}) * CAST(0.05 AS DOUBLE))"
    )
    raw = clamp_sql(f"{total} / {sum((0.35, 0.2, 0.15, 0.25, 0.05))!r} * 100.0 - {points}", "0.0", "100.0")
    return {
        "score": f"CASE WHEN {p['passed']} THEN CAST({half_up(raw)} AS INT) ELSE 0 END",
        "reliability": solid,
        "latency": speed,
        "freshness": fresh,
        "service": service,
        "quality": quality,
        "penalty": points,
    }


SINCE = f"date_diff('millisecond', last_passed_at, {TS}) / 60000.0"
SCORED = score_sql(
    dict(
        passed="validation_status <> 'failed'", latency="latency_ms", checks="check_count", passes="pass_count",
        fails="consecutive_failures", minutes=SINCE, service="service_status", trust="0.5", anonymity="anonymity",
    )
)
FACTORS = ["reliability", "latency", "freshness", "service", "quality"]


@query(
    f"""SELECT id, score, {", ".join(f"CASE WHEN score_ok THEN {half_up(f'CAST(f_{n} AS DOUBLE)', 3)} ELSE 0.0 END AS {n}" for n in FACTORS)},
  CASE WHEN score_ok THEN penalty ELSE 0.0 END AS penalty,
  CASE WHEN NOT score_ok THEN 'validation_failed' ELSE concat_ws(',', CASE WHEN blocked THEN 'service_blocked' END,
    CASE WHEN penalty > 0 THEN concat('failure_penalty:', fails) END, CASE WHEN score < 25 THEN 'below_min_pool_score' END) END AS reasons
FROM (SELECT id, {SCORED["score"]} AS score, validation_status <> 'failed' AS score_ok, service_status = 'blocked' AS blocked,
  consecutive_failures AS fails, {", ".join(f"{SCORED[n]} AS f_{n}" for n in FACTORS)}, {SCORED["penalty"]} AS penalty FROM fx_endpoints)""",
    ("fx_endpoints",),
)
def score_endpoints(spark, sf_dir):
    """Score, factors and reasons of every endpoint."""
    c = F.col
    detail = S.score_detailed(
        c("validation_status") != "failed", c("latency_ms"), c("check_count"), c("pass_count"), c("consecutive_failures"),
        minutes_since(c("last_passed_at"), fx.NOW), c("service_status"), c("service_status") == "blocked", None, c("anonymity"),
    )
    scored = fx.view(spark, sf_dir, "fx_endpoints").select("id", detail.alias("d"))
    return scored.select(
        "id", "d.score", *[f"d.factors.{n}" for n in (*FACTORS, "penalty")], F.array_join("d.reasons", ",").alias("reasons")
    )


@query(
    f"""SELECT id, CAST({half_up("CASE WHEN q IS NULL THEN b ELSE CAST(b AS DOUBLE) * CAST(0.55 AS DOUBLE) + q * (1 - CAST(0.55 AS DOUBLE)) END * 100.0")} AS INT) AS combined
FROM (SELECT id, score / 100.0 AS b, CASE WHEN id % 4 <> 0 THEN (id % 11) / 10.0 END AS q FROM fx_endpoints)""",
    ("fx_endpoints",),
)
def combine_scores(spark, sf_dir):
    quality = F.when(F.col("id") % 4 != 0, (F.col("id") % 11) / 10.0)
    df = fx.view(spark, sf_dir, "fx_endpoints")
    return df.select("id", S.combine_scores(F.col("score"), quality).alias("combined"))


QUALITY_SQL = """CASE verdict WHEN 'passed' THEN least(1.0::DOUBLE, 0.7::DOUBLE + CASE WHEN latency_ms IS NULL THEN 0.6::DOUBLE
    ELSE least(greatest((5000.0::DOUBLE - latency_ms) / 4601.0, 0), 1) END * 0.2::DOUBLE + greatest(1.0::DOUBLE - fails * 0.25::DOUBLE, 0) * 0.1::DOUBLE)
  WHEN 'blocked' THEN 0.05 WHEN 'skipped' THEN 0.5 ELSE greatest(0.0::DOUBLE, 0.1::DOUBLE - least(0.3::DOUBLE, greatest(fails - 1, 0) * 0.1::DOUBLE)) END"""


@query(
    f"""SELECT id, {half_up(QUALITY_SQL, 6)} AS quality, CASE WHEN verdict IN ('passed', 'blocked', 'skipped') THEN verdict ELSE 'failed' END AS status
FROM (SELECT id, status AS verdict, latency_ms * 9 AS latency_ms, id % 5 AS fails FROM fx_service)""",
    ("fx_service",),
)
def service_quality(spark, sf_dir):
    got = S.service_quality(F.col("status"), F.col("latency_ms") * 9, F.col("id") % 5)
    df = fx.view(spark, sf_dir, "fx_service").select("id", got.alias("q"))
    return df.select("id", (F.floor(F.col("q.quality") * 1e6 + 0.5) / 1e6).alias("quality"), "q.status")


# Validation and service plans -------------------------------------------------

LATEST = "(SELECT *, row_number() OVER (PARTITION BY proxy_id ORDER BY created_at DESC, id DESC) AS nth FROM {})"
PLAN = f"""
, joined AS (
  SELECT e.*, o.reachable AS ok, CASE WHEN o.reachable THEN o.latency_ms END AS new_latency, o.error_code AS new_error,
    CASE WHEN o.reachable THEN 0 ELSE e.consecutive_failures + 1 END AS fails, e.check_count + 1 AS checks,
    e.pass_count + CAST(o.reachable AS INT) AS passes,
    CASE WHEN o.reachable THEN 0.0 ELSE date_diff('millisecond', e.last_passed_at, {TS}) / 60000.0 END AS idle, (e.id % 12) / 10.0 AS trust
  FROM {LATEST.format("fx_checks")} o JOIN fx_endpoints e ON e.id = o.proxy_id WHERE o.nth = 1),
scored AS (SELECT *, {score_sql(dict(
    passed="ok", latency="new_latency", checks="checks", passes="passes", fails="fails", minutes="idle",
    service="service_status", trust="least(trust, 1.0)", anonymity="anonymity"))["score"]} AS new_score FROM joined),
planned AS (SELECT *, CASE WHEN ok AND new_score >= 25 THEN 'active' WHEN ok THEN 'quarantined'
    WHEN fails >= 3 AND last_passed_at IS NULL AND fails >= 9 THEN 'dead' WHEN fails >= 3 THEN 'quarantined'
    WHEN status IN ('active', 'quarantined') THEN status ELSE 'new' END AS new_status,
  CASE WHEN ok AND new_score >= 25 THEN NULL WHEN ok THEN concat('low_score:', new_score)
    WHEN fails >= 9 AND last_passed_at IS NULL THEN 'unrecoverable' WHEN fails >= 3 THEN concat('failures:', fails)
    WHEN status = 'active' THEN concat('transient_failure:', fails) ELSE concat('failures:', fails) END AS note FROM scored)
"""


def _validation(spark, sf_dir):
    endpoints = fx.endpoints(spark, sf_dir).withColumn("dedupe_key", F.col("id").cast("string"))
    latest = history.latest_result(fx.view(spark, sf_dir, "fx_checks"), ["proxy_id"])
    trust = endpoints.select("dedupe_key", ((F.col("id") % 12) / 10.0).alias("trust"))
    return endpoints, transitions.plan_validation(endpoints, latest, fx.NOW, trust)


@query(
    PLAN
    + """
SELECT id, ok AS reachable, status AS status_before, new_status AS status, new_score AS score, fails AS consecutive_failures,
  new_latency AS latency_ms, new_error AS error_code, note AS notes FROM planned""",
    ("fx_endpoints", "fx_checks"),
)
def plan_validation(spark, sf_dir):
    plan = _validation(spark, sf_dir)[1]
    return plan.drop("score_reasons", "validation_status", "service_status")


@query(
    PLAN
    + f"""
SELECT e.id, coalesce(p.new_status, e.status) AS status, CASE WHEN p.id IS NULL THEN e.score ELSE p.new_score END AS score,
  CASE WHEN p.id IS NULL THEN e.latency_ms ELSE p.new_latency END AS latency_ms, e.check_count + CASE WHEN p.id IS NULL THEN 0 ELSE 1 END AS check_count,
  e.pass_count + CASE WHEN coalesce(p.ok, false) THEN 1 ELSE 0 END AS pass_count, coalesce(p.fails, e.consecutive_failures) AS consecutive_failures,
  {iso(f"CASE WHEN coalesce(p.ok, false) THEN {TS} ELSE e.last_passed_at END")} AS last_passed_at, p.note AS notes
FROM fx_endpoints e LEFT JOIN planned p ON p.id = e.id""",
    ("fx_endpoints", "fx_checks"),
)
def apply_validation(spark, sf_dir):
    table = transitions.apply_validation(*_validation(spark, sf_dir), fx.NOW)
    return table.select(
        "id", "status", "score", "latency_ms", "check_count", "pass_count", "consecutive_failures",
        iso_text(F.col("last_passed_at")).alias("last_passed_at"), "notes",
    )


@query(
    PLAN
    + """
SELECT count(*) AS checked, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed,
  count(*) FILTER (ok AND new_status = 'active' AND status <> 'active') AS added,
  count(*) FILTER (new_status = 'active' AND status = 'active') AS retained, count(*) FILTER (new_status = 'quarantined') AS quarantined
FROM planned""",
    ("fx_endpoints", "fx_checks"),
)
def validation_tally(spark, sf_dir):
    return stats.validation_tally(_validation(spark, sf_dir)[1])


SERVICE_PLAN = f"""
, results AS (SELECT proxy_id, status AS result, latency_ms AS result_ms, reason AS result_reason,
    CASE status WHEN 'passed' THEN 0.9 WHEN 'blocked' THEN 0.05 WHEN 'failed' THEN 0.1 END AS quality
  FROM {LATEST.format("fx_service")} WHERE nth = 1 AND service = 'svc-a'),
both_rows AS (SELECT e.*, r.* FROM results r JOIN fx_endpoints e ON e.id = r.proxy_id),
linked AS (SELECT *, {score_sql(dict(
    passed="validation_status <> 'failed'", latency="latency_ms", checks="check_count", passes="pass_count", fails="consecutive_failures",
    minutes=SINCE, service="result", trust="0.5", anonymity="anonymity"))["score"]} AS base FROM both_rows),
planned AS (SELECT *, CAST({half_up("CASE WHEN quality IS NULL THEN base / 100.0 ELSE CAST(base / 100.0 AS DOUBLE) * CAST(0.55 AS DOUBLE) + quality * (1 - CAST(0.55 AS DOUBLE)) END * 100.0")} AS INT) AS new_score,
  CASE WHEN result = 'passed' THEN 'active' ELSE status END AS status_next FROM linked)
"""


def _service(spark, sf_dir):
    endpoints = fx.endpoints(spark, sf_dir)
    last = history.latest_result(fx.view(spark, sf_dir, "fx_service"), ["proxy_id"]).filter("service = 'svc-a'")
    quality = F.when(F.col("status") == "passed", 0.9).when(F.col("status") == "blocked", 0.05).when(F.col("status") == "failed", 0.1)
    return endpoints, transitions.plan_service(endpoints, last.withColumn("quality", quality), fx.NOW)


@query(
    SERVICE_PLAN + "SELECT id, result = 'passed' AS passed, result AS service_status, result_ms AS service_latency_ms, result_reason AS service_fail_reason, new_score AS score, status_next FROM planned",
    ("fx_endpoints", "fx_service"),
)
def plan_service(spark, sf_dir):
    return _service(spark, sf_dir)[1]


@query(
    SERVICE_PLAN
    + f"""
SELECT e.id, coalesce(p.status_next, e.status) AS status, CASE WHEN p.id IS NULL THEN e.score ELSE p.new_score END AS score,
  coalesce(p.result, e.service_status) AS service_status, p.result_reason AS service_fail_reason,
  {iso(f"CASE WHEN p.id IS NULL THEN e.service_checked_at ELSE {TS} END")} AS service_checked_at
FROM fx_endpoints e LEFT JOIN planned p ON p.id = e.id""",
    ("fx_endpoints", "fx_service"),
)
def apply_service(spark, sf_dir):
    table = transitions.apply_service(*_service(spark, sf_dir), fx.NOW)
    return table.select(
        "id", "status", "score", "service_status", "service_fail_reason",
        iso_text(F.col("service_checked_at")).alias("service_checked_at"),
    )


# Sweeps -----------------------------------------------------------------------

CLAIMED = "id IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')"


def _claimed(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "orders").filter("o_orderpriority like '1%'")
    return ids.select(F.col("o_custkey").alias("id"))


@query(
    f"""SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 'cyc_now' END AS last_cycle_id
FROM (SELECT *, {CLAIMED} AND status IN ('new', 'quarantined', 'active') AS hit FROM fx_endpoints)""",
    ("fx_endpoints",),
)
def mark_pending(spark, sf_dir):
    table = transitions.mark_pending(fx.endpoints(spark, sf_dir), _claimed(spark, sf_dir), "cyc_now")
    return table.select("id", "status", "last_cycle_id")


@query(
    f"""SELECT id, CASE WHEN {CLAIMED} THEN 'skipped' ELSE service_status END AS service_status,
  CASE WHEN {CLAIMED} THEN 'budget' END AS service_fail_reason FROM fx_endpoints""",
    ("fx_endpoints",),
)
def mark_service_untested(spark, sf_dir):
    table = transitions.mark_service_untested(fx.endpoints(spark, sf_dir), _claimed(spark, sf_dir), "budget")
    return table.select("id", "service_status", "service_fail_reason")


OWNER = "CASE WHEN id % 3 = 0 THEN 'cyc_now' WHEN id % 3 = 1 THEN 'cyc_old' END"


@query(
    f"""SELECT id, CASE WHEN status = 'pending' AND {OWNER} = 'cyc_now' THEN 'new' ELSE status END AS own,
  CASE WHEN status = 'pending' AND coalesce({OWNER} <> 'cyc_now', true) THEN 'new' ELSE status END AS others FROM fx_endpoints""",
    ("fx_endpoints",),
)
def release_pending(spark, sf_dir):
    table = fx.endpoints(spark, sf_dir).withColumn("last_cycle_id", F.expr(OWNER))
    # Both variants over one scan.
    first = transitions.release_pending(table.withColumn("before", F.col("status")), "cyc_now", foreign=False)
    swapped = first.withColumns({"own": F.col("status"), "status": F.col("before")})
    return transitions.release_pending(swapped, "cyc_now", own=False).select("id", "own", F.col("status").alias("others"))


STALE = f"status = 'active' AND coalesce(last_passed_at < {TS} - INTERVAL '90' MINUTE, true)"


@query(
    f"""SELECT id, CASE WHEN {STALE} THEN 'dead' ELSE status END AS status, CASE WHEN {STALE} THEN 'expired' END AS last_error_code,
  CASE WHEN {STALE} THEN 'failed' ELSE validation_status END AS validation_status FROM fx_endpoints""",
    ("fx_endpoints",),
)
def expire_stale(spark, sf_dir):
    table = transitions.expire_stale(fx.endpoints(spark, sf_dir), fx.NOW)
    return table.select("id", "status", "last_error_code", "validation_status")


@query(
    "SELECT id, CASE WHEN status = 'active' AND consecutive_failures >= 3 THEN 'quarantined' ELSE status END AS status FROM fx_endpoints",
    ("fx_endpoints",),
)
def quarantine_failures(spark, sf_dir):
    return transitions.quarantine_failures(fx.endpoints(spark, sf_dir)).select("id", "status")



@query(
    f"""SELECT id, CASE WHEN status = 'active' AND nth > 300 THEN 'quarantined' ELSE status END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY status ORDER BY score DESC, latency_ms ASC NULLS LAST, id DESC) AS nth FROM fx_endpoints)""",
    ("fx_endpoints",),
)
def enforce_capacity(spark, sf_dir):
    return transitions.enforce_capacity(fx.endpoints(spark, sf_dir), 300).select("id", "status")


FINAL = f"""
, swept AS (SELECT *, CASE WHEN {STALE} THEN 'expired' WHEN status = 'active' AND consecutive_failures >= 3 THEN 'quarantined'
    WHEN status = 'pending' THEN 'released' END AS step FROM fx_endpoints),
ranked AS (SELECT *, row_number() OVER (PARTITION BY step IS NULL AND status = 'active' ORDER BY score DESC, latency_ms ASC NULLS LAST, id DESC) AS nth FROM swept),
final AS (SELECT id, CASE WHEN step IS NULL AND status = 'active' AND nth > 150 THEN 'demoted' ELSE step END AS swept, status AS before FROM ranked),
done AS (SELECT id, swept, CASE swept WHEN 'expired' THEN 'dead' WHEN 'quarantined' THEN 'quarantined' WHEN 'released' THEN 'new'
    WHEN 'demoted' THEN 'quarantined' ELSE before END AS status FROM final)
"""


@query(FINAL + "SELECT id, status, swept FROM done", ("fx_endpoints",))
def finalize(spark, sf_dir):
    table = transitions.finalize(fx.endpoints(spark, sf_dir), "cyc_now", fx.NOW, max_active=150)
    return table.select("id", "status", "swept")


@query(
    FINAL
    + """
SELECT count(*) FILTER (swept = 'expired') AS expired, count(*) FILTER (swept = 'quarantined') AS quarantined,
  count(*) FILTER (swept = 'demoted') AS demoted, count(*) FILTER (swept = 'released') AS released,
  count(*) FILTER (status = 'active') AS pool_size FROM done""",
    ("fx_endpoints",),
)
def sweep_counts(spark, sf_dir):
    return transitions.sweep_counts(transitions.finalize(fx.endpoints(spark, sf_dir), "cyc_now", fx.NOW, max_active=150))


@query(
    """SELECT cycle_id, CASE WHEN status = 'failed' THEN 'failed' WHEN cycle_id = 'cyc_2' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN status = 'failed' THEN NULL WHEN cycle_id = 'cyc_2' THEN NULL WHEN cycle_id = 'cyc_3' THEN repeat('x', 600)
    ELSE 'abandoned: worker restarted mid-cycle' END AS error,
  CASE WHEN cycle_id = 'cyc_2' AND status <> 'failed' THEN 77 ELSE 0 END AS pool_size FROM fx_cycles""",
    ("fx_cycles",),
)
def cycle_bookkeeping(spark, sf_dir):
    """Start, complete, fail and recover over the cycle rows."""
    cycles = fx.view(spark, sf_dir, "fx_cycles")
    running = cycles.withColumn("status", F.when(F.col("status") == "completed", "running").otherwise(F.col("status")))
    running = running.withColumn("open", F.col("status") == "running")
    done = history.complete_cycle(running.filter("open"), "cyc_2", {"pool_size": 77}, fx.NOW)
    done = history.fail_cycle(done, "cyc_3", "x" * 600, fx.NOW)
    done = history.recover_abandoned(done, fx.NOW)
    closed = history.recover_abandoned(running.filter("not open"), fx.NOW)
    return done.unionByName(closed).select("cycle_id", "status", "error", "pool_size")


# FNV-1a over the digits of a number.
FNV = """list_reduce(list_transform(string_split(CAST(event_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT))"""


@query(
    f"""SELECT event_id, concat('cyc_', strftime(ts, '%Y%m%dT%H%M%SZ'), '_', printf('%08x', {FNV})) AS cycle_id FROM events""",
)
def cycle_ids(spark, sf_dir):
    """Ids of cycles begun at every event, whole."""
    df = fx.table(spark, sf_dir, "events")
    return df.select("event_id", cycle_id(F.col("ts"), F.col("event_id").cast("string")).alias("cycle_id"))


# Request logs -----------------------------------------------------------------


@query(
    """, r AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s,
    epoch_us(ts) // 7200000000 AS window_no, row_number() OVER (PARTITION BY user_id % 20,
    epoch_us(ts) // 7200000000 ORDER BY ts, event_id) AS nth FROM events)
SELECT event_id, window_no, nth, nth <= 2 AS allowed, greatest(2 - nth, 0) AS remaining, 7200 - s % 7200 AS reset_seconds,
  CASE WHEN nth <= 2 THEN 0 ELSE 7200 - s % 7200 END AS retry_after_seconds FROM r"""
)
def rate_limit(spark, sf_dir):
    """Every event as a request of one of twenty clients."""
    events = fx.table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 20).alias("client"))
    decided = admission.rate_limit(events, ["client"], "ts", ["event_id"], most=2, window_seconds=7200)
    return decided.drop("ts", "client")


@query(
    """, r AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events)
SELECT event_id, CASE WHEN event_type = 'view' THEN t ELSE max(t - n * 600000) OVER (PARTITION BY event_type ORDER BY t, event_id
  ROWS UNBOUNDED PRECEDING) + n * 600000 END AS slot_ms FROM r"""
)
def crawl_spacing(spark, sf_dir):
    """Slots ten minutes apart per origin (the event type stands in for it); one origin has no delay."""
    events = fx.table(spark, sf_dir, "events").select(
        "event_id", "event_type", epoch_ms(F.col("ts")).alias("at_ms"),
        F.when(F.col("event_type") == "view", 0).otherwise(600_000).cast("bigint").alias("delay"),
    )
    return admission.crawl_spacing(events, "event_type", "at_ms", ["event_id"], "delay").select("event_id", "slot_ms")


@query(
    """, c AS (SELECT *, max(CASE WHEN reachable THEN created_at END) OVER (PARTITION BY proxy_id) AS good FROM fx_checks)
SELECT proxy_id, count(*) AS check_count, count(*) FILTER (reachable) AS pass_count, count(*) FILTER (good IS NULL OR created_at > good)
  AS consecutive_failures, strftime(max(created_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_checked_at, strftime(max(good), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_passed_at
FROM c GROUP BY proxy_id""",
    ("fx_checks",),
)
def endpoint_state(spark, sf_dir):
    state = admission.endpoint_state(fx.view(spark, sf_dir, "fx_checks"))
    return state.withColumns({n: iso_text(F.col(n)) for n in ("last_checked_at", "last_passed_at")})


ATTEMPTS = "error_code IS NULL OR error_code NOT IN ('timeout', 'connect_reset', 'protocol_error', 'dns_error', 'tls_error')"


@query(
    f""", t AS (SELECT *, min(CASE WHEN {ATTEMPTS} THEN attempt END) OVER (PARTITION BY proxy_id, cycle_id) AS final,
    max(attempt) OVER (PARTITION BY proxy_id, cycle_id) AS last FROM fx_attempts WHERE attempt <= 3)
SELECT proxy_id, cycle_id, attempt AS attempts, error_code, status, latency_ms FROM t WHERE attempt = coalesce(final, last)""",
    ("fx_attempts",),
)
def collapse_attempts(spark, sf_dir):
    return admission.collapse_attempts(fx.view(spark, sf_dir, "fx_attempts"), ["proxy_id", "cycle_id"], 3)


@query(
    f"""SELECT proxy_id, cycle_id, attempt, CASE WHEN attempt < 4 THEN 'retry' ELSE 'drop' END AS action, CASE WHEN attempt < 4 THEN attempt + 1 END AS next_attempt,
  CASE WHEN attempt < 4 THEN CAST({half_up("least(4000.0, 400.0 * pow(2.0, attempt - 1)) * (0.825::DOUBLE + (latency_ms % 100) / 100.0 * 0.35::DOUBLE)")} AS BIGINT) END AS delay_ms
FROM fx_attempts WHERE error_code IS NOT NULL""",
    ("fx_attempts",),
)
def retry_plan(spark, sf_dir):
    failed = fx.view(spark, sf_dir, "fx_attempts").filter("error_code is not null")
    plan = admission.retry_plan(failed, 4, (F.col("latency_ms") % 100) / 100.0)
    return plan.select("proxy_id", "cycle_id", "attempt", "action", "next_attempt", "delay_ms")


@query(
    """, j AS (SELECT *, event_id % 8 AS k FROM events),
  good AS (SELECT event_id, 1 + event_id % 3 AS attempt FROM j WHERE k IN (0, 4, 5) OR (k <> 6 AND event_id % 7 <> 0))
SELECT event_id AS id, CASE WHEN attempt < 3 THEN attempt + 1 ELSE attempt END AS attempt, CASE WHEN attempt < 3 THEN 'retry' ELSE 'drop' END AS fate
FROM good"""
)
def job_retries(spark, sf_dir):
    """A batch of jobs that all fail: sent again or given up."""
    good, _ = job_source.split_jobs(job_source.parse_jobs(fx.view(spark, sf_dir, "fx_jobs")))
    failed = good.withColumn("attempt", (1 + F.col("id") % 3).cast("int"))
    again, dropped = retry_failed(failed, 3)
    tag = lambda df, name: df.select("id", "attempt", F.lit(name).alias("fate"))
    return tag(again, "retry").unionByName(tag(dropped, "drop"))


# Whole cycle ------------------------------------------------------------------


def keyed(endpoints):
    """Endpoints with their stored key, whose hash is the heaviest work on a row."""
    return spread(endpoints).withColumn("dedupe_key", dedupe_hash(*[F.col(name) for name in merge.IDENTITY]))


def cycle_inputs(spark, sf_dir):
    lines = fx.view(spark, sf_dir, "fx_feeds")
    outcomes = history.latest_result(fx.view(spark, sf_dir, "fx_checks"), ["proxy_id"])
    probes = history.latest_result(fx.view(spark, sf_dir, "fx_service"), ["proxy_id"])
    return CycleInputs(lines, source_catalogue(lines), outcomes, probes.withColumnRenamed("status", "verdict"))


# A cycle in SQL over the endpoints as the merge left them (`seen`, with now_status and trust): who is queued, what their checks say, who is tried at the service, what the sweeps do.
STALE_CHECK = f"coalesce(last_checked_at < {TS} - INTERVAL '15' MINUTE, true)"
CYCLE_SQL = f"""
, queue AS (SELECT * FROM seen WHERE now_status IN ('new', 'quarantined') OR (now_status = 'active' AND {STALE_CHECK})),
checked AS (
  SELECT q.id, o.reachable AS ok, CASE WHEN o.reachable THEN o.latency_ms END AS new_latency, q.now_status AS before,
    CASE WHEN o.reachable THEN 0 ELSE q.consecutive_failures + 1 END AS fails, q.check_count + 1 AS checks,
    q.pass_count + CAST(o.reachable AS INT) AS passes, q.last_passed_at, q.service_status, q.anonymity, q.trust,
    CASE WHEN o.reachable THEN 0.0 ELSE date_diff('millisecond', q.last_passed_at, {TS}) / 60000.0 END AS idle
  FROM {LATEST.format("fx_checks")} o JOIN queue q ON q.id = o.proxy_id WHERE o.nth = 1),
scored AS (SELECT *, {score_sql(dict(
    passed="ok", latency="new_latency", checks="checks", passes="passes", fails="fails", minutes="idle",
    service="service_status", trust="least(CAST(trust AS DOUBLE), 1.0)", anonymity="anonymity"))["score"]} AS new_score FROM checked),
planned AS (SELECT *, CASE WHEN ok AND new_score >= 25 THEN 'active' WHEN ok THEN 'quarantined'
    WHEN fails >= 9 AND last_passed_at IS NULL THEN 'dead' WHEN fails >= 3 THEN 'quarantined'
    WHEN before IN ('active', 'quarantined') THEN before ELSE 'new' END AS new_status FROM scored),
validated AS (
  SELECT s.id, coalesce(p.new_status, CASE WHEN q.id IS NOT NULL THEN 'pending' ELSE s.now_status END) AS status,
    CASE WHEN p.id IS NULL THEN s.validation_status WHEN p.ok THEN 'passed' ELSE 'failed' END AS validation_status,
    CASE WHEN p.id IS NULL THEN s.score ELSE p.new_score END AS score, coalesce(p.fails, s.consecutive_failures) AS consecutive_failures,
    CASE WHEN coalesce(p.ok, false) THEN {TS} ELSE s.last_passed_at END AS last_passed_at, s.service_status, s.service_checked_at,
    q.id IS NOT NULL AS queued
  FROM seen s LEFT JOIN queue q ON q.id = s.id LEFT JOIN planned p ON p.id = s.id),
wanted AS (
  SELECT * FROM validated WHERE queued AND validation_status = 'passed' AND score >= 10 AND service_status <> 'passed'
  UNION
  SELECT * FROM validated WHERE status = 'active' AND score >= 10 AND coalesce(service_checked_at < {TS} - INTERVAL '360' MINUTE, true)),
probed AS (
  SELECT w.id, o.status AS verdict FROM wanted w JOIN {LATEST.format("fx_service")} o ON o.proxy_id = w.id AND o.nth = 1),
served AS (
  SELECT v.*, CASE WHEN p.verdict = 'passed' THEN 'active' ELSE v.status END AS last_status
  FROM validated v LEFT JOIN probed p ON p.id = v.id),
swept AS (
  SELECT *, CASE WHEN last_status = 'active' AND coalesce(last_passed_at < {TS} - INTERVAL '90' MINUTE, true) THEN 'expired'
    WHEN last_status = 'active' AND consecutive_failures >= 3 THEN 'quarantined' END AS sweep FROM served)
"""


# Ranges of addresses that are not public.
CLOSED = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
]
NUMBER = "list_reduce(list_transform(string_split({}, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b)"
# The endpoints behind the merge of all accepted candidates.
SEEN = f"""
, closed AS (SELECT {NUMBER.format("base")} AS low, {NUMBER.format("base")} + CAST(pow(2, 32 - bits) AS BIGINT) AS high
  FROM (VALUES {", ".join(map(str, CLOSED))}) AS t(base, bits)),
accepted AS (
  SELECT *, entry_key AS key FROM merged m WHERE NOT EXISTS (SELECT 1 FROM closed WHERE {NUMBER.format("m.host")} >= low AND {NUMBER.format("m.host")} < high)),
old AS (SELECT *, concat(protocol, '|', host, '|', port, '|', coalesce(username, '')) AS key FROM fx_endpoints),
inserted AS (SELECT * FROM accepted WHERE key NOT IN (SELECT key FROM old)),
seen AS (
  SELECT o.id, o.status, o.validation_status, o.service_status, o.score, o.latency_ms, o.consecutive_failures, o.check_count, o.pass_count,
    o.last_checked_at, o.last_passed_at, o.service_checked_at, o.anonymity,
    CASE WHEN o.status = 'dead' AND a.key IS NOT NULL THEN 'new' ELSE o.status END AS now_status, coalesce(a.trust, 0.5) AS trust
  FROM old o LEFT JOIN accepted a ON a.key = o.key
  UNION ALL
  SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY source_ord, line_no), 'new', 'unchecked', 'untested', 0.0, NULL, 0, 0, 0,
    NULL, NULL, NULL, 'unknown', 'new', coalesce(trust, 0.5) FROM inserted)
"""


@query(
    FEED
    + ", "
    + ",\n".join(f"{name} AS ({fx.VIEWS[name]})" for name in ("fx_endpoints", "fx_checks", "fx_service"))
    + SEEN
    + CYCLE_SQL
    + """
SELECT 'cyc_now' AS cycle_id, (SELECT count(*) FROM feed) AS discovered, (SELECT count(*) FROM merged) AS accepted,
  (SELECT count(*) FROM entries WHERE outcome = 'rejected') AS rejected,
  (SELECT count(*) FROM entries WHERE outcome = 'accepted') - (SELECT count(*) FROM merged) AS duplicates,
  (SELECT count(*) FROM sources) AS sources_ok, 0 AS sources_failed,
  (SELECT count(*) FROM merged) - (SELECT count(*) FROM accepted) AS blocked_by_policy, (SELECT count(*) FROM inserted) AS inserted,
  (SELECT count(*) FROM queue) AS queued, (SELECT count(*) FROM planned WHERE ok AND new_status = 'active' AND before <> 'active') AS added,
  (SELECT count(*) FROM swept WHERE last_status = 'active' AND sweep IS NULL) AS pool_size"""
)
def cycle_report(spark, sf_dir):
    """One refresh cycle over all inputs, as its report."""
    # A cycle reads its endpoints as they are stored, more than once.
    result = run_cycle(
        cut_lineage(conform(keyed(fx.endpoints(spark, sf_dir)), ENDPOINTS)),
        cycle_inputs(spark, sf_dir),
        "cyc_now",
        fx.NOW,
        CycleConfig(ScoreConfig(), QueueConfig(), ServiceConfig()),
    )
    return result.report.select("cycle_id", "discovery.*", "policy.*", "upsert.inserted", "queue.*", F.col("validation.added"), "pool.pool_size")


