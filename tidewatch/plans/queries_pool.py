"""Queries over the endpoint table and its history: reads, ranks, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..config import QueueConfig, ServiceConfig
from ..functions import score as S
from ..functions.text import iso_text
from ..operators import history, pool, stats
from ..schemas import PROTOCOLS
from . import documents
from .registry import TS, half_up, iso, query

FRESH = f"last_passed_at >= {TS} - INTERVAL '90' MINUTE"
POOL = f"status = 'active' AND {FRESH} AND service_status = 'passed'"
RANK = "score DESC, latency_ms ASC NULLS LAST, id ASC"
PUBLIC = f"""id, host, port, protocol, source, {half_up("score", 2)} AS score, latency_ms, country, anonymity,
  {iso("last_passed_at")} AS last_passed"""


def _page(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"""SELECT {PUBLIC}, (SELECT count(*) FROM fx_endpoints WHERE {where}) AS pool_size
FROM fx_endpoints WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"""


def _read(spark, sf_dir, **kw):
    page = pool.read_pool(fx.endpoints(spark, sf_dir), pool.PoolQuery(**kw), fx.NOW)
    return page.withColumn("last_passed", iso_text(F.col("last_passed")))


@query(_page(POOL, RANK, 50), ("fx_endpoints",))
def pool_read(spark, sf_dir):
    return _read(spark, sf_dir)


@query(_page(f"status = 'active' AND {FRESH}", f"service_status = 'passed' DESC, {RANK}", 60, 10), ("fx_endpoints",))
def pool_read_preferred(spark, sf_dir):
    return _read(spark, sf_dir, service="preferred", limit=60, offset=10)


@query(
    _page(
        f"status = 'active' AND {FRESH} AND score >= 30 AND protocol = 'https' AND country = 'NA' AND latency_ms <= 2500",
        RANK,
        50,
    ),
    ("fx_endpoints",),
)
def pool_read_filtered(spark, sf_dir):
    return _read(
        spark, sf_dir, service="off", min_score=30, protocol="https", country="na", max_latency_ms=2500
    )


@query("SELECT id, score, status FROM fx_endpoints WHERE status = 'quarantined' ORDER BY score DESC, id LIMIT 40 OFFSET 5", ("fx_endpoints",))
def list_by_status(spark, sf_dir):
    return pool.list_by_status(fx.endpoints(spark, sf_dir), "quarantined", 40, 5).select("id", "score", "status")


@query(f"SELECT id, score, latency_ms FROM fx_endpoints ORDER BY {RANK}", ("fx_endpoints",))
def sort_by_score(spark, sf_dir):
    return pool.sort_by_score(fx.view(spark, sf_dir, "fx_endpoints")).select("id", "score", "latency_ms")


@query(f"SELECT {PUBLIC} FROM fx_endpoints", ("fx_endpoints",))
def public_view(spark, sf_dir):
    shown = pool.public_view(fx.endpoints(spark, sf_dir))
    return shown.withColumn("last_passed", iso_text(F.col("last_passed")))


@query(
    f"""SELECT id, status = 'active' AND score >= 25 AND coalesce({FRESH}, false) AND service_status = 'passed'
    AND coalesce(latency_ms <= 2000, true) AS eligible,
  coalesce(last_passed_at < {TS} - INTERVAL '90' MINUTE, true) AS expired, consecutive_failures >= 3 AS worn,
  score >= 10 AND service_status <> 'passed' AND service_status <> 'blocked' AS wants_service
FROM fx_endpoints""",
    ("fx_endpoints",),
)
def pool_eligible(spark, sf_dir):
    c = F.col
    return fx.view(spark, sf_dir, "fx_endpoints").select(
        "id",
        S.pool_eligible(
            c("status"), c("score"), c("last_passed_at"), c("service_status"), c("latency_ms"), fx.NOW, max_latency=2000
        ).alias("eligible"),
        S.is_expired(c("last_passed_at"), fx.NOW).alias("expired"),
        S.should_quarantine(c("consecutive_failures")).alias("worn"),
        S.should_check_service(c("score"), c("service_status"), 10, False).alias("wants_service"),
    )


@query(
    """SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'quarantined') AS quarantined,
  count(*) FILTER (status = 'dead') AS dead, count(*) FILTER (status = 'new') AS "new",
  count(*) FILTER (status = 'pending') AS pending, count(*) AS total FROM fx_endpoints""",
    ("fx_endpoints",),
)
def status_counts(spark, sf_dir):
    return stats.count_by_status(fx.endpoints(spark, sf_dir))


@query(
    f"""SELECT p.protocol, count(e.id) AS n FROM (VALUES ('http'), ('https'), ('socks4'), ('socks5')) p(protocol)
LEFT JOIN (SELECT * FROM fx_endpoints WHERE {POOL}) e ON e.protocol = p.protocol GROUP BY p.protocol""",
    ("fx_endpoints",),
)
def protocol_breakdown(spark, sf_dir):
    return stats.protocol_breakdown(fx.endpoints(spark, sf_dir), stats.in_pool(fx.NOW))


STATS = f"""
, pooled AS (SELECT * FROM fx_endpoints WHERE {POOL}),
ranked AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS nth, count(*) OVER () AS n FROM pooled WHERE latency_ms IS NOT NULL),
rated AS (SELECT sum(check_count) AS checks, sum(pass_count) AS passes FROM fx_endpoints WHERE status IN ('active', 'quarantined'))
"""
STATS_ROW = f"""SELECT count(*) FILTER (status = 'active') AS pool_size, count(*) FILTER (status = 'active') AS active,
  count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'dead') AS dead,
  count(*) FILTER (status = 'pending') AS pending, count(*) AS total_known,
  {", ".join(f"(SELECT count(*) FROM pooled WHERE protocol = '{p}') AS {p}" for p in PROTOCOLS)},
  (SELECT CAST({half_up("avg(latency_ms)")} AS BIGINT) FROM pooled) AS avg_latency_ms,
  (SELECT max(latency_ms) FROM ranked WHERE nth = greatest(1, CAST(ceil(n * 0.95) AS BIGINT))) AS p95_latency_ms,
  (SELECT min(latency_ms) FROM pooled) AS min_latency_ms, (SELECT max(latency_ms) FROM pooled) AS max_latency_ms,
  (SELECT {half_up("avg(score)", 1)} FROM pooled) AS avg_score,
  (SELECT {half_up("passes / checks", 4)} FROM rated) AS pass_rate,
  (SELECT count(*) FROM pooled) AS service_passed, {iso("coalesce(max(last_checked_at), max(last_passed_at))")} AS last_update
FROM fx_endpoints"""


@query(STATS + STATS_ROW, ("fx_endpoints",))
def pool_stats(spark, sf_dir):
    """Every pool statistic in one scan."""
    row = stats.pool_stats(fx.endpoints(spark, sf_dir), fx.NOW)
    return row.withColumn("last_update", iso_text(F.col("last_update")))


@query(STATS + "SELECT max(latency_ms) AS p95 FROM ranked WHERE nth = greatest(1, CAST(ceil(n * 0.95) AS BIGINT))", ("fx_endpoints",))
def latency_p95(spark, sf_dir):
    pooled = fx.endpoints(spark, sf_dir).filter(stats.in_pool(fx.NOW))
    return pooled.agg(stats.nearest_rank("latency_ms", 0.95).cast("bigint").alias("p95"))


@query(
    """, r AS (SELECT cycle_id, latency_ms, row_number() OVER (PARTITION BY cycle_id ORDER BY latency_ms) AS nth,
    count(*) OVER (PARTITION BY cycle_id) AS n FROM fx_checks WHERE latency_ms IS NOT NULL)
SELECT cycle_id, max(latency_ms) FILTER (nth = ceil(n * 0.5)) AS p50, max(latency_ms) FILTER (nth = ceil(n * 0.9)) AS p90,
  CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS mean FROM r GROUP BY cycle_id""",
    ("fx_checks",),
)
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles and the rounded mean per cycle."""
    checks = fx.view(spark, sf_dir, "fx_checks").filter("latency_ms is not null")
    return checks.groupBy("cycle_id").agg(
        *[stats.nearest_rank("latency_ms", p / 100).cast("bigint").alias(f"p{p}") for p in (50, 90)],
        stats.average("latency_ms").alias("mean"),
    )


@query(STATS + f"SELECT {half_up('passes / checks', 4)} AS pass_rate FROM rated", ("fx_endpoints",))
def pass_rate(spark, sf_dir):
    rated = fx.endpoints(spark, sf_dir).filter("status in ('active', 'quarantined')")
    return rated.agg(stats.pass_rate(F.sum("check_count"), F.sum("pass_count")).alias("pass_rate"))


@query(
    f"""SELECT cycle_id, service, count(*) AS checked, count(*) FILTER (status = 'passed') AS passed,
  count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'failed') AS failed,
  CAST({half_up("avg(latency_ms) FILTER (status = 'passed')")} AS BIGINT) AS avg_latency_ms, {iso("max(created_at)")} AS last_check
FROM fx_service GROUP BY cycle_id, service""",
    ("fx_service",),
)
def service_summary(spark, sf_dir):
    summary = stats.service_summary(fx.view(spark, sf_dir, "fx_service"))
    return summary.withColumn("last_check", iso_text(F.col("last_check")))


@query(f"SELECT count(*) FILTER ({POOL}) AS valid FROM fx_endpoints", ("fx_endpoints",))
def valid_now(spark, sf_dir):
    return stats.currently_valid(fx.endpoints(spark, sf_dir), fx.NOW)


@query(
    f"""SELECT count(*) FILTER (status = 'active' AND service_status = 'passed'
  AND service_checked_at >= {TS} - INTERVAL '360' MINUTE) AS fresh FROM fx_endpoints""",
    ("fx_endpoints",),
)
def fresh_verdicts(spark, sf_dir):
    return stats.fresh_verdicts(fx.endpoints(spark, sf_dir), fx.NOW)


@query("SELECT cycle_id, error_code, count(*) AS n FROM fx_checks WHERE NOT reachable GROUP BY cycle_id, error_code", ("fx_checks",))
def error_breakdown(spark, sf_dir):
    return stats.error_breakdown(fx.view(spark, sf_dir, "fx_checks"))


@query(
    """SELECT reason, count(*) AS n FROM fx_service WHERE service = 'svc-a' AND NOT passed
  AND cycle_id = (SELECT cycle_id FROM fx_service WHERE service = 'svc-a' ORDER BY created_at DESC, id DESC LIMIT 1)
GROUP BY reason""",
    ("fx_service",),
)
def reason_breakdown(spark, sf_dir):
    return stats.reason_breakdown(fx.view(spark, sf_dir, "fx_service"), "svc-a")


@query(
    """SELECT count(*) AS checked, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'blocked') AS blocked,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM fx_service""",
    ("fx_service",),
)
def service_tally(spark, sf_dir):
    return stats.service_tally(fx.view(spark, sf_dir, "fx_service"))


@query(
    """SELECT 'endpoints' AS table_name, count(*) AS n FROM fx_endpoints UNION ALL SELECT 'checks', count(*) FROM fx_checks
UNION ALL SELECT 'service_checks', count(*) FROM fx_service UNION ALL SELECT 'cycles', count(*) FROM fx_cycles""",
    ("fx_endpoints", "fx_checks", "fx_service", "fx_cycles"),
)
def table_counts(spark, sf_dir):
    names = {"endpoints": "fx_endpoints", "checks": "fx_checks", "service_checks": "fx_service", "cycles": "fx_cycles"}
    return stats.table_counts(**{name: fx.view(spark, sf_dir, source) for name, source in names.items()})


OLDEST = "last_checked_at ASC NULLS FIRST, id"
QUEUE = f"""
, queue AS (
  SELECT id, 0 AS branch, row_number() OVER (ORDER BY id) AS pos FROM fx_endpoints WHERE status = 'new'
  UNION ALL SELECT id, 1, row_number() OVER (ORDER BY {OLDEST}) FROM fx_endpoints WHERE status = 'quarantined'
  UNION ALL SELECT id, 2, row_number() OVER (ORDER BY {OLDEST}) FROM fx_endpoints
    WHERE status = 'active' AND (last_checked_at IS NULL OR last_checked_at < {TS} - INTERVAL '15' MINUTE))
"""


@query(QUEUE + "SELECT id, branch, pos FROM queue", ("fx_endpoints",))
def validation_queue(spark, sf_dir):
    """The whole queue."""
    return pool.validation_queue(fx.endpoints(spark, sf_dir), fx.NOW).select("id", "branch", "pos")


DUE = f"status = 'active' AND score >= 10 AND (service_checked_at IS NULL OR service_checked_at < {TS} - INTERVAL '360' MINUTE)"
BEST = "score DESC, latency_ms ASC NULLS FIRST, id"


@query(
    f"SELECT id, score, latency_ms, row_number() OVER (ORDER BY {BEST}) AS pos FROM fx_endpoints WHERE {DUE}",
    ("fx_endpoints",),
)
def service_candidates(spark, sf_dir):
    """All pool members that are due, with their place."""
    return pool.service_candidates(fx.endpoints(spark, sf_dir), fx.NOW, None).select("id", "score", "latency_ms", "pos")


@query(
    QUEUE
    + f"""
, fresh AS (SELECT id, 0 AS branch, row_number() OVER (ORDER BY score DESC, id) AS pos FROM fx_endpoints
    WHERE id IN (SELECT id FROM queue) AND validation_status = 'passed' AND score >= 10 AND service_status <> 'passed'),
due AS (SELECT id, row_number() OVER (ORDER BY {BEST}) AS pos FROM fx_endpoints WHERE {DUE})
SELECT id, branch, pos FROM fresh UNION ALL SELECT id, 1, pos FROM due WHERE id NOT IN (SELECT id FROM fresh)""",
    ("fx_endpoints",),
)
def cycle_service_selection(spark, sf_dir):
    """All service checks that are due after a whole queue."""
    endpoints = fx.endpoints(spark, sf_dir)
    queue = pool.validation_queue(endpoints, fx.NOW)
    return pool.cycle_service_selection(endpoints, queue, fx.NOW).select("id", "branch", "pos")


BUDGETED = f"""
, picked AS (
  SELECT * FROM (SELECT id, 0 AS branch, row_number() OVER (ORDER BY id) AS pos FROM fx_endpoints WHERE status = 'new') WHERE pos <= 60
  UNION ALL SELECT * FROM (SELECT id, 1, row_number() OVER (ORDER BY last_checked_at ASC NULLS FIRST, id) AS pos
    FROM fx_endpoints WHERE status = 'quarantined') WHERE pos <= 40
  UNION ALL SELECT * FROM (SELECT id, 2, row_number() OVER (ORDER BY last_checked_at ASC NULLS FIRST, id) AS pos FROM fx_endpoints
    WHERE status = 'active' AND (last_checked_at IS NULL OR last_checked_at < {TS} - INTERVAL '15' MINUTE)) WHERE pos <= 50),
queue AS (SELECT * FROM picked ORDER BY branch, pos LIMIT 120)
"""
LIMITS = QueueConfig(new_limit=60, quarantine_limit=40, recheck_limit=50, max_per_cycle=120)


@query(
    BUDGETED
    + f"""
, fresh AS (SELECT id, 0 AS branch FROM fx_endpoints WHERE id IN (SELECT id FROM queue) AND validation_status = 'passed'
    AND score >= 10 AND service_status <> 'passed' ORDER BY score DESC, id LIMIT 70),
due AS (SELECT id, row_number() OVER (ORDER BY score DESC, latency_ms ASC NULLS FIRST, id) AS pos FROM fx_endpoints WHERE {DUE})
SELECT id, branch FROM fresh
UNION ALL SELECT id, 1 FROM due WHERE pos <= 70 - (SELECT count(*) FROM fresh) AND id NOT IN (SELECT id FROM fresh)""",
    ("fx_endpoints",),
)
def cycle_service_budget(spark, sf_dir):
    """The selection under the limits of a queue and a budget."""
    endpoints = fx.endpoints(spark, sf_dir)
    queue = pool.validation_queue(endpoints, fx.NOW, LIMITS)
    chosen = pool.cycle_service_selection(endpoints, queue, fx.NOW, ServiceConfig(budget_per_cycle=70))
    return chosen.select("id", "branch")


@query(
    f""", top AS (SELECT *, sum(greatest(score, 1)) OVER (ORDER BY {RANK} ROWS UNBOUNDED PRECEDING) AS upto,
    sum(greatest(score, 1)) OVER () AS total FROM fx_endpoints WHERE {POOL})
SELECT id, score FROM top WHERE upto >= 0.37 * total ORDER BY upto LIMIT 1""",
    ("fx_endpoints",),
)
def weighted_pick(spark, sf_dir):
    matching = fx.endpoints(spark, sf_dir).filter(pool.pool_filter(pool.PoolQuery(), fx.NOW))
    return pool.weighted_pick(matching, 0.37).select("id", "score")


# History ----------------------------------------------------------------------


@query(
    f"""SELECT cycle_id, status, {iso("finished_at")} AS finished_at, candidates_checked FROM fx_cycles
WHERE status = 'completed' ORDER BY fx_cycles.finished_at DESC LIMIT 1""",
    ("fx_cycles",),
)
def cycles_latest(spark, sf_dir):
    last = history.latest_completed(fx.view(spark, sf_dir, "fx_cycles"))
    return last.select("cycle_id", "status", iso_text(F.col("finished_at")).alias("finished_at"), "candidates_checked")


@query("SELECT cycle_id, status, candidates_passed FROM fx_cycles", ("fx_cycles",))
def cycles_list(spark, sf_dir):
    cycles = fx.view(spark, sf_dir, "fx_cycles")
    return history.list_cycles(cycles).select("cycle_id", "status", "candidates_passed")


@query(
    """SELECT proxy_id, id, nth FROM (SELECT proxy_id, id, row_number() OVER (PARTITION BY proxy_id ORDER BY created_at DESC, id DESC) AS nth
FROM fx_checks) WHERE nth <= 5""",
    ("fx_checks",),
)
def recent_checks(spark, sf_dir):
    return history.recent_per_endpoint(fx.view(spark, sf_dir, "fx_checks"), 5).select("proxy_id", "id", "nth")


@query(
    """SELECT proxy_id, service, id, status, passed FROM (SELECT *, row_number() OVER (PARTITION BY proxy_id, service
  ORDER BY created_at DESC, id DESC) AS nth FROM fx_service) WHERE nth = 1""",
    ("fx_service",),
)
def latest_service(spark, sf_dir):
    latest = history.latest_result(fx.view(spark, sf_dir, "fx_service"))
    return latest.select("proxy_id", "service", "id", "status", "passed")


@query("SELECT id, status, reason FROM fx_service WHERE cycle_id = 'cyc_7' AND service = 'svc-b'", ("fx_service",))
def results_by_cycle(spark, sf_dir):
    results = history.results_of_cycle(fx.view(spark, sf_dir, "fx_service"), "cyc_7", service="svc-b")
    return results.select("id", "status", "reason")


@query(
    f"""SELECT {iso("f")} AS last_check, {iso("f + INTERVAL '15' MINUTE")} AS next_check,
  CAST(greatest(0, floor(date_diff('millisecond', {TS}, f + INTERVAL '15' MINUTE) / 1000.0 + 0.5)) AS BIGINT) AS seconds_until
FROM (SELECT max(finished_at) AS f FROM fx_cycles WHERE status = 'completed')""",
    ("fx_cycles",),
)
def next_check(spark, sf_dir):
    due = history.next_check(fx.view(spark, sf_dir, "fx_cycles"), None, fx.NOW)
    return due.select(
        *[iso_text(F.col(name)).alias(name) for name in ("last_check", "next_check")], "seconds_until"
    )


DEAD_SINCE = "CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-30 00:00:00' END"


@query(
    f"""SELECT (SELECT count(*) FROM fx_checks WHERE created_at < {TS} - INTERVAL '7' DAY) AS checks,
  (SELECT count(*) FROM fx_service WHERE created_at < {TS} - INTERVAL '7' DAY) AS service_checks,
  (SELECT count(*) FROM fx_endpoints WHERE status = 'dead' AND last_passed_at IS NULL AND id % 3 = 0) AS endpoints,
  (SELECT count(*) FROM fx_cycles WHERE finished_at < {TS} - INTERVAL '30' DAY) AS cycles,
  (SELECT count(*) FROM fx_checks WHERE created_at >= {TS} - INTERVAL '7' DAY AND proxy_id NOT IN
    (SELECT id FROM fx_endpoints WHERE status = 'dead' AND last_passed_at IS NULL AND id % 3 = 0)) AS kept_checks""",
    ("fx_endpoints", "fx_checks", "fx_service", "fx_cycles"),
)
def prune_history(spark, sf_dir):
    endpoints = fx.endpoints(spark, sf_dir).withColumn("last_seen", F.expr(fx.spark_sql_text(DEAD_SINCE)))
    kept = history.prune_history(
        endpoints, *[fx.view(spark, sf_dir, name) for name in ("fx_checks", "fx_service", "fx_cycles")], fx.NOW
    )
    return kept["counts"].withColumn("kept_checks", kept["checks"].agg(F.count("*").alias("n")).scalar())


META_SQL = """SELECT concat('key-', CAST(user_id % 40 AS STRING)) AS key, CASE WHEN event_id % 5 = 0 THEN 'no json'
  ELSE concat('{"n":', CAST(event_id AS STRING), '}') END AS value, ts AS updated_at, event_type = 'error' AS deleted FROM events"""


@query(
    f""", m AS ({META_SQL}), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC) AS nth FROM m)
SELECT key, value, CASE WHEN value LIKE '{{%' THEN CAST(regexp_extract(value, '[0-9]+') AS BIGINT) END AS n
FROM l WHERE nth = 1 AND NOT deleted"""
)
def meta_latest(spark, sf_dir):
    """Current value per key of an appended key/value log."""
    rows = history.meta_latest(fx.sql(spark, sf_dir, META_SQL))
    return rows.select("key", "value", F.try_variant_get(F.try_parse_json("value"), "$.n", "bigint").alias("n"))


# Documents --------------------------------------------------------------------


@query(
    STATS
    + f""", s AS ({STATS_ROW})
SELECT 'up' AS metric, '' AS label, 1.0 AS value UNION ALL SELECT 'pool_size', '', pool_size FROM s
UNION ALL SELECT 'proxies', 'active', active FROM s UNION ALL SELECT 'proxies', 'quarantined', quarantined FROM s
UNION ALL SELECT 'proxies', 'dead', dead FROM s UNION ALL SELECT 'proxies', 'pending', pending FROM s
UNION ALL SELECT 'service_passed', 'svc-a', service_passed FROM s UNION ALL SELECT 'avg_latency_ms', '', coalesce(avg_latency_ms, 0) FROM s
UNION ALL SELECT 'cycles_total', 'completed', (SELECT count(*) FROM fx_cycles WHERE status = 'completed')
UNION ALL SELECT 'cycles_total', 'failed', (SELECT count(*) FROM fx_cycles WHERE status = 'failed')""",
    ("fx_endpoints", "fx_cycles"),
)
def pool_metrics(spark, sf_dir):
    row = stats.pool_stats(fx.endpoints(spark, sf_dir), fx.NOW)
    long = documents.pool_metrics(row, fx.view(spark, sf_dir, "fx_cycles"), "svc-a")
    return long.select("metric", F.array_join(F.map_values("labels"), ",").alias("label"), "value")


@query(
    f""", page AS (SELECT *, count(*) OVER () AS total FROM fx_endpoints WHERE {POOL} ORDER BY {RANK} LIMIT 20)
SELECT 200 AS status, max(total) AS pool_size, count(*) AS shown, string_agg(CAST(id AS VARCHAR), ',' ORDER BY {RANK}) AS ids,
  {iso(f"first(last_passed_at ORDER BY {RANK})")} AS last_update, false AS leaks FROM page""",
    ("fx_endpoints",),
)
def public_envelope(spark, sf_dir):
    """The JSON document of a pool page, read back."""
    page = pool.read_pool(fx.endpoints(spark, sf_dir), pool.PoolQuery(limit=20), fx.NOW)
    sent = documents.envelope(page, "svc-a", "req_1", fx.NOW)
    doc = F.from_json(
        "body",
        "ok BOOLEAN, data STRUCT<pool_size: BIGINT, count: BIGINT, proxies: ARRAY<STRUCT<id: BIGINT>>>, "
        "meta STRUCT<last_update: STRING>",
    )
    return sent.select(
        "status",
        doc["data"]["pool_size"].alias("pool_size"),
        doc["data"]["count"].alias("shown"),
        F.array_join(F.transform(doc["data"]["proxies"], lambda p: p["id"].cast("string")), ",").alias("ids"),
        doc["meta"]["last_update"].alias("last_update"),
        F.col("body").rlike("username|password").alias("leaks"),
    )


PARAMS = """SELECT event_id AS id, event_id % 6 AS a, event_id % 7 AS b, event_id % 5 AS c, user_id FROM events"""


@query(
    f""", p AS ({PARAMS}), q AS (SELECT *, CASE WHEN b = 1 THEN 'invalid protocol "quic" (expected http, https, socks4 or socks5)'
    WHEN c = 2 THEN 'invalid country (expected a two letter ISO code)'
    WHEN a = 3 THEN 'invalid service filter (expected required, preferred or off)' END AS error FROM p)
SELECT id, CASE a WHEN 0 THEN 500 WHEN 1 THEN 50 WHEN 2 THEN 1 ELSE 50 END AS "limit",
  CASE WHEN error IS NULL THEN least(user_id, 100000) ELSE 0 END AS "offset", CASE WHEN error IS NULL AND b = 0 THEN 'socks5' END AS protocol,
  CASE WHEN error IS NULL AND c = 1 THEN 'DE' END AS country, CASE WHEN error IS NULL AND a = 4 THEN 'off' ELSE 'required' END AS service,
  CASE WHEN error IS NULL AND c = 3 THEN 600000 END AS max_latency_ms, a = 0 AS warned, error FROM q"""
)
def pool_requests(spark, sf_dir):
    """Pool queries read from a request log."""
    log = fx.sql(spark, sf_dir, PARAMS)
    param = lambda name, value: F.when(value.isNotNull(), F.create_map(F.lit(name), value))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    given = {
        "limit": F.when(a == 0, "700").when(a == 1, "4.5").when(a == 2, "-3"),
        "offset": F.col("user_id").cast("string"),
        "protocol": F.when(b == 0, "socks5").when(b == 1, "quic"),
        "country": F.when(c == 1, "de").when(c == 2, "germany"),
        "service": F.when(a == 3, "maybe").when(a == 4, "off"),
        "max_latency_ms": F.when(c == 3, "9999999"),
    }
    none = F.create_map().cast("map<string,string>")
    params = F.map_concat(*[F.coalesce(param(name, value), none) for name, value in given.items()])
    read = documents.pool_requests(log.select("id", params.alias("params")))
    return read.select(
        "id", "limit", "offset", "protocol", "country", "service", "max_latency_ms",
        (F.size("warnings") > 0).alias("warned"), "error",
    )


@query(
    f"""SELECT 'svc-a' AS service, (SELECT count(*) FROM fx_endpoints WHERE {POOL}) AS valid, {iso("finished_at")} AS last_check,
  {iso("finished_at + INTERVAL '15' MINUTE")} AS next_check, cycle_id, status, candidates_checked
FROM fx_cycles WHERE status = 'completed' ORDER BY fx_cycles.finished_at DESC LIMIT 1""",
    ("fx_endpoints", "fx_cycles"),
)
def tpool_summary(spark, sf_dir):
    row = documents.tpool_summary(
        fx.endpoints(spark, sf_dir), fx.view(spark, sf_dir, "fx_cycles"), "svc-a", fx.NOW
    )
    return row.select(
        "service", "valid", *[iso_text(F.col(n)).alias(n) for n in ("last_check", "next_check")],
        "cycle.cycle_id", "cycle.status", "cycle.candidates_checked",
    )


@query(
    """, last AS (SELECT cycle_id FROM fx_cycles WHERE status = 'completed' ORDER BY finished_at DESC LIMIT 1),
e AS (SELECT error_code, count(*) AS n FROM fx_checks WHERE NOT reachable AND cycle_id = (SELECT cycle_id FROM last)
  AND error_code IS NOT NULL GROUP BY error_code ORDER BY n DESC, error_code LIMIT 8),
r AS (SELECT reason, count(*) AS n FROM fx_service WHERE service = 'svc-a' AND NOT passed AND cycle_id =
  (SELECT cycle_id FROM fx_service WHERE service = 'svc-a' ORDER BY created_at DESC, id DESC LIMIT 1) GROUP BY reason ORDER BY n DESC, reason LIMIT 5)
SELECT (SELECT count(*) FROM fx_endpoints WHERE status = 'active') AS pool_size, (SELECT cycle_id FROM last) AS last_cycle,
  (SELECT string_agg(concat(error_code, '=', n), ',' ORDER BY n DESC, error_code) FROM e) AS errors,
  (SELECT string_agg(concat(reason, '=', n), ',' ORDER BY n DESC, reason) FROM r) AS reasons, 5000 AS max_active""",
    ("fx_endpoints", "fx_checks", "fx_service", "fx_cycles"),
)
def stats_document(spark, sf_dir):
    row = documents.stats_document(
        fx.endpoints(spark, sf_dir),
        *[fx.view(spark, sf_dir, name) for name in ("fx_cycles", "fx_checks", "fx_service")],
        "svc-a",
        fx.NOW,
        {"max_active": 5000, "interval_minutes": 15},
    )
    listed = lambda name: F.array_join(
        F.transform(name, lambda v: F.concat(v["code"], F.lit("="), v["count"].cast("string"))), ","
    )
    return row.select(
        "pool_size", F.col("last_cycle.cycle_id").alias("last_cycle"), listed("last_cycle_errors").alias("errors"),
        listed("last_cycle_service_reasons").alias("reasons"), F.col("setting_max_active").alias("max_active"),
    )
