"""Views of the star-schema test tables in the shape of the engine's own tables.

The SQL text is shared by Spark and by the DuckDB check; only the spelling of a
zone-free timestamp literal differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .schemas import ENDPOINTS, conform

NOW = "2024-01-31 00:00:00"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "fx_endpoints": """
SELECT c.c_custkey AS id,
  concat(CAST(1 + c.c_custkey % 223 AS STRING), '.', CAST((c.c_custkey * 7) % 256 AS STRING), '.',
         CAST((c.c_custkey * 13) % 256 AS STRING), '.', CAST((c.c_custkey * 29) % 256 AS STRING)) AS host,
  1024 + (c.c_custkey * 17) % 60000 AS port,
  CASE c.c_custkey % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'https' WHEN 2 THEN 'socks4' ELSE 'socks5' END AS protocol,
  CASE WHEN c.c_custkey % 5 = 0 THEN concat('user', CAST(c.c_custkey % 50 AS STRING)) END AS username,
  concat('src-', CAST(c.c_custkey % 6 AS STRING)) AS source,
  CASE WHEN c.c_custkey % 20 < 11 THEN 'active' WHEN c.c_custkey % 20 < 15 THEN 'quarantined'
       WHEN c.c_custkey % 20 < 17 THEN 'dead' WHEN c.c_custkey % 20 < 19 THEN 'new' ELSE 'pending' END AS status,
  CASE c.c_custkey % 3 WHEN 0 THEN 'failed' ELSE 'passed' END AS validation_status,
  CASE c.c_custkey % 7 WHEN 0 THEN 'untested' WHEN 1 THEN 'failed' WHEN 2 THEN 'blocked' WHEN 3 THEN 'skipped' ELSE 'passed' END AS service_status,
  CAST((c.c_custkey * 37) % 101 AS DOUBLE) AS score,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE 20 + (c.c_custkey * 53) % 3400 END AS latency_ms,
  upper(substring(n.n_name, 1, 2)) AS country,
  CASE c.c_custkey % 4 WHEN 0 THEN 'elite' WHEN 1 THEN 'anonymous' WHEN 2 THEN 'transparent' ELSE 'unknown' END AS anonymity,
  c.c_custkey % 5 AS consecutive_failures,
  1 + c.c_custkey % 30 AS check_count,
  (c.c_custkey * 7) % (2 + c.c_custkey % 30) AS pass_count,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' - ((c.c_custkey * 3) % 60) * INTERVAL '1' MINUTE END AS last_checked_at,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' - ((c.c_custkey * 13) % 240) * INTERVAL '1' MINUTE END AS last_passed_at,
  CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' - ((c.c_custkey * 11) % 900) * INTERVAL '1' MINUTE END AS service_checked_at
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
""",
    "fx_checks": """
SELECT event_id AS id, user_id AS proxy_id, concat('cyc_', CAST(day(ts) AS STRING)) AS cycle_id, ts AS created_at,
  event_type <> 'error' AS reachable,
  CASE WHEN event_type <> 'error' THEN CAST(floor(value * 10) AS BIGINT) + 1 END AS latency_ms,
  CASE WHEN event_type <> 'error' THEN NULL ELSE
    CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connect_refused' WHEN 2 THEN 'connect_reset' WHEN 3 THEN 'dns_error' ELSE 'proxy_auth_failed' END END AS error_code,
  1 + event_id % 2 AS attempts
FROM events
""",
    "fx_service": """
SELECT event_id AS id, user_id AS proxy_id, concat('cyc_', CAST(day(ts) AS STRING)) AS cycle_id,
  CASE event_id % 2 WHEN 0 THEN 'svc-a' ELSE 'svc-b' END AS service, ts AS created_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' WHEN 'click' THEN 'skipped' ELSE 'passed' END AS status,
  event_type IN ('view','purchase') AS passed,
  CAST(floor(value * 10) AS BIGINT) + 1 AS latency_ms,
  CASE event_type WHEN 'error' THEN 'transport_error:timeout' WHEN 'signup' THEN concat('denied:', CASE event_id % 3 WHEN 0 THEN '403' WHEN 1 THEN '451' ELSE '407' END)
       WHEN 'click' THEN 'rate_cooldown' END AS reason
FROM events
""",
    "fx_cycles": """
SELECT cycle_id, CASE WHEN max(id) % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, min(created_at) AS started_at, max(created_at) AS finished_at,
  count(*) AS candidates_checked, sum(CASE WHEN reachable THEN 1 ELSE 0 END) AS candidates_passed,
  sum(CASE WHEN reachable THEN 0 ELSE 1 END) AS candidates_failed FROM fx_checks GROUP BY cycle_id
""",
    "fx_lines": """
SELECT concat('src-', CAST(floor(c_custkey / 100) AS BIGINT)) AS source, c_custkey % 100 AS line_no,
  CASE c_custkey % 14
   WHEN 0 THEN 'SOCKS5'
   WHEN 1 THEN concat('http://', ip, ':', port)
   WHEN 2 THEN concat(ip, ':', port)
   WHEN 3 THEN concat('socks5h://', ip, ':', port, '/')
   WHEN 4 THEN concat(ip, ':', port, ':user', port, ':pw:us')
   WHEN 5 THEN concat('alice:s3cret@', ip, ':', port)
   WHEN 6 THEN concat('socks4:', ip, ':', port)
   WHEN 7 THEN '# comment'
   WHEN 8 THEN concat('ftp://', ip, ':', port)
   WHEN 9 THEN concat(ip, ':99999')
   WHEN 10 THEN concat('  ', ip, ' ', port, '  ')
   WHEN 11 THEN concat('[2001:DB8::', CAST(c_custkey % 90 + 10 AS STRING), ']:', port)
   WHEN 12 THEN '<html><body>blocked</body></html>'
   ELSE '1.2.3' END AS line
FROM (SELECT c_custkey,
   concat(CAST(1 + c_custkey % 223 AS STRING), '.', CAST((c_custkey * 7) % 256 AS STRING), '.', CAST(c_nationkey AS STRING), '.', CAST((c_custkey * 29) % 256 AS STRING)) AS ip,
   CAST(1024 + (c_custkey * 17) % 60000 AS STRING) AS port FROM customer) b
""",
    "fx_feeds": """
SELECT source, line_no, line FROM fx_lines
UNION ALL SELECT source, 1000 + line_no AS line_no, line FROM fx_lines WHERE line_no % 5 = 0
UNION ALL SELECT concat('copy-', source) AS source, line_no, line FROM fx_lines WHERE line_no % 3 = 0
""",
    "fx_responses": """
SELECT event_id AS id, user_id AS proxy_id, ts AS created_at,
  CASE WHEN event_type = 'error' THEN 0 ELSE
    CASE event_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 404 WHEN 4 THEN 204 WHEN 5 THEN 407 ELSE 200 END END AS status,
  CASE WHEN event_type = 'error' THEN
    CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connect_refused' WHEN 2 THEN 'proxy_auth_failed' ELSE 'blocked_by_policy' END END AS error_code,
  CASE event_id % 5 WHEN 0 THEN '<html>Just a moment... checking</html>' WHEN 1 THEN 'this is not the file' WHEN 2 THEN ''
    ELSE concat('User-agent: *', chr(10), 'Allow: /') END AS body_text,
  CASE WHEN event_id % 9 = 0 THEN CAST(event_id % 120 AS STRING) END AS retry_after,
  event_id % 31 = 0 AS truncated, event_id % 13 <> 0 AS robots_allowed,
  CAST(floor(value * 10) AS BIGINT) + 1 AS latency_ms
FROM events
""",
    "fx_jobs": """
SELECT event_id AS id, ts AS created_at,
  concat('{"job_id":"job_', CAST(event_id AS STRING), '","type":"',
    CASE event_id % 8 WHEN 0 THEN 'DISCOVER' WHEN 1 THEN 'VALIDATE' WHEN 2 THEN 'SERVICE_CHECK' WHEN 3 THEN 'RECHECK' WHEN 4 THEN 'POOL_UPDATE' WHEN 5 THEN 'STATS_UPDATE' WHEN 6 THEN 'NOPE' ELSE 'VALIDATE' END,
    '","cycle_id":"cyc_', CAST(day(ts) AS STRING), '"',
    CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(',"proxy_id":', CAST(user_id AS STRING)) END, '}') AS body
FROM events
""",
    "fx_attempts": """
SELECT o_custkey % 200 AS proxy_id, concat('cyc_', CAST(o_orderkey % 10 AS STRING)) AS cycle_id,
  CAST(row_number() OVER (PARTITION BY o_custkey % 200, o_orderkey % 10 ORDER BY o_orderkey) AS INT) AS attempt,
  CASE o_orderkey % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connect_reset' WHEN 2 THEN 'connect_refused' END AS error_code,
  CASE WHEN o_orderkey % 4 = 3 THEN 204 ELSE 0 END AS status, 20 + o_orderkey % 900 AS latency_ms
FROM orders
""",
    "fx_robots": """
SELECT * FROM (VALUES
  ('example.com', 200, concat('User-agent: *', chr(10), 'Disallow: /fr/', chr(10), 'Allow: /fr/8', chr(10), 'Crawl-delay: 0.05')),
  ('example.net', 200, concat('User-agent: databot', chr(10), 'Disallow: /*.html$', chr(10), 'User-agent: *', chr(10), 'Disallow: /')),
  ('example.org', 404, '')) AS t(domain, status, body)
""",
    "fx_urls": """
SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  regexp_extract(url, '(example[.][a-z]+)', 1) AS domain FROM pages
""",
}

# Views that read other views.
NEEDS = {"fx_cycles": ["fx_checks"], "fx_feeds": ["fx_lines"]}


def with_clause(*names: str) -> str:
    """``WITH`` text for the DuckDB side."""
    ordered: list[str] = []
    for name in names:
        ordered += [need for need in NEEDS.get(name, []) if need not in ordered]
        if name not in ordered:
            ordered.append(name)
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)


def spark_sql_text(text: str) -> str:
    """The same text with Spark's zone-free timestamp literal."""
    return text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, read in place."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_endpoints`` with every column of the endpoint table."""
    return conform(view(spark, sf_dir, "fx_endpoints"), ENDPOINTS)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of :data:`VIEWS` over the tables of ``sf_dir``."""
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a query text over the test tables and the fixture views it names."""
    frames = {
        name: table(spark, sf_dir, name) if name in TABLES else view(spark, sf_dir, name)
        for name in (*TABLES, *VIEWS)
        if re.search(rf"\b(FROM|JOIN) {name}\b", text)
    }
    # Frames are passed by name, so no temporary view is left in the session.
    body = re.sub(
        r"\b(FROM|JOIN) (" + "|".join(frames) + r")\b", lambda m: f"{m[1]} {{{m[2]}}}", _braces(text)
    )
    return spark.sql(spark_sql_text(body), **frames)


def _braces(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")
