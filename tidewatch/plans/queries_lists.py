"""Queries over long lists: many rules per origin, allow lists as tables, samples per group, rules as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import url as U
from ..operators import merge, pool, robots, rules, stats
from ..session import shared_folder
from ..streaming.jobs import run_jobs
from .registry import query

# Robots files whose rules are made of the paths themselves: one rule per page, many per origin.
PATTERNS = """SELECT host, page_id, CASE WHEN page_id % 2 = 0 THEN 'allow' ELSE 'disallow' END AS kind,
  CASE page_id % 5 WHEN 0 THEN path WHEN 1 THEN substring(path, 1, CAST(2 + page_id % 6 AS INT)) WHEN 2 THEN concat(path, '$')
    WHEN 3 THEN concat(substring(path, 1, CAST(1 + page_id % 4 AS INT)), '*', CAST(page_id % 10 AS STRING), '$')
    ELSE concat('*', CAST(page_id % 100 AS STRING)) END AS pattern
FROM (SELECT page_id, host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM fx_urls) p"""


@query(
    f""", p AS (SELECT page_id, host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM fx_urls),
r AS (SELECT DISTINCT host, kind, pattern, length(pattern) AS size,
  '^' || replace(replace(regexp_replace(pattern, '[$]$', ''), '.', '[.]'), '*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END AS regex
  FROM ({PATTERNS}) WHERE pattern <> ''),
own AS (SELECT DISTINCT host, path FROM p),
best AS (
  SELECT o.host, o.path, coalesce(max(r.size) FILTER (kind = 'allow'), -1) AS yes, coalesce(max(r.size) FILTER (kind = 'disallow'), -1) AS no
  FROM own o LEFT JOIN r ON r.host = o.host AND regexp_matches(o.path, r.regex) GROUP BY o.host, o.path)
SELECT p.page_id, CASE WHEN yes = -1 AND no = -1 THEN 'no_rules' WHEN yes > no THEN 'allow' ELSE 'disallow' END AS reason,
  NOT (no >= yes AND no >= 0) AS allowed FROM p JOIN best b ON b.host = p.host AND b.path = p.path""",
    ("fx_urls",),
)
def robots_many_rules(spark, sf_dir):
    """Decisions over origins with a rule per page, met by their prefixes."""
    urls = fx.view(spark, sf_dir, "fx_urls").select("page_id", "host", U.path_of(F.col("url")).alias("path"))
    listed = fx.sql(spark, sf_dir, PATTERNS)
    own = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("pattern")))
    table = listed.groupBy("host").agg(own("allow").alias("allow"), own("disallow").alias("disallow"))
    table = table.withColumn("crawl_delay", F.lit(None).cast("double"))
    files = table.select("host", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"))
    decided = robots.robots_decisions(urls, files, table, "host", indexed=True)
    return decided.select("page_id", "reason", "allowed")


ALLOWED = """SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN host WHEN 1 THEN upper(host) WHEN 2 THEN concat('x', host) ELSE concat('sub.', host) END AS host
FROM fx_urls WHERE page_id % 3 = 0 UNION ALL SELECT 'example.org' AS host"""
HOSTS = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('a.b.', host) WHEN 1 THEN upper(host) ELSE concat('not', host) END AS host FROM fx_urls"""


@query(
    f""", l AS (SELECT DISTINCT lower(host) AS item FROM ({ALLOWED}) a), h AS ({HOSTS})
SELECT page_id, host, EXISTS (SELECT 1 FROM l WHERE lower(h.host) = item OR lower(h.host) LIKE '%.' || item) AS listed FROM h""",
    ("fx_urls",),
)
def host_allowlist_table(spark, sf_dir):
    """Hosts against an allow list that is a table."""
    return merge.listed_hosts(fx.sql(spark, sf_dir, HOSTS), fx.sql(spark, sf_dir, ALLOWED))


@query(
    """, k AS (SELECT id, source, protocol, score, -ln((CAST('0x' || substr(md5('s1|' || id), 1, 13) AS BIGINT) + 1.0::DOUBLE) / 4503599627370496.0::DOUBLE)
    / greatest(1.0::DOUBLE, score) AS key FROM fx_endpoints)
SELECT id, source, protocol, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY source, protocol ORDER BY key, id) AS nth FROM k) WHERE nth <= 5""",
    ("fx_endpoints",),
)
def weighted_sample(spark, sf_dir):
    """Five endpoints of every source and protocol, drawn by score."""
    rows = fx.view(spark, sf_dir, "fx_endpoints").select("id", "source", "protocol", "score")
    return pool.weighted_sample(rows, ["source", "protocol"], 5, "s1")


SHARES = (0.001, 0.5, 0.9, 0.95, 0.999, 1.0)


@query(
    " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, quantile_disc(value, {p}) AS value FROM events" for p in SHARES),
)
def value_percentiles(spark, sf_dir):
    """Percentiles of all values of the events, each of them exact."""
    return stats.exact_percentiles(fx.table(spark, sf_dir, "events"), "value", SHARES)


# Two services whose answers mean different things.
rules.register_probe_rules(
    "svc-a",
    [
        {"marker": "just a moment", "verdict": "blocked", "reason": "challenge"},
        {"status_low": 429, "status_high": 429, "header": "retry-after", "verdict": "blocked", "reason": "wait:{status}"},
        {"status_low": 400, "status_high": 499, "verdict": "failed", "reason": "client:{status}"},
        {"status_low": 200, "status_high": 399, "verdict": "passed", "reason": None},
    ],
)
rules.register_probe_rules(
    "svc-b",
    [
        {"status_low": 200, "status_high": 299, "marker": "user-agent", "verdict": "passed", "reason": None},
        {"header": "retry-after", "header_value": "1", "verdict": "skipped", "reason": "later"},
        {"status_low": 403, "status_high": 407, "verdict": "blocked", "reason": "denied:{status}"},
    ],
)


@query(
    """, a AS (SELECT id, CASE id % 3 WHEN 0 THEN 'svc-a' WHEN 1 THEN 'svc-b' ELSE 'svc-c' END AS service, status, lower(body_text) AS body, retry_after FROM fx_responses),
d AS (SELECT *, CASE service
  WHEN 'svc-a' THEN CASE WHEN contains(body, 'just a moment') THEN 0 WHEN status = 429 AND retry_after IS NOT NULL THEN 1
    WHEN status BETWEEN 400 AND 499 THEN 2 WHEN status BETWEEN 200 AND 399 THEN 3 END
  WHEN 'svc-b' THEN CASE WHEN status BETWEEN 200 AND 299 AND contains(body, 'user-agent') THEN 0 WHEN contains(retry_after, '1') THEN 1
    WHEN status BETWEEN 403 AND 407 THEN 2 END END AS rule FROM a)
SELECT id, service, rule, CASE service WHEN 'svc-a' THEN ['blocked', 'blocked', 'failed', 'passed'][rule + 1] ELSE ['passed', 'skipped', 'blocked'][rule + 1] END AS verdict,
  CASE service WHEN 'svc-a' THEN ['challenge', 'wait:' || status, 'client:' || status, NULL][rule + 1] ELSE [NULL, 'later', 'denied:' || status][rule + 1] END AS reason FROM d""",
    ("fx_responses",),
)
def classify_by_rules(spark, sf_dir):
    """Responses of three services, two of which have registered rules."""
    headers = F.when(F.col("retry_after").isNotNull(), F.create_map(F.lit("retry-after"), F.col("retry_after"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    service = F.when(F.col("id") % 3 == 0, "svc-a").when(F.col("id") % 3 == 1, "svc-b").otherwise("svc-c")
    responses = fx.view(spark, sf_dir, "fx_responses").select("id", "status", "body_text", headers.alias("headers"), service.alias("service"))
    found = rules.classify_by_rules(responses, rules.probe_rules(spark))
    return found.select("id", "service", "rule", "verdict", "reason")


@query(
    """, j AS (SELECT *, event_id % 8 AS k FROM events),
  good AS (SELECT event_id FROM j WHERE k IN (0, 4, 5) OR (k <> 6 AND event_id % 7 <> 0))
SELECT event_id AS id, 'done' AS fate FROM good WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'retry' FROM good WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, 'rejected' FROM j WHERE event_id NOT IN (SELECT event_id FROM good)"""
)
def jobs_delivered_twice(spark, sf_dir):
    """A stream that delivers every message twice, worked on once."""
    folder = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    messages = fx.view(spark, sf_dir, "fx_jobs")
    messages.unionByName(messages).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(messages.schema).parquet(f"{folder}/in")
    handle = lambda jobs: jobs.withColumn("ok", F.col("id") % 3 == 0)
    run_jobs(stream, handle, f"{folder}/out", sent_at="created_at").awaitTermination()
    fates = [spark.read.parquet(f"{folder}/out/{name}").select("id", F.lit(name).alias("fate")) for name in ("done", "retry", "dropped", "rejected")]
    return fates[0].unionByName(fates[1]).unionByName(fates[2]).unionByName(fates[3])


# Names and what a browser makes of them.
NAMES = [
    ("Bücher", "xn--bcher-kva"),
    ("例え。テスト", "xn--r8jz45g.xn--zckzah"),
    ("faß", "xn--fa-hia"),
    ("ＧＯ", "go"),
    ("испытание", "xn--80akhbyknj4f"),
    ("\u2615", "xn--53h"),
    ("Plain-1", "plain-1"),
    ("M%C3%BCnchen", "xn--mnchen-3ya"),
]
FOREIGN = f"""SELECT page_id, concat('https://', CASE page_id % 9 {" ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(NAMES))} ELSE '１２７.０.０.１' END,
  CASE WHEN page_id % 9 = 8 THEN '' ELSE concat('.', host) END, '/p') AS url FROM fx_urls"""


@query(
    f"""SELECT page_id, page_id % 9 <> 8 AS ok, CASE WHEN page_id % 9 = 8 THEN 'loopback address (127.0.0.1) is not allowed' END AS reason,
  concat('https://', CASE page_id % 9 {" ".join(f"WHEN {i} THEN '{name}.'" for i, (_, name) in enumerate(NAMES))} ELSE '127.0.0.1' END,
    CASE WHEN page_id % 9 = 8 THEN '' ELSE host END) AS origin FROM fx_urls""",
    ("fx_urls",),
)
def international_hosts(spark, sf_dir):
    """Policy and origin of URLs with host names in other scripts, wide forms and percent codes."""
    url = F.col("url")
    found = fx.sql(spark, sf_dir, FOREIGN).select("page_id", U.url_policy(url).alias("v"), U.origin_of(url).alias("origin"))
    return found.select("page_id", "v.ok", "v.reason", "origin")
