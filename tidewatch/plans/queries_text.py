"""Queries over addresses, URLs, robots files, recorded responses and free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import address as A
from ..functions import probe as P
from ..functions import redact as R
from ..functions import url as U
from ..functions.text import safe_message
from ..operators import merge, robots
from ..operators.running import evaluate_once
from ..session import spread
from .documents import ERROR_STATUS, error_envelopes
from .registry import query

# Addresses of every class, by the customer's number.
HOSTS = """SELECT c_custkey AS id, concat(CASE c_custkey % 23 WHEN 0 THEN '10' WHEN 1 THEN '127' WHEN 2 THEN '100.64'
    WHEN 3 THEN '169.254.169.254' WHEN 4 THEN '169.254' WHEN 5 THEN '172.20' WHEN 6 THEN '192.168' WHEN 7 THEN '192.0.0'
    WHEN 8 THEN '192.0.2' WHEN 9 THEN '192.88.99' WHEN 10 THEN '198.18' WHEN 11 THEN '198.51.100' WHEN 12 THEN '203.0.113'
    WHEN 13 THEN '224' WHEN 14 THEN '250' WHEN 15 THEN '0' WHEN 16 THEN '8' WHEN 17 THEN '010' WHEN 18 THEN '300'
    WHEN 19 THEN '172.40' WHEN 20 THEN concat('host', CAST(c_custkey AS STRING), '.example') WHEN 21 THEN '0x7f' ELSE CAST(2130706433 + c_custkey AS STRING) END,
  CASE WHEN c_custkey % 23 IN (3, 20, 22) THEN '' WHEN c_custkey % 23 IN (7, 8, 9, 11, 12) THEN concat('.', CAST(c_custkey % 250 AS STRING))
    WHEN c_custkey % 23 IN (2, 4, 5, 6, 10, 19) THEN concat('.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 250 AS STRING))
    ELSE concat('.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 250 AS STRING), '.1') END) AS host FROM customer"""
CLASS_CASE = """CASE id % 23 WHEN 0 THEN 'private' WHEN 1 THEN 'loopback' WHEN 2 THEN 'carrier_nat' WHEN 3 THEN 'cloud_metadata'
  WHEN 4 THEN 'link_local' WHEN 5 THEN 'private' WHEN 6 THEN 'private' WHEN 7 THEN 'reserved' WHEN 8 THEN 'documentation'
  WHEN 9 THEN 'reserved' WHEN 10 THEN 'benchmark' WHEN 11 THEN 'documentation' WHEN 12 THEN 'documentation' WHEN 13 THEN 'multicast'
  WHEN 14 THEN 'reserved' WHEN 15 THEN 'unspecified' WHEN 17 THEN 'private' WHEN 18 THEN 'private' WHEN 21 THEN 'private'
  WHEN 22 THEN 'private' ELSE 'public' END"""


@query(
    f"""SELECT id, host, {CLASS_CASE} <> 'public' AS blocked, CASE id % 23 WHEN 20 THEN 'hostname' ELSE 'ipv4' END AS kind, {CLASS_CASE} AS classification,
  CASE WHEN id % 23 = 20 THEN 'hostname requires DNS check' WHEN id % 23 IN (17, 18, 21, 22) THEN 'non-canonical IP literal (octal, hex or abbreviated form) is not allowed'
    WHEN {CLASS_CASE} = 'public' THEN 'public ipv4' ELSE concat({CLASS_CASE}, ' ipv4 is not allowed') END AS reason
FROM ({HOSTS.replace("STRING", "VARCHAR")})"""
)
def classify_ip(spark, sf_dir):
    hosts = fx.sql(spark, sf_dir, HOSTS)
    return hosts.select("id", "host", A.inspect_address(F.col("host")).alias("v")).select("id", "host", "v.*")


V6 = """SELECT c_custkey AS id, concat(CASE c_custkey % 17 WHEN 0 THEN 'fe80::' WHEN 1 THEN 'fd00:1::' WHEN 2 THEN 'ff02::' WHEN 3 THEN '2606:4700::'
    WHEN 4 THEN '[2001:db8::' WHEN 5 THEN '::ffff:0a00:' WHEN 6 THEN '64:ff9b::7f00:' WHEN 7 THEN '2002:c0a8::' WHEN 8 THEN '3ffe::'
    WHEN 9 THEN 'fd00:ec2::' WHEN 10 THEN '2001:c00::' WHEN 11 THEN '64:ff9b:1::' WHEN 12 THEN '::ffff:1.2.3.' WHEN 13 THEN '1::2::'
    WHEN 14 THEN '1:2:3:4:5:6:7:' WHEN 15 THEN 'FC00:0:0:0:0:0:0:' ELSE '0:0:0:0:9::' END, CAST(1000 + c_custkey % 8000 AS STRING),
  CASE c_custkey % 17 WHEN 0 THEN '%eth0' WHEN 4 THEN ']' ELSE '' END) AS host FROM customer"""


@query(
    f"""SELECT id, host, CASE id % 17 WHEN 0 THEN 'link_local' WHEN 1 THEN 'unique_local' WHEN 2 THEN 'multicast' WHEN 3 THEN 'public' WHEN 4 THEN 'public'
  WHEN 5 THEN 'private' WHEN 6 THEN 'loopback' WHEN 7 THEN 'private' WHEN 8 THEN 'reserved' WHEN 9 THEN 'cloud_metadata' WHEN 10 THEN 'documentation'
  WHEN 11 THEN 'reserved' WHEN 12 THEN 'invalid' WHEN 13 THEN 'invalid' WHEN 14 THEN 'public' WHEN 15 THEN 'unique_local' ELSE 'reserved' END AS classification
FROM ({V6.replace("STRING", "VARCHAR")})"""
)
def classify_ipv6(spark, sf_dir):
    hosts = fx.sql(spark, sf_dir, V6)
    return hosts.select("id", "host", A.inspect_address(F.col("host"))["classification"].alias("classification"))


@query(
    f""", h AS ({HOSTS.replace("STRING", "VARCHAR")})
SELECT {CLASS_CASE} AS classification, count(*) AS hosts, count(*) FILTER ({CLASS_CASE} = 'public') AS allowed,
  count(*) FILTER ({CLASS_CASE} <> 'cloud_metadata') AS allowed_private, count(*) FILTER (host IN ('169.254.169.254')) AS metadata FROM h GROUP BY ALL"""
)
def endpoint_policy(spark, sf_dir):
    """Policy verdicts of all hosts, strict and with private ranges allowed."""
    hosts = fx.sql(spark, sf_dir, HOSTS)
    strict = merge.with_policy(hosts).withColumnRenamed("allowed", "strict")
    both = merge.with_policy(strict, allow_private=True)
    named = both.withColumn("classification", A.inspect_address(F.col("host"))["classification"])
    return named.groupBy("classification").agg(
        F.count("*").alias("hosts"),
        F.count_if("strict").alias("allowed"),
        F.count_if("allowed").alias("allowed_private"),
        F.count_if(A.is_metadata_host(F.col("host"))).alias("metadata"),
    )


DNS = f"""SELECT h.id, concat('name', CAST(h.id % 400 AS STRING), '.example') AS name, h.host AS address, h.id AS ord FROM ({HOSTS}) h"""


@query(
    f""", dns AS ({DNS.replace("STRING", "VARCHAR")}), v AS (SELECT *, {CLASS_CASE} AS class FROM dns)
SELECT name, CASE WHEN bool_or(class = 'cloud_metadata') THEN 'blocked' WHEN bool_or(class = 'public') THEN 'ok' ELSE 'blocked' END AS outcome,
  CASE WHEN NOT bool_or(class = 'cloud_metadata') THEN arg_min(address, ord) FILTER (class = 'public') END AS address, count(*) AS records
FROM v GROUP BY name"""
)
def resolved_host_policy(spark, sf_dir):
    """Recorded resolutions: metadata blocks the name, else the first allowed address counts."""
    return merge.resolve_hosts(fx.sql(spark, sf_dir, DNS), "name", "address", "ord")


URLS = """SELECT page_id, CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pw@')
    WHEN 2 THEN concat('http://127.0.0.1:8080/', CAST(page_id AS STRING)) WHEN 3 THEN concat('http://localhost/', CAST(page_id AS STRING))
    WHEN 4 THEN concat('ftp://files.example/', CAST(page_id AS STRING)) WHEN 5 THEN concat('/rel/', CAST(page_id AS STRING))
    WHEN 6 THEN concat('http://169.254.169.254/', CAST(page_id AS STRING)) WHEN 7 THEN concat('http://mail.example:25/', CAST(page_id AS STRING))
    WHEN 8 THEN concat('http://', CAST(2130706433 + page_id % 200 AS STRING), '/') ELSE concat('  ', url, ' ') END AS url FROM pages"""


@query(
    """SELECT page_id, page_id % 10 IN (0, 9) AS ok, CASE page_id % 10 WHEN 1 THEN 'credentials in URL are not allowed'
  WHEN 2 THEN 'loopback address (127.0.0.1) is not allowed' WHEN 3 THEN 'the localhost name space is not allowed' WHEN 4 THEN 'protocol "ftp:" is not allowed'
  WHEN 5 THEN 'url is not absolute or is malformed' WHEN 6 THEN 'cloud metadata endpoints are not allowed' WHEN 7 THEN 'SMTP port 25 is not allowed'
  WHEN 8 THEN concat('loopback address (127.0.0.', 1 + page_id % 200, ') is not allowed') END AS reason FROM pages"""
)
def url_policy(spark, sf_dir):
    urls = fx.sql(spark, sf_dir, URLS)
    return urls.select("page_id", U.url_policy(F.col("url")).alias("v")).select("page_id", "v.ok", "v.reason")


@query(
    """SELECT page_id, regexp_matches(host, '(^|[.])example[.](com|org)$') AS listed, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin,
  false AS literal FROM fx_urls""",
    ("fx_urls",),
)
def host_allowlist(spark, sf_dir):
    host = U.raw_host(F.col("url"))
    return fx.view(spark, sf_dir, "fx_urls").select(
        "page_id",
        A.host_in(host, ["example.com", "example.org"]).alias("listed"),
        U.origin_of(F.col("url")).alias("origin"),
        U.host_is_literal_ip(host).alias("literal"),
    )


@query(
    """, q AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT x LIKE 'bypass_cache%' AND NOT x LIKE '\\_=%' ESCAPE '\\') AS parts FROM pages)
SELECT page_id, concat('pp:', CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN len(parts) > 0 THEN concat('?', array_to_string(list_sort(parts), '&')) ELSE '' END) AS key FROM q"""
)
def cache_key(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", U.cache_key(F.col("url")).alias("key"))


CLIENTS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat(' 1.2.', CAST(user_id % 200 AS STRING), '.4 , 5.6.7.8') WHEN 1 THEN repeat('x', 65)
  WHEN 2 THEN '' WHEN 3 THEN concat('c', CAST(user_id AS STRING)) END AS fwd, CASE WHEN event_id % 3 = 0 THEN concat('f', CAST(user_id AS STRING)) END AS alt FROM events"""


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('1.2.', user_id % 200, '.4') WHEN 1 THEN repeat('x', 65) WHEN 3 THEN concat('c', user_id)
  ELSE CASE WHEN event_id % 3 = 0 THEN concat('f', user_id) ELSE 'unknown' END END AS client FROM events"""
)
def client_address(spark, sf_dir):
    log = fx.sql(spark, sf_dir, CLIENTS)
    return log.select("event_id", U.client_address(F.col("fwd"), F.col("alt")).alias("client"))


# Robots -----------------------------------------------------------------------

# One robots file per host of the pages; its kind follows from the host's text.
ROBOTS = """SELECT host, length(host) % 5 AS kind, CASE length(host) % 5
    WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /fr/', chr(10), 'Allow: /fr/8', chr(10), 'Crawl-delay: 0.05')
    WHEN 1 THEN concat('# intro', chr(10), 'User-agent: other', chr(10), 'User-agent: databot', chr(10), 'Disallow: /*/1$ # end', chr(10), 'Sitemap: /s', chr(10), 'User-agent: *', chr(10), 'Disallow: /')
    WHEN 2 THEN concat('Disallow: /en', chr(13), chr(10), 'Allow: /en/', chr(10), 'User-agent: zzz', chr(10), 'Disallow: /')
    WHEN 3 THEN '' ELSE 'User-agent: *' END AS body,
  CASE length(host) % 5 WHEN 3 THEN 404 WHEN 4 THEN 403 ELSE 200 END AS status FROM (SELECT DISTINCT host FROM fx_urls) h"""


def _robots(spark, sf_dir):
    files = fx.sql(spark, sf_dir, ROBOTS).withColumn("error", F.lit(None).cast("string"))
    return files, robots.robots_rules(files, "host", "DataBot/2.0")


@query(
    """SELECT host, CASE length(host) % 5 WHEN 1 THEN 'other' WHEN 3 THEN 'databot/2.0' ELSE '*' END AS user_agent,
  CASE length(host) % 5 WHEN 0 THEN '/fr/8' WHEN 2 THEN '/en/' ELSE '' END AS allow,
  CASE length(host) % 5 WHEN 0 THEN '/fr/' WHEN 1 THEN '/*/1$' WHEN 2 THEN '/en' ELSE '' END AS disallow,
  CASE length(host) % 5 WHEN 0 THEN 0.05 END AS crawl_delay FROM (SELECT DISTINCT host FROM fx_urls)""",
    ("fx_urls",),
)
def robots_rules(spark, sf_dir):
    rules = _robots(spark, sf_dir)[1]
    return rules.select(
        "host", "user_agent", *[F.array_join(n, ",").alias(n) for n in ("allow", "disallow")], "crawl_delay"
    )


@query(
    """, u AS (SELECT page_id, host, length(host) % 5 AS k, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM fx_urls),
d AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN path LIKE '/fr/8%' THEN 'allow' WHEN path LIKE '/fr/%' THEN 'disallow' ELSE 'no_rules' END
  WHEN 1 THEN CASE WHEN regexp_matches(path, '^/.*/1$') THEN 'disallow' ELSE 'no_rules' END
  WHEN 2 THEN CASE WHEN path LIKE '/en/%' THEN 'allow' WHEN path LIKE '/en%' THEN 'disallow' ELSE 'no_rules' END
  WHEN 3 THEN 'no_robots' ELSE 'fetch_failed' END AS reason FROM u)
SELECT page_id, reason NOT IN ('disallow', 'fetch_failed') AS allowed, reason, CASE k WHEN 0 THEN 50 ELSE 0 END AS min_interval_ms FROM d""",
    ("fx_urls",),
)
def robots_decisions(spark, sf_dir):
    files, rules = _robots(spark, sf_dir)
    urls = fx.view(spark, sf_dir, "fx_urls").select("page_id", "host", U.path_of(F.col("url")).alias("path"))
    decided = robots.robots_decisions(urls, files, rules, "host")
    return decided.select("page_id", "allowed", "reason", "min_interval_ms")


@query(
    """, u AS (SELECT page_id, host, length(host) % 5 AS k, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM fx_urls),
d AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN path LIKE '/fr/8%' THEN 'allow' WHEN path LIKE '/fr/%' THEN 'disallow' ELSE 'no_rules' END
  WHEN 1 THEN CASE WHEN regexp_matches(path, '^/.*/1$') THEN 'disallow' ELSE 'no_rules' END
  WHEN 2 THEN CASE WHEN path LIKE '/en/%' THEN 'allow' WHEN path LIKE '/en%' THEN 'disallow' ELSE 'no_rules' END
  WHEN 3 THEN 'no_robots' ELSE 'robots.txt unreadable (403)' END AS reason FROM u)
SELECT page_id, reason <> 'disallow' AND k <> 4 AS allowed, reason FROM d""",
    ("fx_urls",),
)
def robots_gate(spark, sf_dir):
    """Decisions in front of a probe: a robots file that cannot be read refuses."""
    files, rules = _robots(spark, sf_dir)
    urls = fx.view(spark, sf_dir, "fx_urls").select("page_id", "host", U.path_of(F.col("url")).alias("path"))
    return robots.robots_decisions(urls, files, rules, "host", gate=True).select("page_id", "allowed", "reason")


# Responses --------------------------------------------------------------------

CHALLENGE = "body_text LIKE '%Just a moment%'"
PROBE = f"""CASE WHEN NOT robots_allowed THEN 'robots_disallowed:gate'
  WHEN error_code IN ('connect_refused', 'proxy_auth_failed') THEN concat('proxy_error:', error_code) WHEN error_code = 'blocked_by_policy' THEN error_code
  WHEN error_code IS NOT NULL THEN concat('transport_error:', error_code) WHEN status = 429 THEN 'rate_limited:429'
  WHEN status IN (403, 407) THEN concat('denied:', status) WHEN status >= 500 THEN concat('service_error:', status)
  WHEN status NOT BETWEEN 200 AND 399 THEN concat('unexpected_status:', status) WHEN {CHALLENGE} THEN 'bot_challenge'
  WHEN status <> 204 AND body_text = 'this is not the file' THEN 'unexpected_content' END"""


@query(
    f"""SELECT id, reason, CASE WHEN reason IS NULL THEN 'passed' WHEN reason LIKE 'robots%' OR reason = 'blocked_by_policy' THEN 'skipped'
  WHEN reason LIKE 'rate%' OR reason LIKE 'denied%' OR reason = 'bot_challenge' THEN 'blocked' ELSE 'failed' END AS verdict,
  CASE WHEN reason IS NULL OR reason LIKE 'robots%' OR error_code IS NOT NULL THEN NULL WHEN retry_after IS NOT NULL THEN CAST(retry_after AS BIGINT) * 1000
    WHEN reason LIKE 'service_error%' THEN 5000 END AS retry_after_ms
FROM (SELECT *, {PROBE} AS reason FROM fx_responses)""",
    ("fx_responses",),
)
def classify_probe(spark, sf_dir):
    c = F.col
    headers = F.when(c("retry_after").isNotNull(), F.create_map(F.lit("retry-after"), c("retry_after"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    verdict = P.classify_probe(
        c("status"), c("body_text"), c("error_code"), headers, F.lit("/robots.txt"), c("robots_allowed"), F.lit("gate"), fx.NOW
    )
    df = fx.view(spark, sf_dir, "fx_responses").select("id", verdict.alias("v"))
    return df.select("id", "v.verdict", "v.reason", "v.retry_after_ms")


@query(
    """SELECT id, reachable, CASE WHEN reachable THEN latency_ms END AS latency_ms, CASE WHEN status > 0 THEN status END AS http_status,
  CASE WHEN reachable THEN NULL WHEN truncated THEN 'response_too_large' WHEN error_code IS NOT NULL THEN error_code WHEN status = 407 THEN 'proxy_auth_failed'
    WHEN status NOT IN (200, 204, 301, 302) AND status > 0 THEN 'unexpected_status' END AS error_code
FROM (SELECT *, error_code IS NULL AND status IN (200, 204, 301, 302) AND NOT truncated AS reachable FROM fx_responses)""",
    ("fx_responses",),
)
def classify_validation(spark, sf_dir):
    c = F.col
    got = P.classify_validation(
        c("error_code").isNull(), c("status"), c("error_code"), c("truncated"), c("latency_ms"), F.lit("public")
    )
    return fx.view(spark, sf_dir, "fx_responses").select("id", got.alias("v")).select("id", "v.*")


ERRORS = """SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN 'ECONNREFUSED' WHEN 1 THEN 'EPIPE' WHEN 2 THEN 'ETIMEDOUT' WHEN 3 THEN 'EAI_AGAIN'
  WHEN 4 THEN 'ENETDOWN' WHEN 5 THEN 'CERT_HAS_EXPIRED' END AS code, CASE event_id % 12 WHEN 6 THEN 'Operation timed  out' WHEN 7 THEN 'socket CLOSED'
  WHEN 8 THEN 'bad certificate' ELSE event_type END AS message FROM events"""


@query(
    """SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN 'connect_refused' WHEN 1 THEN 'connect_reset' WHEN 2 THEN 'timeout' WHEN 3 THEN 'dns_error'
  WHEN 4 THEN 'proxy_unreachable' WHEN 5 THEN 'tls_error' WHEN 6 THEN 'timeout' WHEN 7 THEN 'protocol_error' WHEN 8 THEN 'tls_error' ELSE 'unknown' END AS code,
  event_id % 12 <> 9 AS retryable FROM events"""
)
def transport_errors(spark, sf_dir):
    """Transport codes of system errors, and whether a source fetch is worth a retry."""
    log = fx.sql(spark, sf_dir, ERRORS)
    text = F.when(F.col("id") % 12 == 9, "source a returned status 404").otherwise(F.col("message"))
    return log.select(
        "id", P.transport_error(F.col("code"), F.col("message")).alias("code"), P.retryable_error(text).alias("retryable")
    )


MARK_SQL = " ".join(f"WHEN contains(head, '{mark}') THEN '{mark}'" for mark in P.BLOCK_MARKERS)


@query(
    f"""SELECT page_id, CASE {MARK_SQL} END AS marker FROM (SELECT page_id, lower(CASE page_id % 3 WHEN 0 THEN html
  WHEN 1 THEN concat('<p>Please solve the CAPTCHA</p>', html) ELSE concat(html, ' Access Denied, reference #1') END) AS head FROM pages)"""
)
def block_markers(spark, sf_dir):
    """Challenge markers in whole pages."""
    body = (
        F.when(F.col("page_id") % 3 == 0, F.col("html"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("<p>Please solve the CAPTCHA</p>"), "html"))
        .otherwise(F.concat("html", F.lit(" Access Denied, reference #1")))
    )
    return fx.table(spark, sf_dir, "pages").select("page_id", P.block_marker(body).alias("marker"))


ECHO = f"""SELECT h.id, CASE h.id % 10 WHEN 0 THEN concat('{{"origin": "', h.host, '"}}') WHEN 1 THEN concat('your address is ', h.host, ' today')
  WHEN 2 THEN concat('{{"n": 1, "peer": "', h.host, ', 9.9.9.9"}}') WHEN 3 THEN 'nothing to see' WHEN 4 THEN concat(h.host, ':8080')
  WHEN 5 THEN concat('ip:', h.host) WHEN 6 THEN concat('{{"client_ip": "address:', h.host, ':443"}}') WHEN 7 THEN concat('x-peer=', h.host, ';port=1.2.3')
  WHEN 8 THEN concat('[', h.host, ']/', h.host, ', 9.9.9.9') ELSE '' END AS body FROM ({HOSTS}) h"""


@query(
    f""", h AS (SELECT *, id % 23 NOT IN (20, 21, 22) AS quad FROM ({HOSTS.replace("STRING", "VARCHAR")})),
e AS (SELECT id, CASE WHEN id % 10 NOT IN (3, 9) AND quad THEN host WHEN id % 10 IN (2, 8) THEN '9.9.9.9' END AS address, quad FROM h)
SELECT id, address, CASE WHEN address IS NULL THEN 'unknown' WHEN NOT quad OR {CLASS_CASE} = 'public' THEN 'public' ELSE 'local' END AS egress FROM e"""
)
def egress_locality(spark, sf_dir):
    echoes = spread(fx.sql(spark, sf_dir, ECHO))
    return echoes.select("id", P.egress(F.col("body")).alias("v")).select(*evaluate_once(["id"], [F.col("v.address"), F.col("v.egress")]))


RETRY = """SELECT event_id AS id, ts, CASE event_id % 9 WHEN 0 THEN CAST(event_id % 300 AS STRING) WHEN 1 THEN '1.5' WHEN 2 THEN 'Thu, 01 Feb 2024 00:00:30 GMT'
  WHEN 3 THEN 'soon' WHEN 4 THEN 'Thu, 1 Feb 2024 00:00:30 GMT' WHEN 5 THEN 'Thursday, 01-Feb-24 00:00:30 GMT' WHEN 6 THEN 'Thu Feb  1 00:00:30 2024'
  WHEN 7 THEN '2024-02-01T00:00:30Z' END AS value FROM events"""


@query(
    """SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN (event_id % 300) * 1000 WHEN event_id % 9 = 1 THEN 1500 WHEN event_id % 9 IN (2, 4, 5, 6, 7) THEN 86430000 END AS wait_ms FROM events"""
)
def retry_after(spark, sf_dir):
    log = fx.sql(spark, sf_dir, RETRY)
    return log.select("id", P.retry_after_ms(F.col("value"), fx.NOW).alias("wait_ms"))


# Text -------------------------------------------------------------------------

# What is added behind whole documents; their own text stays as it is.
ADDED = [
    " login socks5://bob:pw12@h:1 ok",
    " GET /x?a=1&api_key=abc&b=2 end",
    " Authorization: Bearer abcdef123456",
    ' password="hunter22" set',
    " pwd = topsecret; done",
    " write to a@b.example ok",
    ' {"password":"secret-123"} sent',
    " password=auth-xyz9 password=password",
    " pwd=my-token-abc123 set",
    " GET /y?my key=two words&z=1 end",
    " Bearer abc-token xyz",
    " cookie: ''auth-token'' end",
]
SECRETS = f"concat(text, CASE doc_id % {len(ADDED) + 1} {' '.join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(ADDED))} ELSE '' END)"

@query()
def redact_documents(spark, sf_dir):
    """Secrets out of whole documents, their own and added ones.

    Held against a plain scanner in the tests: SQL has no search that goes on behind a value.
    """
    docs = fx.sql(spark, sf_dir, f"SELECT doc_id, {SECRETS} AS text FROM documents")
    clean = docs.select("doc_id", R.redact_text(F.col("text")).alias("text"))
    return clean.select("doc_id", F.md5("text").alias("print"), F.col("text").contains("[redacted]").alias("changed"))


@query(
    """, t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), '[ ]{2,}', ' ', 'g'), ' ') AS flat FROM documents)
SELECT doc_id, CASE WHEN length(flat) <= 200 THEN flat ELSE concat(substring(flat, 1, 199), '…') END AS message FROM t"""
)
def safe_messages(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", safe_message(F.col("text")).alias("message"))


def _fnv32(text: str) -> str:
    state = 2166136261
    for code in text.encode():
        state = (state ^ code) * 16777619 % 2**32
    return f"{state:08x}"


PRINTS = " ".join(f"WHEN '{t}' THEN '{_fnv32(t)}'" for t in ("view", "click", "purchase", "signup", "error"))


@query(
    f"""SELECT event_id, user_id, '[redacted]' AS session_id, concat('http://[redacted]@h/', event_id) AS url,
  concat('[redacted] (len=', length(event_type), ' fnv=', CASE event_type {PRINTS} END, ')') AS api_key,
  70 AS items, '[redacted]' AS last_item FROM events"""
)
def redact_records(spark, sf_dir):
    """Log rows cleaned by field name, with all items of a long list."""
    rows = spread(fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")).select(
        "event_id",
        "user_id",
        F.col("user_id").alias("session_id"),
        F.concat(F.lit("http://u:p@h/"), "event_id").alias("url"),
        F.col("event_type").alias("api_key"),
        F.array_repeat(F.concat(F.lit("pwd="), "event_type"), 70).alias("items"),
    )
    # The list is read twice behind, and cleaned once.
    clean = rows.select(*evaluate_once([], [R.redact_value(F.col(f.name), f.dataType, f.name).alias(f.name) for f in rows.schema]))
    last = F.regexp_replace(F.element_at("items", -1), "^pwd=", "")
    return clean.select("event_id", "user_id", "session_id", "url", "api_key", F.size("items").alias("items"), last.alias("last_item"))


STATUS_SQL = " ".join(f"WHEN {i} THEN {status}" for i, status in enumerate(ERROR_STATUS.values()))


@query(
    f"""SELECT event_id, CASE event_id % 13 {STATUS_SQL} ELSE 500 END AS status, concat('failed for ', event_type) AS message FROM events"""
)
def error_envelopes_log(spark, sf_dir):
    """Error documents for a log of failures, read back."""
    codes = F.array(*[F.lit(code) for code in ERROR_STATUS])
    log = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.coalesce(F.get(codes, (F.col("event_id") % 13).cast("int")), F.lit("odd")).alias("code"),
        F.concat(F.lit("failed   for\n"), "event_type").alias("message"),
    )
    sent = error_envelopes(log, "req_1", fx.NOW)
    return sent.select("event_id", "status", F.get_json_object("body", "$.error.message").alias("message"))


