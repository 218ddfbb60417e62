"""Queries over raw lines, feeds, jobs, keys and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import entry as E
from ..functions import keys as K
from ..functions.text import iso_text
from ..operators import merge, parse
from ..schemas import PROTOCOLS
from ..session import cut_lineage
from ..sources import feeds, jobs, lists
from .cycle import discover
from .registry import iso, query

# What the generated lines stand for, straight from the table they come from.
SHAPES = """
, ids AS (
  SELECT concat('src-', CAST(floor(c_custkey / 100) AS BIGINT)) AS source, c_custkey % 100 AS line_no,
    c_custkey % 14 AS k, c_custkey % 90 + 10 AS tail,
    concat(1 + c_custkey % 223, '.', (c_custkey * 7) % 256, '.', c_nationkey, '.', (c_custkey * 29) % 256) AS ip,
    1024 + (c_custkey * 17) % 60000 AS port
  FROM customer),
feed AS (
  SELECT * FROM ids
  UNION ALL SELECT * REPLACE (1000 + line_no AS line_no) FROM ids WHERE line_no % 5 = 0
  UNION ALL SELECT * REPLACE (concat('copy-', source) AS source) FROM ids WHERE line_no % 3 = 0),
hinted AS (
  SELECT *, max(CASE WHEN k = 0 THEN 'socks5' END) OVER (PARTITION BY source ORDER BY line_no) AS hint FROM {feed}),
entries AS (
  SELECT source, line_no, k, hint, ip AS host, port,
    CASE k WHEN 1 THEN 'http' WHEN 3 THEN 'socks5' WHEN 6 THEN 'socks4' ELSE coalesce(hint, 'http') END AS protocol,
    CASE WHEN k IN (1, 3, 6) THEN 'scheme' WHEN hint IS NOT NULL THEN 'hint' ELSE 'default' END AS protocol_source,
    CASE k WHEN 4 THEN concat('user', port) WHEN 5 THEN 'alice' END AS username,
    CASE k WHEN 4 THEN 'pw' WHEN 5 THEN 's3cret' END AS password,
    CASE k WHEN 4 THEN 'US' END AS country,
    CASE WHEN k IN (1, 2, 3, 4, 5, 6) THEN 'accepted' WHEN k IN (0, 7, 10) THEN 'skipped' ELSE 'rejected' END AS outcome,
    CASE k WHEN 8 THEN 'invalid_scheme' WHEN 9 THEN 'invalid_port' WHEN 11 THEN 'not_an_entry'
      WHEN 12 THEN 'not_an_entry' WHEN 13 THEN 'no_port' END AS reason
  FROM hinted),
keyed AS (
  SELECT *, concat(protocol, '|', host, '|', port, '|', coalesce(username, '')) AS entry_key FROM entries),
firsts AS (
  SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY source, entry_key ORDER BY line_no) AS nth,
      count(*) OVER (PARTITION BY source, entry_key) AS copies
    FROM keyed WHERE outcome = 'accepted') WHERE nth = 1),
sources AS (
  SELECT source, CAST(regexp_extract(source, '[0-9]+$') AS BIGINT)
      + CASE WHEN source LIKE 'copy-%' THEN 1000000 ELSE 0 END AS source_ord,
    (CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) % 12) / 10.0 AS trust
  FROM (SELECT DISTINCT source FROM {feed})),
merged AS (
  SELECT * EXCLUDE (nth) FROM (
    SELECT f.*, s.source_ord, least(CAST(s.trust AS DOUBLE), 1.0) AS trust,
      row_number() OVER (PARTITION BY entry_key ORDER BY s.source_ord, line_no) AS nth,
      count(*) OVER (PARTITION BY entry_key) AS reported_by
    FROM firsts f JOIN sources s USING (source)) WHERE nth = 1)
"""
PLAIN, FEED = SHAPES.replace("{feed}", "ids"), SHAPES.replace("{feed}", "feed")


def source_catalogue(lines: DataFrame) -> DataFrame:
    """Sources of the fixture lines with order and trust by their number."""
    number = F.regexp_extract("source", "[0-9]+$", 0).cast("bigint")
    return lines.select("source").distinct().select(
        "source",
        (number + F.when(F.col("source").startswith("copy-"), 1_000_000).otherwise(0)).alias("source_ord"),
        ((number % 12) / 10.0).alias("trust"),
    )


def parsed_feed(spark, sf_dir):
    return parse.parse_lines(fx.view(spark, sf_dir, "fx_feeds"))


V6_LINES = """SELECT c_custkey AS line_no, concat(CASE c_custkey % 7 WHEN 0 THEN '2001:db8::1:' WHEN 1 THEN '1:2:3:4:5:6:7:8:' WHEN 2 THEN '[2001:DB8::2]:'
    WHEN 3 THEN 'http://[::1]:' WHEN 4 THEN '::ffff:1:2:3:' WHEN 5 THEN '1:2:3:4:5:6:' ELSE 'fe80::a:b:c:' END, CAST(1024 + c_custkey % 60000 AS STRING)) AS line FROM customer"""


@query(
    """, v AS (SELECT c_custkey AS line_no, c_custkey % 7 AS k, 1024 + c_custkey % 60000 AS port FROM customer)
SELECT line_no, k = 3 AS ok, CASE k WHEN 2 THEN 'not_an_entry' WHEN 3 THEN NULL WHEN 6 THEN 'invalid_scheme' ELSE 'ipv6_requires_brackets' END AS reason,
  CASE k WHEN 3 THEN '::1' END AS host, CASE k WHEN 3 THEN port END AS port FROM v"""
)
def ipv6_entries(spark, sf_dir):
    """IPv6 entries without brackets, with a scheme, and ones that look like something else."""
    return parse.parse_entries(fx.sql(spark, sf_dir, V6_LINES)).select("line_no", "ok", "reason", "host", "port")


@query(
    PLAIN
    + """
SELECT source, line_no, k NOT IN (0, 7, 8, 9, 11, 12, 13) AS ok,
  CASE WHEN k IN (0, 13) THEN 'no_port' WHEN k = 7 THEN 'ambiguous_format' ELSE reason END AS reason,
  CASE WHEN k IN (1, 2, 3, 4, 5, 6, 10) THEN host END AS host,
  CASE WHEN k IN (1, 2, 3, 4, 5, 6, 10) THEN port END AS port,
  CASE WHEN k IN (1, 2, 4, 5, 10) THEN 'http' WHEN k = 3 THEN 'socks5' WHEN k = 6 THEN 'socks4' END AS protocol,
  CASE WHEN k IN (1, 3, 6) THEN 'scheme' WHEN k IN (2, 4, 5, 10) THEN 'default' END AS protocol_source,
  username, password, country
FROM entries"""
)
def parse_entries(spark, sf_dir):
    """Every line as an entry of its own."""
    return parse.parse_entries(fx.view(spark, sf_dir, "fx_lines")).drop("line", "anonymity")


@query(
    FEED
    + """
SELECT source, line_no, host, port, protocol, username, password, country, copies FROM firsts"""
)
def parse_list(spark, sf_dir):
    """Distinct accepted entries per source with the labels of their sections."""
    return parse.first_entries(parsed_feed(spark, sf_dir)).drop("entry_key", "anonymity")


@query(FEED + " SELECT reason, count(*) AS lines FROM entries WHERE outcome = 'rejected' GROUP BY reason")
def reject_reasons(spark, sf_dir):
    return parse.reject_reasons(parsed_feed(spark, sf_dir))


@query(
    FEED
    + """
SELECT source, count(*) AS total_lines, count(*) FILTER (outcome = 'skipped') AS skipped_lines,
  count(DISTINCT entry_key) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected,
  count(*) FILTER (outcome = 'accepted') - count(DISTINCT entry_key) FILTER (outcome = 'accepted') AS duplicates,
  least(count(*) FILTER (outcome = 'rejected'), 25) AS samples,
  min(line_no) FILTER (outcome = 'rejected') AS first_reject
FROM keyed GROUP BY source"""
)
def normalize_report(spark, sf_dir):
    """Counts and first rejects per source."""
    report = parse.normalize_report(parsed_feed(spark, sf_dir))
    return report.select(
        "source", "total_lines", "skipped_lines", "accepted", "rejected", "duplicates",
        F.coalesce(F.size("rejection_samples"), F.lit(0)).alias("samples"),
        F.get("rejection_samples", F.lit(0))["line_no"].alias("first_reject"),
    )


@query(FEED + " SELECT source, line_no, reason FROM entries WHERE outcome = 'rejected'")
def rejects(spark, sf_dir):
    """Every rejected line."""
    return parse.rejects(parsed_feed(spark, sf_dir)).drop("line")


@query(
    FEED
    + """
, ranked AS (SELECT source, line_no, row_number() OVER (PARTITION BY source ORDER BY line_no) AS nth FROM firsts),
ends AS (SELECT source, line_no AS last FROM ranked WHERE nth = 20)
SELECT source, count(*) AS lines, count(DISTINCT entry_key) FILTER (outcome = 'accepted') AS accepted,
  count(*) FILTER (outcome = 'rejected') AS rejected
FROM keyed LEFT JOIN ends USING (source) WHERE last IS NULL OR line_no <= last GROUP BY source"""
)
def max_entries(spark, sf_dir):
    """Lines up to the twentieth distinct entry of each source."""
    cut = parse.cut_after_accepted(parsed_feed(spark, sf_dir), 20)
    return parse.source_report(cut).select("source", F.col("total_lines").alias("lines"), "accepted", "rejected")


LABEL_TEXT = """CASE c_custkey % 9 WHEN 0 THEN 'SOCKS5' WHEN 1 THEN 'socks 4a list' WHEN 2 THEN 'HTTPS proxies:'
  WHEN 3 THEN '== HTTP ==' WHEN 4 THEN 'socks' WHEN 5 THEN c_name WHEN 6 THEN c_mktsegment
  WHEN 7 THEN concat('http', CAST(c_custkey AS STRING)) ELSE 'socksy' END"""


@query(
    f"""SELECT c_custkey, {LABEL_TEXT} AS label, CASE c_custkey % 9 WHEN 0 THEN 'socks5' WHEN 1 THEN 'socks4'
  WHEN 2 THEN 'https' WHEN 3 THEN 'http' WHEN 4 THEN 'socks5' WHEN 7 THEN 'http' END AS protocol FROM customer"""
)
def detect_labels(spark, sf_dir):
    labels = fx.sql(spark, sf_dir, f"SELECT c_custkey, {LABEL_TEXT} AS label FROM customer")
    return labels.withColumn("protocol", E.detect_protocol(F.col("label")))


@query(
    """SELECT id, concat(protocol, '://', CASE WHEN username IS NOT NULL THEN '***:***@' ELSE '' END, host, ':', port) AS shown
FROM fx_endpoints""",
    ("fx_endpoints",),
)
def redacted_endpoints(spark, sf_dir):
    df = fx.view(spark, sf_dir, "fx_endpoints")
    return df.select("id", parse.redacted(df).alias("shown"))


KEY_SQL = "concat(protocol, '|', host, '|', port, '|', coalesce(username, ''))"


@query(f"SELECT id, {KEY_SQL} AS entry_key FROM fx_endpoints", ("fx_endpoints",))
def dedupe_keys(spark, sf_dir):
    df = fx.view(spark, sf_dir, "fx_endpoints")
    return df.select("id", K.dedupe_key(*[F.col(c) for c in merge.IDENTITY]).alias("entry_key"))


@query(
    f"""SELECT id, lower(lpad(printf('%x', CAST(list_reduce(
    list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({KEY_SQL}, ''), lambda c: ord(c)::HUGEINT)),
    lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT)), 16, '0')) AS dedupe_key
FROM fx_endpoints""",
    ("fx_endpoints",),
)
def dedupe_hash(spark, sf_dir):
    df = fx.view(spark, sf_dir, "fx_endpoints")
    return df.select("id", K.dedupe_hash(*[F.col(c) for c in merge.IDENTITY]).alias("dedupe_key"))


FNV32_SQL = """list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split({text}, ''), lambda c: ord(c)::HUGEINT)),
    lambda h, c: (xor(h, c) * 16777619::HUGEINT) % 4294967296::HUGEINT)"""


@query(
    f"""SELECT id, CAST({FNV32_SQL.format(text="host")} % 64 AS BIGINT) AS bucket,
  concat('len=', length(host), ' fnv=', lower(lpad(printf('%x', CAST({FNV32_SQL.format(text="host")} AS BIGINT)), 8, '0'))) AS print
FROM fx_endpoints""",
    ("fx_endpoints",),
)
def host_buckets(spark, sf_dir):
    host = F.col("host")
    df = fx.view(spark, sf_dir, "fx_endpoints")
    return df.select("id", K.bucket_of(host, 64).alias("bucket"), K.short_hash(host).alias("print"))


MERGED_COLUMNS = "source, source_ord, line_no, trust, protocol, host, port, username, password, country, reported_by"


@query(FEED + f" SELECT {MERGED_COLUMNS} FROM merged")
def merge_sources(spark, sf_dir):
    """The candidates of all sources."""
    lines = fx.view(spark, sf_dir, "fx_feeds")
    merged = merge.merge_sources(parse.first_entries(parse.parse_lines(lines)), source_catalogue(lines))
    return merged.select(*MERGED_COLUMNS.split(", "))


@query(
    FEED
    + """
SELECT (SELECT count(*) FROM feed) AS discovered, (SELECT count(*) FROM merged) AS accepted,
  (SELECT count(*) FROM entries WHERE outcome = 'rejected') AS rejected,
  (SELECT count(*) FROM entries WHERE outcome = 'accepted') - (SELECT count(*) FROM merged) AS duplicates,
  (SELECT count(*) FROM sources) AS sources_ok, CAST(0 AS BIGINT) AS sources_failed"""
)
def discovery_totals(spark, sf_dir):
    lines = fx.view(spark, sf_dir, "fx_feeds")
    parsed, catalogue = parse.parse_lines(lines), source_catalogue(lines)
    merged = merge.merge_sources(parse.first_entries(parsed), catalogue)
    return merge.discovery_totals(parse.source_report(parsed), merged, catalogue)


# Known endpoints for the upsert: every third merged candidate, in all states.
KNOWN = """
, known AS (
  SELECT 1000 + 3 * port + length(host) AS id, entry_key AS dedupe_key, 'old' AS source, host, port, protocol,
    CASE WHEN port % 2 = 0 THEN 'dead' ELSE 'active' END AS status, username,
    CASE WHEN port % 5 = 0 THEN 'FR' END AS country
  FROM merged WHERE port % 3 = 0)
"""


def _known_and_candidates(spark, sf_dir):
    lines = fx.view(spark, sf_dir, "fx_feeds")
    # As in the cycle, the candidates are fixed before the table is read against them.
    merged = cut_lineage(merge.merge_sources(parse.first_entries(parse.parse_lines(lines)), source_catalogue(lines)))
    known = merged.filter("port % 3 = 0").select(
        (F.lit(1000) + F.col("port") * 3 + F.length("host")).alias("id"),
        "dedupe_key",
        F.lit("old").alias("source"),
        "host",
        "port",
        "protocol",
        F.when(F.col("port") % 2 == 0, "dead").otherwise("active").alias("status"),
        "username",
        F.when(F.col("port") % 5 == 0, "FR").alias("country"),
    )
    return known, merged


@query(
    FEED
    + KNOWN
    + f"""
SELECT k.id, k.host, k.port, k.protocol, k.source, CASE WHEN k.status = 'dead' THEN 'new' ELSE k.status END AS status,
  k.username, m.password, coalesce(k.country, m.country) AS country, {iso("TIMESTAMP '2024-01-31 00:00:00'")} AS last_seen,
  'cyc_now' AS last_cycle_id, NULL AS first_cycle_id
FROM known k JOIN merged m ON k.dedupe_key = m.entry_key
UNION ALL
SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY source_ord, line_no), host, port, protocol, source, 'new',
  username, password, country, {iso("TIMESTAMP '2024-01-31 00:00:00'")}, 'cyc_now', 'cyc_now'
FROM merged WHERE port % 3 <> 0"""
)
def upsert_candidates(spark, sf_dir):
    known, merged = _known_and_candidates(spark, sf_dir)
    table = merge.upsert_candidates(known, merged, "cyc_now", fx.NOW)
    return table.select(
        "id", "host", "port", "protocol", "source", "status", "username", "password", "country",
        iso_text(F.col("last_seen")).alias("last_seen"), "last_cycle_id", "first_cycle_id",
    )


@query(
    FEED
    + """
SELECT count(*) AS total, count(*) FILTER (port % 3 <> 0) AS inserted, count(*) FILTER (port % 3 = 0) AS touched FROM merged"""
)
def upsert_counts(spark, sf_dir):
    known, merged = _known_and_candidates(spark, sf_dir)
    return merge.upsert_counts(merged, known)


@query(
    """SELECT id, host, port FROM fx_endpoints WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
    ("fx_endpoints",),
)
def endpoints_by_key(spark, sf_dir):
    """Point lookups as a semi join."""
    keys = fx.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return merge.existing_keys(fx.view(spark, sf_dir, "fx_endpoints"), keys, "id").select("id", "host", "port")


@query(
    """SELECT id, CASE WHEN id % 8 IN (0, 4, 5) THEN NULL WHEN id % 8 = 6 THEN 'unknown type'
    WHEN id % 7 = 0 THEN 'proxy_id required' END AS fault,
  concat('job_', id) AS job_id, CASE id % 8 WHEN 0 THEN 'DISCOVER' WHEN 2 THEN 'SERVICE_CHECK' WHEN 3 THEN 'RECHECK'
    WHEN 4 THEN 'POOL_UPDATE' WHEN 5 THEN 'STATS_UPDATE' WHEN 6 THEN 'NOPE' ELSE 'VALIDATE' END AS type,
  concat('cyc_', day(ts)) AS cycle_id, CASE WHEN id % 7 <> 0 THEN user_id END AS proxy_id, 1 AS attempt
FROM (SELECT event_id AS id, ts, user_id FROM events)"""
)
def parse_jobs(spark, sf_dir):
    got = jobs.parse_jobs(fx.view(spark, sf_dir, "fx_jobs"))
    return got.select("id", "fault", "job_id", "type", "cycle_id", "proxy_id", "attempt")


FEED_BODY = """SELECT id, concat('feed-', CAST(id AS STRING)) AS source, concat('{"meta":{"n":2},"data":{"proxies":["',
    host, ':', CAST(port AS STRING), '",', CASE id % 4
      WHEN 0 THEN concat('{"ip":"', host, '","port":', CAST(port + 1 AS STRING), ',"scheme":"socks5","country":"de","anon":"high"}')
      WHEN 1 THEN concat('{"endpoint":"socks4://', host, ':', CAST(port + 1 AS STRING), '","level":"elite"}')
      WHEN 2 THEN concat('{"ip":"', host, '","country":"de"}')
      ELSE concat('{"ip":"', host, '","port":"', CAST(port AS STRING), '","geo":"fr","user":"u1","pass":"p1"}') END,
    ']}}') AS body FROM fx_endpoints"""


@query(
    """, e AS (SELECT id, concat('feed-', id) AS source, host, port FROM fx_endpoints)
SELECT source, host, port, 'http' AS protocol, CASE WHEN id % 4 = 3 THEN 'FR' END AS country, 'unknown' AS anonymity,
  CASE WHEN id % 4 = 3 THEN 'u1' END AS username, CASE WHEN id % 4 = 3 THEN 'p1' END AS password FROM e
UNION ALL
SELECT source, host, port + 1, CASE id % 4 WHEN 0 THEN 'socks5' ELSE 'socks4' END,
  CASE id % 4 WHEN 0 THEN 'DE' END, 'elite', NULL, NULL FROM e WHERE id % 4 IN (0, 1)""",
    ("fx_endpoints",),
)
def json_items(spark, sf_dir):
    """JSON feeds to entries with their metadata."""
    bodies = fx.sql(spark, sf_dir, FEED_BODY)
    # Read for its lines and for its metadata.
    mapped = cut_lineage(feeds.map_json_fields(feeds.read_json_items(bodies, "data.proxies")))
    entries = parse.first_entries(parse.parse_lines(feeds.feed_lines(mapped)))
    joined = feeds.attach_metadata(entries, mapped)
    return joined.select("source", "host", "port", "protocol", "country", "anonymity", "username", "password")


@query(
    FEED
    + """, e AS (SELECT id, concat('feed-', id) AS source, host, port FROM fx_endpoints)
SELECT source, host, port, protocol, country, 'unknown' AS anonymity, username, password FROM firsts
UNION ALL SELECT source, host, port, 'http', CASE WHEN id % 4 = 3 THEN 'FR' END, 'unknown',
  CASE WHEN id % 4 = 3 THEN 'u1' END, CASE WHEN id % 4 = 3 THEN 'p1' END FROM e
UNION ALL SELECT source, host, port + 1, CASE id % 4 WHEN 0 THEN 'socks5' ELSE 'socks4' END,
  CASE id % 4 WHEN 0 THEN 'DE' END, 'elite', NULL, NULL FROM e WHERE id % 4 IN (0, 1)""",
    ("fx_endpoints",),
)
def discover_sources(spark, sf_dir):
    """Entries of line lists and JSON feeds together, as a cycle takes them."""
    bodies = fx.sql(spark, sf_dir, FEED_BODY)
    _, entries = discover(fx.view(spark, sf_dir, "fx_feeds"), bodies, "data.proxies")
    return entries.select("source", "host", "port", "protocol", "country", "anonymity", "username", "password")


SOURCE_ROWS = """SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 10 = 7 THEN 'Bad Id' ELSE concat('s-', CAST(s_suppkey % 60 AS STRING)) END AS id,
  CASE s_suppkey % 4 WHEN 0 THEN 'http-list' WHEN 1 THEN 'json-endpoint' WHEN 2 THEN 'local-file' ELSE CASE WHEN s_nationkey < 3 THEN 'ftp' ELSE 'http-list' END END AS kind,
  CASE WHEN s_suppkey % 9 <> 1 THEN concat('https://lists.example/', CAST(s_suppkey AS STRING)) END AS url,
  CASE s_suppkey % 3 WHEN 0 THEN 'lists/a.txt' WHEN 1 THEN '../up.txt' END AS path,
  CASE s_suppkey % 5 WHEN 0 THEN 'socks5' WHEN 1 THEN 'quic' END AS protocol,
  CASE WHEN s_acctbal > 0 THEN s_acctbal / 4000.0 WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS trust, s_suppkey % 11 <> 3 AS enabled FROM supplier"""


@query(
    f""", src AS ({SOURCE_ROWS}), f AS (SELECT *, min(ord) OVER (PARTITION BY id) AS first_ord FROM src)
SELECT ord, id, enabled, least(greatest(coalesce(trust, 0.5), 0.0), 1.0) AS trust,
  CASE WHEN id = 'Bad Id' THEN 'invalid id' WHEN ord > first_ord THEN 'duplicate id'
    WHEN kind NOT IN ('http-list', 'json-endpoint', 'local-file') THEN 'unknown kind'
    WHEN kind = 'local-file' AND path IS NULL THEN 'path required'
    WHEN kind = 'local-file' AND contains(path, '..') THEN 'path leaves the root'
    WHEN kind <> 'local-file' AND url IS NULL THEN 'url required'
    WHEN protocol NOT IN ({", ".join(repr(p) for p in PROTOCOLS)}) THEN 'invalid protocol' END AS fault
FROM f"""
)
def validate_sources(spark, sf_dir):
    checked = lists.validate_sources(fx.sql(spark, sf_dir, SOURCE_ROWS))
    return checked.select("ord", "id", "enabled", "trust", "fault")


