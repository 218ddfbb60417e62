"""Queries that write tables, commit them and read them back: cycles, bucketed merges, retention by day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..config import CycleConfig
from ..functions.text import iso_text
from ..operators import history
from ..session import shared_folder
from ..sources.catalogue import read_catalogue
from ..sources.tables import Tables
from ..streaming.state import EndpointStates
from . import refresh
from .cycle import CycleInputs, discover
from .queries_parse import FEED, KNOWN, _known_and_candidates
from .queries_pool import DEAD_SINCE
from .queries_state import CYCLE_SQL, keyed
from .registry import TS, iso, query


def tables_of(spark, buckets: int = 16) -> Tables:
    """Empty tables in a folder of their own."""
    return Tables(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", buckets)


# One merge into buckets ---------------------------------------------------------


@query(
    FEED
    + KNOWN
    + f"""
SELECT k.id, k.host, k.port, k.protocol, CASE WHEN k.status = 'dead' THEN 'new' ELSE k.status END AS status,
  coalesce(k.country, m.country) AS country, {iso(TS)} AS last_seen, 'cyc_now' AS last_cycle_id, NULL AS first_cycle_id
FROM known k JOIN merged m ON k.dedupe_key = m.entry_key
UNION ALL
SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY source_ord, line_no), host, port, protocol, 'new',
  country, {iso(TS)}, 'cyc_now', 'cyc_now'
FROM merged WHERE port % 3 <> 0"""
)
def merge_into_buckets(spark, sf_dir):
    """Candidates merged into a committed, bucketed table and read back."""
    known, merged = _known_and_candidates(spark, sf_dir)
    tables = tables_of(spark)
    tables.commit("endpoints", known, "1", fx.NOW)
    refresh.merge_candidates(tables, merged, "cyc_now", fx.NOW)
    rows = tables.snapshot("endpoints")
    return rows.select(
        "id", "host", "port", "protocol", "status", "country", iso_text(F.col("last_seen")).alias("last_seen"),
        "last_cycle_id", "first_cycle_id",
    )


# Retention by day ---------------------------------------------------------------

BURIED_SQL = "SELECT id FROM fx_endpoints WHERE status = 'dead' AND last_passed_at IS NULL AND id % 3 = 0"


@query(
    f"""SELECT 'checks' AS name, id, {iso("created_at")} AS at FROM fx_checks
  WHERE created_at >= {TS} - INTERVAL '7' DAY AND proxy_id NOT IN ({BURIED_SQL})
UNION ALL SELECT 'service_checks', id, {iso("created_at")} FROM fx_service
  WHERE created_at >= {TS} - INTERVAL '7' DAY AND proxy_id NOT IN ({BURIED_SQL})
UNION ALL SELECT 'endpoints', id, {iso("last_passed_at")} FROM fx_endpoints WHERE id NOT IN ({BURIED_SQL})
UNION ALL SELECT 'cycles', CAST(substr(cycle_id, 5) AS BIGINT), {iso("finished_at")} FROM fx_cycles
  WHERE finished_at >= {TS} - INTERVAL '30' DAY""",
    ("fx_endpoints", "fx_checks", "fx_service", "fx_cycles"),
)
def retention_by_day(spark, sf_dir):
    """Every row that the daily clean-up keeps, read back from the committed tables."""
    tables = tables_of(spark)
    seen = F.expr(fx.spark_sql_text(DEAD_SINCE))
    tables.commit("endpoints", keyed(fx.endpoints(spark, sf_dir)).withColumn("last_seen", seen), "1", fx.NOW)
    tables.commit("cycles", fx.view(spark, sf_dir, "fx_cycles"), "1", fx.NOW)
    for name, view in (("checks", "fx_checks"), ("service_checks", "fx_service")):
        tables.append(name, fx.view(spark, sf_dir, view), "all")
    refresh.prune(tables, fx.NOW)
    row = lambda df, name, number, at: df.select(F.lit(name).alias("name"), number.alias("id"), iso_text(F.col(at)).alias("at"))
    return (
        row(tables.facts("checks"), "checks", F.col("id"), "created_at")
        .unionByName(row(tables.facts("service_checks"), "service_checks", F.col("id"), "created_at"))
        .unionByName(row(tables.snapshot("endpoints"), "endpoints", F.col("id"), "last_passed_at"))
        .unionByName(row(tables.snapshot("cycles"), "cycles", F.substring("cycle_id", 5, 20).cast("bigint"), "finished_at"))
    )


# Key/value rows -------------------------------------------------------------------


@query(
    f"""SELECT concat('events.', event_type) AS key, CAST(count(*) AS VARCHAR) AS value, {iso(TS)} AS updated_at
FROM events WHERE event_type <> 'error' GROUP BY event_type"""
)
def meta_written(spark, sf_dir):
    """Key/value rows that are set, set again and removed, read back from the newest commit."""
    tables = tables_of(spark)
    # As many rows as there are kinds of events.
    for row in fx.table(spark, sf_dir, "events").groupBy("event_type").count().collect():
        key = f"events.{row['event_type']}"
        tables.put_meta(key, "0", "2024-01-30T00:00:00Z")
        tables.put_meta(key, str(row["count"]), fx.NOW)
    tables.put_meta("events.error", None, fx.NOW)
    return tables.meta().select("key", "value", iso_text(F.col("updated_at")).alias("updated_at"))


# Sources from a catalogue ------------------------------------------------------------

ITEMS = """SELECT id, concat('"', host, ':', CAST(port AS STRING), '",', CASE id % 4
      WHEN 0 THEN concat('{"ip":"', host, '","port":', CAST(port + 1 AS STRING), ',"scheme":"socks5","country":"de","anon":"high"}')
      WHEN 1 THEN concat('{"endpoint":"socks4://', host, ':', CAST(port + 1 AS STRING), '","level":"elite","note":"a, [b] {c} \\\\\""}')
      WHEN 2 THEN concat('{"ip":"', host, '","country":"de"}')
      ELSE concat('{"ip":"', host, '","port":"', CAST(port AS STRING), '","geo":"fr","user":"u1","pass":"p1"}') END) AS item FROM fx_endpoints"""
CATALOGUE = "id string, kind string, url string, path string, protocol string, trust double, enabled boolean, ord int, items_path string"


def written_sources(spark, sf_dir) -> tuple[DataFrame, str]:
    """A catalogue and the folder of its bodies: the fixture's lists, one feed of all endpoints, and broken ones."""
    folder = f"{shared_folder(spark)}/bodies-{uuid.uuid4().hex}"
    lines = fx.view(spark, sf_dir, "fx_feeds")
    # A file per list, in the order of its lines.
    placed = lines.repartition("source").sortWithinPartitions("source", "line_no")
    placed.select(F.col("source").alias("id"), F.col("line").alias("value")).write.partitionBy("id").text(f"{folder}/lists")
    items = fx.sql(spark, sf_dir, ITEMS)
    comma = F.when(F.col("id") == items.agg(F.min("id").alias("id")).scalar(), "").otherwise(",")
    body = items.select("id", F.concat(comma, "item").alias("value"))
    ends = spark.createDataFrame([(-1, '{"meta":{"proxies":[1]},"data":{"n":[[2]],"proxies":['), (1 << 60, ']},"end":"]"}')], "id bigint, value string")
    body.unionByName(ends).orderBy("id").coalesce(1).select("value").write.text(f"{folder}/feed-all")
    for name, text in (("feed-cut", '{"data":{"proxies":["1.2.3.4:80",'), ("feed-none", '{"data":{"proxies":{}}}')):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    feeds = [(n, "json-endpoint", "https://x", None, None, 0.5, True, i, "data.proxies") for i, n in enumerate(("feed-all", "feed-cut", "feed-none", "feed-gone"))]
    ids = lines.select("source").distinct()
    number = F.regexp_extract("source", "[0-9]+$", 0).cast("int")
    listed = ids.select(
        F.col("source").alias("id"), F.lit("local-file").alias("kind"), F.lit(None).cast("string").alias("url"),
        F.concat(F.lit("lists/id="), "source").alias("path"), F.lit(None).cast("string").alias("protocol"), F.lit(0.5).alias("trust"),
        F.lit(True).alias("enabled"), (10 + number + F.when(F.col("source").startswith("copy"), 100_000).otherwise(0)).alias("ord"),
        F.lit(None).cast("string").alias("items_path"),
    )
    return listed.unionByName(spark.createDataFrame(feeds, CATALOGUE)), folder


@query(
    FEED
    + """, e AS (SELECT id, 'feed-all' AS source, host, port FROM fx_endpoints)
SELECT source, host, port, protocol, country, 'unknown' AS anonymity, username, password FROM firsts
UNION ALL SELECT source, host, port, 'http', CASE WHEN id % 4 = 3 THEN 'FR' END, 'unknown',
  CASE WHEN id % 4 = 3 THEN 'u1' END, CASE WHEN id % 4 = 3 THEN 'p1' END FROM e
UNION ALL SELECT source, host, port + 1, CASE id % 4 WHEN 0 THEN 'socks5' ELSE 'socks4' END,
  CASE id % 4 WHEN 0 THEN 'DE' END, 'elite', NULL, NULL FROM e WHERE id % 4 IN (0, 1)""",
    ("fx_endpoints",),
)
def catalogue_entries(spark, sf_dir):
    """Entries of all sources of a catalogue, lists and one large feed, read from files by kind."""
    configs, folder = written_sources(spark, sf_dir)
    found = read_catalogue(spark, configs, folder, folder)
    _, entries = discover(found.lines, mapped=found.mapped, hint=found.hint)
    return entries.select("source", "host", "port", "protocol", "country", "anonymity", "username", "password")


@query(
    """SELECT * FROM (VALUES ('feed-cut', 'not json'), ('feed-none', 'no list'), ('feed-gone', 'could not be read')) AS t(source, reason)
UNION ALL SELECT source, CAST(count(*) AS VARCHAR) FROM fx_feeds GROUP BY source""",
    ("fx_feeds",),
)
def catalogue_faults(spark, sf_dir):
    """The sources of a catalogue that failed, and the lines of the others."""
    configs, folder = written_sources(spark, sf_dir)
    found = read_catalogue(spark, configs, folder, folder)
    counted = found.lines.groupBy("source").agg(F.count(F.lit(1)).cast("string").alias("reason"))
    return found.faults.unionByName(counted)


# Endpoint state from late batches ---------------------------------------------------


@query(
    """, c AS (SELECT *, max(CASE WHEN reachable THEN created_at END) OVER (PARTITION BY proxy_id) AS good FROM fx_checks)
SELECT proxy_id, count(*) AS check_count, count(*) FILTER (reachable) AS pass_count, count(*) FILTER (good IS NULL OR created_at > good)
  AS consecutive_failures, strftime(max(created_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_checked_at, strftime(max(good), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_passed_at
FROM c GROUP BY proxy_id""",
    ("fx_checks",),
)
def endpoint_state_late(spark, sf_dir):
    """The whole check log folded in three batches, the latest checks first, each into a committed state."""
    checks = fx.view(spark, sf_dir, "fx_checks").select("id", "proxy_id", "created_at", "reachable")
    states = EndpointStates(spark, f"{shared_folder(spark)}/states-{uuid.uuid4().hex}", 8)
    third = F.expr("CAST(day(created_at) AS INT) % 3")
    for number, part in enumerate((2, 0, 1)):
        states.fold(checks.filter(third == part), number)
    return states.rows().withColumns({n: iso_text(F.col(n)) for n in ("last_checked_at", "last_passed_at")})


# Cycles -------------------------------------------------------------------------

POOL_LINES = """SELECT 'known' AS source, id AS line_no,
  concat(protocol, '://', CASE WHEN username IS NULL THEN '' ELSE concat(username, ':pw@') END, host, ':', CAST(port AS STRING)) AS line
FROM fx_endpoints
UNION ALL SELECT 'fresh' AS source, s_suppkey AS line_no,
  concat('http://45.33.', CAST(CAST(floor(s_suppkey / 250) AS BIGINT) AS STRING), '.', CAST(s_suppkey % 250 AS STRING), ':65000') AS line
FROM supplier"""

@query(
    ", seen AS (SELECT *, CASE WHEN status = 'dead' THEN 'new' ELSE status END AS now_status, 0.5 AS trust FROM fx_endpoints)"
    + CYCLE_SQL
    + f"""
SELECT cycle_id, CASE WHEN status = 'failed' THEN 'failed' ELSE 'completed' END AS status, {iso("started_at")} AS started_at,
  {iso("finished_at")} AS finished_at, 0 AS duration_ms, NULL AS error, 0 AS candidates_discovered, 0 AS candidates_new,
  candidates_checked, candidates_passed, candidates_failed, 0 AS service_checked, 0 AS service_passed, 0 AS pool_size, 0 AS pool_added,
  0 AS pool_quarantined, 0 AS pool_expired FROM fx_cycles
UNION ALL SELECT 'now_a', 'failed', {iso(TS)}, {iso(TS)}, 0, 'the outcomes are out of reach', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0
UNION ALL SELECT 'now_b', 'failed', {iso(TS)}, {iso(TS)}, 0, 'abandoned: worker restarted mid-cycle', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0
UNION ALL SELECT 'now_c', 'completed', {iso(TS)}, {iso(f"{TS} + INTERVAL '90' SECOND")}, 90000, NULL,
  (SELECT count(*) FROM fx_endpoints) + (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier),
  (SELECT count(*) FROM planned), (SELECT count(*) FROM planned WHERE ok), (SELECT count(*) FROM planned WHERE NOT ok),
  (SELECT count(*) FROM probed), (SELECT count(*) FROM probed WHERE verdict = 'passed'),
  (SELECT count(*) FROM swept WHERE last_status = 'active' AND sweep IS NULL),
  (SELECT count(*) FROM planned WHERE ok AND new_status = 'active' AND before <> 'active'),
  (SELECT count(*) FROM swept WHERE sweep = 'quarantined'), (SELECT count(*) FROM swept WHERE sweep = 'expired')""",
    ("fx_endpoints", "fx_checks", "fx_service", "fx_cycles"),
)
def cycle_log(spark, sf_dir):
    """The cycle rows after one refresh that failed, one that died and one that was committed, clean-up included."""
    tables = tables_of(spark)
    tables.commit("endpoints", keyed(fx.endpoints(spark, sf_dir)), "0", fx.NOW)
    tables.commit("cycles", fx.view(spark, sf_dir, "fx_cycles"), "0", fx.NOW)
    outcomes = history.latest_result(fx.view(spark, sf_dir, "fx_checks"), ["proxy_id"])
    probes = history.latest_result(fx.view(spark, sf_dir, "fx_service"), ["proxy_id"]).withColumnRenamed("status", "verdict")
    sources = spark.createDataFrame([("known", 0, 0.5), ("fresh", 1, 0.5)], "source string, source_ord int, trust double")

    def unreachable() -> CycleInputs:
        raise OSError("the outcomes are out of reach")

    cfg = CycleConfig(allow_private=True)
    refresh.refresh(tables, unreachable, "now_a", fx.NOW, cfg)
    refresh.start(tables, "now_b", fx.NOW)
    inputs = CycleInputs(fx.sql(spark, sf_dir, POOL_LINES), sources, outcomes, probes)
    refresh.refresh(tables, inputs, "now_c", fx.NOW, cfg, lambda: "2024-01-31T00:01:30Z")
    times = {name: iso_text(F.col(name)) for name in ("started_at", "finished_at")}
    return tables.snapshot("cycles").withColumns(times)
