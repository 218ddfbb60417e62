from datetime import datetime, timedelta
from itertools import permutations

from pyspark.sql import functions as F

from tidewatch.config import CycleConfig
from tidewatch.operators import admission as A
from tidewatch.operators import merge, robots
from tidewatch.operators import parse as P
from tidewatch.plans.cycle import CycleInputs, run_cycle
from tidewatch.schemas import ENDPOINTS
from tidewatch.session import cut_lineage
from tidewatch.sources.tables import Tables
from tidewatch.streaming import jobs as J
from tidewatch.streaming import state as S

NOW = "2026-01-01T12:00:00Z"


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, source_ord int, trust double")


def raw(spark, **texts):
    rows = [(s, i, line) for s, text in texts.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "source string, line_no bigint, line string")


def test_merge_first_source_wins(spark):
    lines = raw(spark, a="203.0.113.1:80\n203.0.113.2:80", b="203.0.113.2:80\n203.0.113.3:80")
    parsed = P.parse_lines(lines)
    config = sources(spark, ("a", 0, 0.9), ("b", 1, 0.2), ("c", 2, None))
    merged = merge.merge_sources(P.first_entries(parsed), config)
    got = {r.host: (r.source, r.trust) for r in merged.collect()}
    assert got == {
        "203.0.113.1": ("a", 0.9),
        "203.0.113.2": ("a", 0.9),
        "203.0.113.3": ("b", 0.2),
    }
    totals = merge.discovery_totals(P.source_report(parsed), merged, config).first()
    assert tuple(totals) == (4, 3, 0, 1, 2, 1)


def test_candidate_cap(spark):
    texts = {f"s{k}": "\n".join(f"203.0.{k}.{i}:80" for i in range(1, 31)) for k in range(5)}
    parsed = P.parse_lines(raw(spark, **texts))
    config = sources(spark, *[(f"s{k}", k, 0.5) for k in range(5)])
    merged = merge.merge_sources(P.first_entries(parsed), config, 40)
    totals = merge.discovery_totals(P.source_report(parsed), merged, config).first()
    assert (totals.discovered, totals.accepted, totals.duplicates) == (150, 40, 110)


def test_cycle_end_to_end(spark):
    blob = "\n".join(
        ["# list", "HTTP", "203.0.112.1:80", "203.0.112.2:80", "203.0.112.2:80", "10.0.0.1:80", "SOCKS5",
         "203.0.112.3:1080", "203.0.112.4:1080", "1.2.3"]
    )
    old = spark.createDataFrame([], ENDPOINTS)
    outcomes = spark.createDataFrame(
        [(1, True, 90, None), (2, True, 150, None), (3, False, None, "timeout"), (4, True, 100, None)],
        "proxy_id bigint, reachable boolean, latency_ms bigint, error_code string",
    )
    probes = spark.createDataFrame(
        [(1, "passed", 200, None), (2, "blocked", None, "denied:403"), (4, "skipped", None, "rate_cooldown")],
        "proxy_id bigint, verdict string, latency_ms bigint, reason string",
    )
    inputs = CycleInputs(raw(spark, a=blob), sources(spark, ("a", 0, 0.8)), outcomes, probes)
    result = run_cycle(old, inputs, "cyc_1", NOW, CycleConfig())
    report = result.report.first()
    assert (report.discovery.discovered, report.discovery.accepted, report.discovery.duplicates) == (10, 5, 1)
    assert report.policy.blocked_by_policy == 1
    assert (report.upsert.total, report.upsert.inserted) == (4, 4)
    assert (report.validation.checked, report.validation.passed, report.validation.added) == (4, 3, 3)
    assert (report.service.checked, report.service.passed, report.service.blocked, report.service.skipped) == (3, 1, 1, 1)
    assert report.pool.pool_size == 3
    rows = {r.id: r for r in result.endpoints.collect()}
    assert [rows[i].status for i in (1, 2, 3, 4)] == ["active", "active", "new", "active"]
    assert rows[1].score > rows[4].score > rows[2].score
    assert rows[3].notes == "failures:1" and rows[3].last_error_code == "timeout"
    assert result.cycle.first().pool_added == 3
    # the same lines again only touch what is known
    known = cut_lineage(result.endpoints)
    again = run_cycle(known, inputs, "cyc_2", NOW, CycleConfig())
    assert tuple(again.report.first().upsert) == (4, 0, 4)
    assert again.endpoints.count() == 4


ROBOTS = {
    "a": "User-agent: Other\nUser-agent: databot/1\nDisallow: /lists\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /",
    "b": "User-agent: *\nAllow: /lists/p.txt\nDisallow: /\nCrawl-delay: 0.05\n",
    "c": "Disallow: /x # early\nSitemap: y\nUser-agent: zzz\nDisallow: /",
    "d": "",
    "e": "User-agent: *\nDisallow:\nUser-agent: *\nDisallow: /*.html$",
}


def test_robots(spark):
    bodies = spark.createDataFrame(list(ROBOTS.items()), "origin string, body string")
    rules = robots.robots_rules(bodies, "origin", "Databot/1.0")
    got = {r.origin: r for r in rules.collect()}
    assert (got["a"].user_agent, got["a"].disallow, got["a"].crawl_delay) == ("other", ["/lists"], 2.0)
    assert (got["b"].user_agent, got["b"].allow, got["b"].disallow) == ("*", ["/lists/p.txt"], ["/"])
    assert (got["c"].user_agent, got["c"].disallow) == ("*", ["/x"])
    assert (got["d"].user_agent, got["d"].allow) == ("databot/1.0", [])
    assert got["e"].disallow == [""]
    urls = spark.createDataFrame(
        [("a", "/lists/1"), ("a", "/x"), ("b", "/lists/p.txt"), ("b", "/q"), ("c", "/xy"), ("f", "/"), ("g", "/")],
        "origin string, path string",
    )
    facts = spark.createDataFrame(
        [(k, 200, None) for k in "abcde"] + [("f", 404, None), ("g", 0, "timeout")],
        "origin string, status int, error string",
    )
    out = robots.robots_decisions(urls, facts, rules, "origin").collect()
    assert {(r.origin, r.path): (r.allowed, r.reason, r.min_interval_ms) for r in out} == {
        ("a", "/lists/1"): (False, "disallow", 2000),
        ("a", "/x"): (True, "no_rules", 2000),
        ("b", "/lists/p.txt"): (True, "allow", 50),
        ("b", "/q"): (False, "disallow", 50),
        ("c", "/xy"): (False, "disallow", 0),
        ("f", "/"): (True, "no_robots", 0),
        ("g", "/"): (False, "fetch_failed", 0),
    }
    gated = robots.robots_decisions(urls, facts, rules, "origin", gate=True).filter("origin in ('f','g')").collect()
    assert {r.origin: (r.allowed, r.reason) for r in gated} == {
        "f": (True, "no_robots"),
        "g": (False, "robots.txt unreadable (timeout)"),
    }


def test_path_patterns(spark):
    rows = [("/a/b.html", "/*.html$", True), ("/a/b.htmlx", "/*.html$", False), ("/a", "", False),
            ("/a.b", "/a.b", True), ("/aXb", "/a.b", False), ("/q/x/y", "/q/*/y", True)]
    df = spark.createDataFrame(rows, "p string, pat string, want boolean")
    assert df.filter(robots.path_matches(F.col("p"), F.col("pat")) != F.col("want")).count() == 0


def checks(spark, n=300):
    t0 = datetime(2024, 1, 1)
    rows = [
        (i, 7 if i % 3 else i % 10, t0 + timedelta(minutes=i * 11), (i * 5) % 7 > 2 and i < n - 40)
        for i in range(n)
    ]
    return rows, "id bigint, proxy_id bigint, created_at timestamp_ntz, reachable boolean"


def fold(rows):
    out = {}
    for i, proxy, ts, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        n, p, f, _, last = out.get(proxy, (0, 0, 0, None, None))
        out[proxy] = (n + 1, p + ok, 0 if ok else f + 1, ts, ts if ok else last)
    return out


def counters_of(df):
    return {r.proxy_id: tuple(r[name] for name in S.COUNTERS) for r in df.collect()}


def test_endpoint_state_batch_and_stream(spark, tmp_path):
    rows, ddl = checks(spark)
    want = fold(rows)
    assert counters_of(A.endpoint_state(spark.createDataFrame(rows, ddl))) == want
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], ddl).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = (
        spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    )
    J.fold_checks(stream, f"{tmp_path}/out", 4).awaitTermination(90)
    states = S.EndpointStates(spark, f"{tmp_path}/out/state")
    assert states.buckets == 4 and counters_of(states.rows()) == want


def late_checks():
    """Three batches in which passes lie between failures of other batches, some at one instant."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + timedelta(minutes=(i * 7) % 40 // 2), i % 5 == 2 and i < 30) for i in range(40)]
    return [rows[k::3] for k in range(3)], rows, "id bigint, proxy_id bigint, created_at timestamp_ntz, reachable boolean"


def test_late_checks_in_any_order(spark):
    parts, rows, ddl = late_checks()
    frames = [cut_lineage(spark.createDataFrame(p, ddl)) for p in parts]
    want = fold(rows)
    assert counters_of(A.endpoint_state(spark.createDataFrame(rows, ddl))) == want
    for order in permutations(range(3)):
        summary, failures = spark.createDataFrame([], S.SUMMARY), spark.createDataFrame([], S.FAILURES)
        for k in order:
            summary, failures = S.merge_summaries(summary, failures, frames[k])
        assert counters_of(S.counters(summary, failures)) == want, order


def test_states_are_settled_and_old_versions_dropped(spark, tmp_path):
    """Within the lateness the places of failures go into a count; the counters stay those of the batch."""
    t0, ddl = datetime(2024, 1, 1), late_checks()[2]
    rows = [(i, i % 2, t0 + timedelta(minutes=i), i in (20, 21)) for i in range(60)]
    # Neighbours change places, so that checks come up to three minutes late.
    shuffled = [rows[i ^ 3] for i in range(60)]
    states = S.EndpointStates(spark, str(tmp_path), 2, late="10 MINUTES")
    for n in range(4):
        states.fold(spark.createDataFrame(shuffled[n * 15 : n * 15 + 15], ddl), n)
        states.fold(spark.createDataFrame(shuffled[n * 15 : n * 15 + 15], ddl), n)
    assert counters_of(states.rows()) == fold(rows)
    assert 0 < states.read("failures").count() <= 11 and states.read("summary").agg(F.sum("settled")).first()[0] >= 25
    assert len(list((tmp_path / "summary").iterdir())) <= 2
    # A pass that is far too late counts, and clears nothing.
    states.fold(spark.createDataFrame([(99, 0, t0 + timedelta(minutes=30, seconds=30), True)], ddl), 9)
    n, passed, failed, *_ = counters_of(states.rows())[0]
    assert (n, passed, failed) == (31, 2, fold(rows)[0][2])


def test_rate_limit_batch_and_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"c{i % 5}", t0 + timedelta(milliseconds=i * 400)) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, client string, ts timestamp_ntz")
    got = A.rate_limit(df, ["client"], "ts", ["id"], most=20, window_seconds=60).collect()
    seen = {}
    for row in sorted(got, key=lambda r: (r.ts, r.id)):
        key = (row.client, int((row.ts - t0).total_seconds()) // 60)
        seen[key] = seen.get(key, 0) + 1
        assert row.nth == seen[key] and row.allowed == (seen[key] <= 20)
        assert row.remaining == max(0, 20 - seen[key])
        assert row.reset_seconds == 60 - int((row.ts - t0).total_seconds()) % 60
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = (
        S.request_counts(stream, ["client"], "ts", 20).writeStream.format("memory").queryName("counts")
        .outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    )
    query.awaitTermination(90)
    counts = {(r.client, r.window_no): (r.requests, r.allowed) for r in spark.table("counts").collect()}
    base = int((t0 - datetime(1970, 1, 1)).total_seconds()) // 60
    assert counts == {(c, w + base): (n, min(n, 20)) for (c, w), n in seen.items()}


def test_crawl_spacing(spark):
    rows = [(i, "a" if i % 4 else "b", (i * 37) % 900 * 10, 50 if i % 4 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, origin string, at_ms bigint, delay bigint")
    got = {r.id: r.slot_ms for r in A.crawl_spacing(df, "origin", "at_ms", ["id"], "delay").collect()}
    slot = None
    for i, origin, t, d in sorted([r for r in rows if r[1] == "a"], key=lambda r: (r[2], r[0])):
        slot = t if slot is None else max(t, slot + d)
        assert got[i] == slot
    assert all(got[i] == t for i, o, t, d in rows if o == "b")


def test_collapse_attempts(spark):
    rows = [(1, 1, "timeout", 0), (1, 2, None, 204), (2, 1, "connect_refused", 0), (2, 2, None, 204),
            (3, 1, "timeout", 0), (3, 2, "timeout", 0), (3, 3, None, 204)]
    df = spark.createDataFrame(rows, "proxy_id int, attempt int, error_code string, status int")
    got = A.collapse_attempts(df, ["proxy_id"], 2, ("status",)).orderBy("proxy_id").collect()
    assert [(r.attempts, r.error_code, r.status) for r in got] == [
        (2, None, 204), (1, "connect_refused", 0), (2, "timeout", 0),
    ]


def test_job_stream(spark, tmp_path):
    bodies = [f'{{"job_id":"j{i}","type":"VALIDATE","cycle_id":"c","proxy_id":{i},"attempt":{1 + i % 2}}}' for i in range(6)]
    spark.createDataFrame([(b,) for b in bodies + ["x"]], "body string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("body string").parquet(f"{tmp_path}/in")
    handle = lambda jobs: jobs.withColumn("ok", F.col("proxy_id") >= 4)
    J.run_jobs(stream, handle, f"{tmp_path}/out").awaitTermination(90)
    ids = lambda name: sorted(r.job_id for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect() if r.job_id)
    assert ids("done") == ["j4", "j5"] and ids("retry") == ["j0", "j2"] and ids("dropped") == ["j1", "j3"]
    assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1


def test_refresh_stream(spark, tmp_path):
    tables = Tables(spark, f"{tmp_path}/tables")
    raw(spark, a="203.0.112.1:80\n203.0.112.2:80").coalesce(1).write.parquet(f"{tmp_path}/in/p0")
    stream = spark.readStream.schema("source string, line_no bigint, line string").option(
        "recursiveFileLookup", "true"
    ).parquet(f"{tmp_path}/in")
    outcomes = spark.createDataFrame(
        [(1, True, 90, None)], "proxy_id bigint, reachable boolean, latency_ms bigint, error_code string"
    )
    probes = spark.createDataFrame([(1, "passed", 90, None)], "proxy_id bigint, verdict string, latency_ms bigint, reason string")
    config = sources(spark, ("a", 0, 0.5))
    J.refresh_stream(stream, config, lambda s: (outcomes, probes), tables, lambda n: NOW).awaitTermination(120)
    assert {r.id: r.status for r in tables.snapshot("endpoints").collect()} == {1: "active", 2: "new"}
    assert tables.facts("checks").count() == 1 and tables.snapshot("cycles").first().pool_size == 1
