import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import fixtures
from tidewatch.config import QueueConfig, RetentionConfig, ScoreConfig, ServiceConfig
from tidewatch.functions import score as S
from tidewatch.operators import history, merge, pool, stats, transitions
from tidewatch.plans import registry
from tidewatch.schemas import CYCLES, ENDPOINTS, conform, split_sound
from tidewatch.sources.tables import Tables

registry.load()

SF = "/root/testdata/sf0.01"
NOW = datetime(2026, 1, 1, 12)
BASE = {
    "host": "203.0.113.1", "port": 8080, "protocol": "http", "source": "fixture", "status": "active",
    "validation_status": "passed", "service_status": "passed", "score": 60.0, "anonymity": "unknown",
    "consecutive_failures": 0, "check_count": 0, "pass_count": 0, "last_passed_at": NOW, "last_seen": NOW,
}


def table(spark, *rows):
    full = [{**{n: None for n in ENDPOINTS.names}, **BASE, "id": i + 1, **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in ENDPOINTS.names) for r in full], ENDPOINTS)


def by_id(df):
    return {r.id: r for r in df.collect()}


def ago(**kw):
    return NOW - timedelta(**kw)


def score_of(spark, **over):
    base = dict(passed=True, latency=150, checks=10, passes=10, fails=0, minutes=1.0, service="passed", trust=None, anon=None)
    row = {**base, **over}
    df = spark.createDataFrame(
        [tuple(row.values())],
        "passed boolean, latency int, checks int, passes int, fails int, minutes double, service string, trust double, anon string",
    )
    c = F.col
    detail = S.score_detailed(
        c("passed"), c("latency"), c("checks"), c("passes"), c("fails"), c("minutes"), c("service"),
        c("service") == "blocked", c("trust"), c("anon"),
    )
    return df.select(detail.alias("d")).first().d


def test_factors(spark):
    df = spark.createDataFrame([(None,), (0,), (200,), (1600,), (3000,), (3001,)], "x int")
    assert [r[0] for r in df.select(S.latency_score(F.col("x"))).collect()] == [0, 0, 1, 0.5, 0, 0]
    df = spark.createDataFrame([(None,), (0.0,), (45.0,)], "x double")
    assert [r[0] for r in df.select(S.freshness_score(F.col("x"))).collect()] == [0, 1, 0.5]
    df = spark.createDataFrame([(0, 0, True), (0, 0, False), (4, 3, True)], "c int, p int, ok boolean")
    got = df.select(S.reliability_score(F.col("c"), F.col("p"), F.col("ok"))).collect()
    assert [r[0] for r in got] == [0.5, 0, 0.75]


def test_score(spark):
    assert score_of(spark, passed=False).score == 0
    assert score_of(spark, passed=False).reasons == ["validation_failed"]
    assert 90 <= score_of(spark, latency=120, anon="elite", trust=0.9).score <= 100
    good = score_of(spark)
    failing, stale = score_of(spark, fails=4), score_of(spark, minutes=120.0, service="untested")
    assert failing.score < good.score and stale.score < good.score
    assert failing.factors.penalty == 40 and failing.reasons == ["failure_penalty:4"]
    blocked, untested = score_of(spark, service="blocked"), score_of(spark, service="untested")
    assert blocked.score < untested.score < good.score and "service_blocked" in blocked.reasons
    assert good.factors.reliability == 1 and good.factors.freshness > 0.9


def test_combine_and_quality(spark):
    df = spark.createDataFrame([(72, None), (80, 1.0), (80, 0.0), (200, 2.0)], "c int, q double")
    got = [r[0] for r in df.select(S.combine_scores(F.col("c"), F.col("q"))).collect()]
    assert got == [72, 89, 44, 100]
    rows = [("passed", 399, 0), ("passed", None, 0), ("passed", 5000, 8), ("blocked", 1, 0), ("skipped", 1, 0), ("failed", 1, 5)]
    df = spark.createDataFrame(rows, "v string, l int, f int")
    got = [r[0] for r in df.select(S.service_quality(F.col("v"), F.col("l"), F.col("f"))).collect()]
    assert [round(q.quality, 6) for q in got] == [1.0, 0.92, 0.7, 0.05, 0.5, 0.0]
    assert got[2].reasons == ["slow_service_response"] and got[5].status == "failed"


def outcomes(spark, *rows):
    return spark.createDataFrame(list(rows), "proxy_id bigint, reachable boolean, latency_ms bigint, error_code string")


def test_validation_plan(spark):
    rows = table(
        spark,
        dict(status="new", service_status="untested", last_passed_at=None),
        dict(status="new", service_status="untested", last_passed_at=None),
        dict(status="new", consecutive_failures=2, last_passed_at=None),
        dict(status="new", consecutive_failures=9, last_passed_at=None),
        dict(status="active", last_passed_at=ago(minutes=1), check_count=8, pass_count=8),
        dict(status="quarantined", consecutive_failures=1),
    )
    out = outcomes(
        spark, (1, True, 95, None), (2, False, None, "timeout"), (3, False, None, "x"), (4, False, None, "x"),
        (5, False, None, "timeout"), (6, False, None, "x"), (99, True, 1, None),
    )
    plan = transitions.plan_validation(rows, out, NOW)
    got = by_id(plan)
    assert {i: (r.status, r.notes) for i, r in got.items()} == {
        1: ("active", None),
        2: ("new", "failures:1"),
        3: ("quarantined", "failures:3"),
        4: ("dead", "unrecoverable"),
        5: ("active", "transient_failure:1"),
        6: ("quarantined", "failures:2"),
    }
    assert got[1].score > 25 and got[2].score == 0
    tally = stats.validation_tally(plan).first()
    assert tuple(tally) == (6, 1, 5, 1, 1, 2)
    after = by_id(transitions.apply_validation(rows, plan, NOW))
    assert after[1].last_passed_at == NOW and after[1].check_count == 1 and after[1].pass_count == 1
    assert after[5].last_passed_at == ago(minutes=1) and after[5].last_error_code == "timeout"
    strict = transitions.plan_validation(rows, outcomes(spark, (1, True, 4000, None)), NOW, cfg=ScoreConfig(min_score=99))
    low = strict.first()
    assert low.status == "quarantined" and low.notes.startswith("low_score:")


def test_trust_moves_the_score(spark):
    rows = table(spark, dict(dedupe_key="a"), dict(dedupe_key="b"), dict(dedupe_key="c"))
    trust = spark.createDataFrame([("a", 1.0), ("b", 0.05)], "dedupe_key string, trust double")
    got = by_id(
        transitions.plan_validation(rows, outcomes(spark, *[(i, True, 100, None) for i in (1, 2, 3)]), NOW, trust)
    )
    assert got[1].score > got[3].score > got[2].score


def test_service_plan(spark):
    rows = table(
        spark, dict(latency_ms=95, check_count=1, pass_count=1), dict(latency_ms=95, check_count=1, pass_count=1),
        dict(status="quarantined"),
    )
    results = spark.createDataFrame(
        [(1, "passed", 210, None, 0.95), (2, "blocked", None, "denied:403", 0.05), (3, "passed", 9, None, None)],
        "proxy_id bigint, status string, latency_ms bigint, reason string, quality double",
    )
    plan = transitions.plan_service(rows, results, NOW)
    got = by_id(plan)
    assert got[1].score > 60 > got[2].score and got[3].status_next == "active"
    after = by_id(transitions.apply_service(rows, plan, NOW))
    assert (after[2].service_status, after[2].service_fail_reason, after[2].status) == ("blocked", "denied:403", "active")
    assert after[3].status == "active" and after[1].service_checked_at == NOW


def test_finalize(spark):
    rows = table(
        spark,
        dict(last_passed_at=ago(hours=3)),
        dict(consecutive_failures=4),
        dict(status="pending", last_cycle_id="cyc_old"),
        dict(status="pending", last_cycle_id="cyc_new"),
        dict(),
        dict(),
    )
    final = transitions.finalize(rows, "cyc_new", NOW)
    assert tuple(transitions.sweep_counts(final).first()) == (1, 1, 0, 2, 2)
    got = by_id(final)
    assert [got[i].status for i in range(1, 7)] == ["dead", "quarantined", "new", "new", "active", "active"]
    assert got[1].notes.startswith("expired") and got[1].last_error_code == "expired"


def test_capacity(spark):
    rows = table(spark, *[dict(score=11.0 + i) for i in range(5)])
    final = transitions.finalize(rows, "c", NOW, max_active=2)
    assert transitions.sweep_counts(final).first().demoted == 3
    assert sorted(r.score for r in final.filter("status = 'active'").collect()) == [14, 15]
    ties = table(spark, dict(latency_ms=None), dict(latency_ms=50), dict(latency_ms=10), dict(latency_ms=10))
    out = {r.id for r in ties.filter(pool.over_capacity(ties, 1)).collect()}
    assert out == {1, 2, 3}


def test_read_pool(spark):
    rows = table(
        spark,
        dict(score=90.0, latency_ms=100, country="US"),
        dict(score=90.0, latency_ms=None, country="DE"),
        dict(score=95.0, service_status="failed", latency_ms=30, country="US"),
        dict(score=50.0, last_passed_at=ago(minutes=200)),
        dict(score=50.0, status="quarantined"),
        dict(score=90.0, latency_ms=100, protocol="socks5", username="u", password="p"),
    )
    ids = lambda **kw: [r.id for r in pool.read_pool(rows, pool.PoolQuery(**kw), NOW).collect()]
    assert ids() == [1, 6, 2]
    assert ids(service="off") == [3, 1, 6, 2]
    assert ids(service="preferred") == [1, 6, 2, 3]
    assert ids(limit=1, offset=1) == [6]
    assert ids(country="us", service="off") == [3, 1]
    assert ids(max_latency_ms=500) == [1, 6] and ids(protocol="socks5") == [6] and ids(min_score=91) == []
    page = pool.read_pool(rows, pool.PoolQuery(limit=1), NOW)
    assert page.first().pool_size == 3 and not {"username", "password"} & set(page.columns)


def test_stats(spark):
    rows = table(
        spark,
        dict(score=88.0, latency_ms=150, check_count=4, pass_count=3, last_checked_at=NOW),
        dict(score=70.0, latency_ms=900, check_count=5, pass_count=4, protocol="socks5", last_checked_at=NOW),
        dict(status="quarantined", score=10.0, service_status="failed", check_count=9, pass_count=1, last_passed_at=None),
    )
    row = stats.pool_stats(rows, NOW).first()
    assert (row.pool_size, row.quarantined, row.total_known) == (2, 1, 3)
    assert (row.http, row.https, row.socks4, row.socks5) == (1, 0, 0, 1)
    assert (row.avg_latency_ms, row.min_latency_ms, row.max_latency_ms, row.p95_latency_ms) == (525, 150, 900, 900)
    assert (row.service_passed, row.avg_score, row.last_update) == (2, 79.0, NOW)
    assert row.pass_rate == round(8 / 18, 4)
    empty = stats.pool_stats(rows.filter("false"), NOW).first()
    assert empty.pool_size == 0 and empty.p95_latency_ms is None and empty.pass_rate is None


def test_queue(spark):
    rows = table(
        spark, dict(status="new"), dict(status="new"), dict(status="new"), dict(status="quarantined", last_checked_at=NOW),
        dict(status="quarantined"), dict(last_checked_at=ago(minutes=40)), dict(last_checked_at=ago(minutes=5)), dict(status="pending"),
    )
    cfg = QueueConfig(new_limit=2, quarantine_limit=5, recheck_limit=5)
    got = pool.validation_queue(rows, NOW, cfg).orderBy("branch", "pos").collect()
    assert [r.id for r in got] == [1, 2, 5, 4, 6]
    assert pool.validation_queue(rows, NOW, QueueConfig(2, 5, 5, 15, 3)).count() == 3


def test_weighted_pick(spark):
    rows = table(spark, dict(score=60.0), dict(score=30.0), dict(score=10.0))
    pick = lambda u: pool.weighted_pick(rows, u).first().id
    assert [pick(u) for u in (0.0, 0.59, 0.61, 0.9, 0.91, 1.0)] == [1, 1, 2, 2, 3, 3]
    assert pool.weighted_pick(rows.filter("false"), 0.5).first() is None


def test_upsert_rules(spark):
    known = table(
        spark, dict(id=5, dedupe_key="k1", status="dead", source="old", anonymity="elite"),
        dict(id=9, dedupe_key="k2", country="FR", username="me"),
    )
    rows = [("k1", 0, 1, "DE", None), ("k2", 0, 2, "DE", "you"), ("k3", 0, 3, None, None), ("k4", 1, 0, None, None)]
    new = spark.createDataFrame(rows, "dedupe_key string, source_ord int, line_no bigint, country string, username string")
    new = new.selectExpr(
        "*", "'src' source", "'http' protocol", "'h' host", "80 port", "cast(null as string) password", "'unknown' anonymity"
    )
    got = {r.dedupe_key: r for r in merge.upsert_candidates(known, new, "c2", NOW, block_lines=2).collect()}
    assert (got["k1"].status, got["k1"].country, got["k1"].source, got["k1"].anonymity) == ("new", "DE", "old", "elite")
    assert (got["k2"].country, got["k2"].username, got["k2"].status) == ("FR", "me", "active")
    assert (got["k3"].id, got["k4"].id, got["k3"].status, got["k3"].first_cycle_id) == (10, 11, "new", "c2")
    assert tuple(merge.upsert_counts(new, known).first()) == (4, 2, 2)


def test_cycles(spark):
    cycles = spark.createDataFrame([], CYCLES)
    one = history.start_cycle(cycles, "c1", ago(minutes=30))
    done = history.complete_cycle(one, "c1", {"pool_size": 7}, ago(minutes=29))
    two = history.start_cycle(done, "c2", NOW)
    assert history.current_cycle(two).first().cycle_id == "c2"
    assert history.latest_completed(two).first().pool_size == 7
    lost = history.recover_abandoned(two, NOW)
    assert {r.cycle_id: r.status for r in lost.collect()} == {"c1": "completed", "c2": "failed"}
    due = history.next_check(lost, None, NOW).first()
    assert (due.next_check, due.seconds_until) == (ago(minutes=14), 0)
    planned = history.next_check(lost, NOW + timedelta(minutes=2), NOW).first()
    assert planned.seconds_until == 120
    assert history.maintenance_due(None, NOW) and not history.maintenance_due(ago(hours=23), NOW)


def test_prune(spark):
    rows = table(spark, dict(status="dead", last_passed_at=None, last_seen=ago(days=20)), dict())
    facts = spark.createDataFrame(
        [(1, 1, ago(days=1)), (2, 2, ago(days=1)), (3, 2, ago(days=9))], "id bigint, proxy_id bigint, created_at timestamp_ntz"
    )
    cycles = conform(spark.createDataFrame([("a", "running", ago(days=90)), ("b", "failed", ago(days=90))], "cycle_id string, status string, started_at timestamp_ntz"), CYCLES)
    kept = history.prune_history(rows, facts, facts, cycles, NOW, RetentionConfig())
    assert tuple(kept["counts"].first()) == (1, 1, 1, 1)
    assert [r.id for r in kept["checks"].collect()] == [2] and kept["cycles"].first().cycle_id == "a"


def test_service_selection(spark):
    rows = table(
        spark, dict(service_status="untested", score=50.0), dict(service_status="failed", score=70.0),
        dict(service_checked_at=ago(hours=7), score=80.0), dict(service_checked_at=NOW), dict(score=90.0),
    )
    ids = spark.createDataFrame([(1,), (2,), (4,)], "id bigint")
    chosen = pool.cycle_service_selection(rows, ids, NOW, ServiceConfig(budget_per_cycle=4))
    got = [r.id for r in chosen.orderBy("branch", "pos").collect()]
    assert got == [2, 1, 5, 3]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_registered_work_is_whole(spark):
    rows = fixtures.endpoints(spark, SF)

    def before(name, minutes):
        return F.col(name).isNull() | (F.col(name) < F.lit(fixtures.NOW).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTE"))

    ids = lambda test: {r.id for r in rows.filter(test).select("id").collect()}
    active = F.col("status") == "active"
    queue = ids(F.col("status").isin("new", "quarantined") | (active & before("last_checked_at", 15)))
    due = ids(active & (F.col("score") >= 10) & before("service_checked_at", 360))
    fresh = ids((F.col("validation_status") == "passed") & (F.col("score") >= 10) & (F.col("service_status") != "passed")) & queue
    wanted = {"validation_queue": queue, "service_candidates": due, "cycle_service_selection": due | fresh}
    for name, want in wanted.items():
        got = [r.id for r in registry.QUERIES[name](spark, SF).select("id").collect()]
        assert len(got) == len(set(got)) > 150 and set(got) == want, name


def test_enumerations_are_checked(spark):
    rows = table(spark, dict(), dict(protocol="quic"), dict(port=0), dict(status="odd"))
    good, bad = split_sound(rows)
    assert good.count() == 1 and {r.id: r.fault for r in bad.collect()} == {2: "protocol", 3: "port", 4: "status"}


def test_pool_read_reaches_the_scan(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    tables.commit("endpoints", table(spark, dict(), dict(score=10.0)), "1", NOW)
    page = pool.read_pool(tables.snapshot("endpoints"), pool.PoolQuery(min_score=20), NOW)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = page._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for wanted in ("EqualTo(status,active)", "GreaterThanOrEqual(score,20.0)", "GreaterThanOrEqual(last_passed_at"):
        assert wanted in plan
    assert "password" not in plan and "notes" not in plan
    assert "TakeOrderedAndProject" in plan and page.count() == 1


@pytest.mark.parametrize("seen, total", [([5], 5), ([1, 1, 3], 5)])
def test_service_tally(spark, seen, total):
    names = ["passed", "blocked", "skipped"]
    rows = [(names[i],) for i, n in enumerate(seen) for _ in range(n)]
    got = stats.service_tally(spark.createDataFrame(rows, "status string")).first()
    assert got.checked == total and got.passed == seen[0]
