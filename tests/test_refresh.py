"""Cycles that commit as one: killed, raced, failed and repeated; merges into buckets; retention by day."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.config import CycleConfig, RetentionConfig
from tidewatch.operators import merge, transitions
from tidewatch.plans import queries_tables
from tidewatch.plans import refresh as R
from tidewatch.plans.cycle import CycleInputs, CycleResult
from tidewatch.schemas import CHECKS, CYCLES, ENDPOINTS, SERVICE_CHECKS, conform
from tidewatch.session import cut_lineage
from tidewatch.sources.ledger import Ledger, Lost
from tidewatch.sources.tables import Tables

NOW, END = "2026-01-01T12:00:00Z", "2026-01-01T12:01:30Z"


def key(n):
    return f"{n:016x}"


def endpoints(spark, n=40, **columns):
    rows = spark.range(1, n + 1).select(
        "id",
        F.lpad(F.lower(F.hex("id")), 16, "0").alias("dedupe_key"),
        F.concat(F.lit("203.0.113."), F.col("id").cast("string")).alias("host"),
        F.lit(80).alias("port"),
        F.lit("http").alias("protocol"),
    )
    return conform(rows.withColumns({k: v if hasattr(v, "alias") else F.lit(v) for k, v in columns.items()}), ENDPOINTS)


def rows_of(df, drop=("id",)):
    return sorted(map(str, df.drop(*drop).collect()))


@pytest.fixture(scope="module")
def result(spark):
    """A cycle's tables, computed once."""
    rows = endpoints(spark, 40, status="active", last_seen=F.lit("2026-01-01").cast("timestamp_ntz"))
    checks = conform(
        spark.range(1, 11).select(F.col("id").alias("proxy_id"), F.lit("c2").alias("cycle_id"), F.lit(NOW).cast("timestamp_ntz").alias("created_at")),
        CHECKS,
    )
    service = conform(checks.select("proxy_id", "cycle_id", "created_at"), SERVICE_CHECKS)
    cycle = spark.createDataFrame([("c2", "completed", 40)], "cycle_id string, status string, pool_size long")
    cycle = conform(cycle.withColumn("started_at", F.lit(NOW).cast("timestamp_ntz")), CYCLES)
    parts = [cut_lineage(x) for x in (rows, checks, service, cycle)]
    return CycleResult(*parts, report=parts[-1])


def prepared(spark, root):
    tables = Tables(spark, str(root), 4)
    tables.commit("endpoints", endpoints(spark, 30), "0", NOW)
    return tables


def state(tables):
    return {
        "endpoints": rows_of(tables.snapshot("endpoints"), ()),
        "cycles": rows_of(tables.snapshot("cycles")),
        "checks": rows_of(tables.facts("checks")),
        "service": rows_of(tables.facts("service_checks")),
        "values": {k: v[0] for k, v in tables.ledger.latest().values.items()},
    }


class Killed(BaseException):
    """A driver that dies: nothing in the library catches it."""


STEPS = [
    ("write_cycles", 1), ("commit", 1), ("write_endpoints", 1), ("write_facts", 1), ("write_facts", 2), ("write_cycles", 2),
    ("commit", 2), ("commit", 3),
]


@pytest.mark.parametrize("step", STEPS, ids=lambda s: f"{s[0]}{s[1]}")
def test_killed_between_any_two_writes(spark, tmp_path, monkeypatch, result, step):
    monkeypatch.setattr(R, "run_cycle", lambda *a, **k: result)
    clean = prepared(spark, tmp_path / "clean")
    R.refresh(clean, None, "c2", NOW)
    tables = prepared(spark, tmp_path / "killed")
    owner = Ledger if step[0] == "commit" else Tables
    plain, calls = getattr(owner, step[0]), []

    def dies(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == step[1]:
            raise Killed
        return plain(self, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(owner, step[0], dies)
        with pytest.raises(Killed):
            R.refresh(tables, None, "c2", NOW)
    R.refresh(Tables(spark, str(tmp_path / "killed"), 4), None, "c2", NOW)
    got, want = state(tables), state(clean)
    got["values"].pop(R.LAST_PRUNE, None), want["values"].pop(R.LAST_PRUNE, None)
    assert got == want


def test_racing_runs_leave_one_cycle(spark, tmp_path, monkeypatch, result):
    tables, barrier, out = prepared(spark, tmp_path), threading.Barrier(2), []
    monkeypatch.setattr(R, "run_cycle", lambda *a, **k: result)
    plain = Tables.write_cycles

    def together(self, rows, number):
        parts = plain(self, rows, number)
        if number == 2:
            barrier.wait(60)
        return parts

    monkeypatch.setattr(Tables, "write_cycles", together)

    def run(name):
        try:
            out.append(R.refresh(Tables(spark, str(tmp_path), 4), None, name, NOW).status)
        except Lost:
            out.append("lost")

    threads = [threading.Thread(target=run, args=(n,)) for n in ("c2", "c3")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(out) == ["completed", "lost"]
    assert tables.snapshot("cycles").count() == 1 and tables.facts("checks").count() == 10


def test_the_run_that_was_given_up_cannot_commit(spark, tmp_path, monkeypatch, result):
    """A second start closes the row of the first, whose commit then comes too late."""
    tables = prepared(spark, tmp_path)

    def slow(*args, **kwargs):
        with monkeypatch.context() as inner:
            inner.setattr(R, "run_cycle", lambda *a, **k: result)
            assert R.refresh(Tables(spark, str(tmp_path), 4), None, "c2", NOW).status == "completed"
        return result

    monkeypatch.setattr(R, "run_cycle", slow)
    with pytest.raises(Lost):
        R.refresh(tables, None, "c1", NOW)
    rows = {r.cycle_id: (r.status, r.error) for r in tables.snapshot("cycles").collect()}
    assert rows == {"c1": ("failed", "abandoned: worker restarted mid-cycle"), "c2": ("completed", None)}


def test_failed_cycle_leaves_the_rest(spark, tmp_path, monkeypatch, result):
    tables = prepared(spark, tmp_path)
    before = rows_of(tables.snapshot("endpoints"))

    def broken(*args, **kwargs):
        raise ValueError("x" * 500)

    monkeypatch.setattr(R, "run_cycle", broken)
    out = R.refresh(tables, None, "c2", NOW, finished=lambda: END)
    assert (out.status, out.error) == ("failed", "x" * 300)
    row = tables.snapshot("cycles").first()
    assert (row.status, row.duration_ms, row.error) == ("failed", 90_000, "x" * 500)
    assert rows_of(tables.snapshot("endpoints")) == before and tables.get_meta(R.LAST_ERROR) == "x" * 300
    assert tables.get_meta(R.RUNNING) is None
    monkeypatch.setattr(R, "run_cycle", lambda *a, **k: result)
    assert R.refresh(tables, None, "c2", NOW).status == "completed"
    assert R.refresh(tables, None, "c2", NOW).status == "known"
    assert tables.get_meta(R.LAST_ERROR) is None and tables.get_meta(R.LAST_DONE) == "c2"
    assert tables.get_meta(R.NEXT_RUN) == "2026-01-01T12:15:00.000Z" and '"total_known":40' in tables.get_meta(R.STATS)


def test_whole_cycle_with_rich_facts(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), 8)
    lines = spark.createDataFrame([("a", i, f"203.0.112.{i}:80") for i in range(1, 5)], "source string, line_no bigint, line string")
    sources = spark.createDataFrame([("a", 0, 0.8)], "source string, source_ord int, trust double")
    outcomes = spark.createDataFrame(
        [(1, True, 90, None, 204, 1, 95, None), (3, False, None, "timeout", None, 2, 8000, "no answer")],
        "proxy_id bigint, reachable boolean, latency_ms bigint, error_code string, http_status int, attempts int, duration_ms bigint, error_message string",
    )
    probes = spark.createDataFrame(
        [(1, "passed", 200, None, 200, {"rule": "a"})],
        "proxy_id bigint, verdict string, latency_ms bigint, reason string, http_status int, details map<string,string>",
    )
    out = R.refresh(tables, CycleInputs(lines, sources, outcomes, probes), "c1", NOW, CycleConfig(), lambda: END)
    assert out.status == "completed"
    row = tables.snapshot("cycles").first()
    assert (row.duration_ms, row.candidates_new, row.candidates_checked, row.service_passed) == (90_000, 4, 2, 1)
    checks = {r.proxy_id: r for r in tables.facts("checks").collect()}
    assert (checks[1].http_status, checks[1].attempts, checks[1].duration_ms) == (204, 1, 95)
    assert (checks[3].error_message, checks[3].attempts) == ("no answer", 2)
    assert len({r.id for r in checks.values()}) == 2 and all(r.id > 1 << 40 for r in checks.values())
    service = tables.facts("service_checks").first()
    assert (service.http_status, service.details) == (200, {"rule": "a"})


def files_of(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_merge_reads_and_writes_hit_buckets_only(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), 32)
    tables.commit("endpoints", endpoints(spark, 1000), "0", NOW)
    before, parts = files_of(tmp_path), dict(tables.ledger.latest().parts("endpoints"))
    candidates = spark.createDataFrame(
        [(key(7), "a", 0, 1, "203.0.113.7", 80), (key(5000), "a", 0, 2, "203.0.114.1", 80)],
        "dedupe_key string, source string, source_ord int, line_no bigint, host string, port int",
    ).withColumns({n: F.lit(None).cast("string") for n in ("username", "password", "country")} | {"protocol": F.lit("http"), "anonymity": F.lit("unknown")})
    hit = {r[0] for r in candidates.select(tables.bucket()).collect()}
    want = rows_of(merge.upsert_candidates(tables.snapshot("endpoints"), candidates, "c9", NOW), ())
    R.merge_candidates(tables, candidates, "c9", NOW)
    after = tables.ledger.latest().parts("endpoints")
    assert {int(b) for b in after if after[b] != parts.get(b)} == hit and len(hit) <= 2
    assert all(files_of(tmp_path)[p] == t for p, t in before.items())
    assert len(files_of(tmp_path / "endpoints")) == len([p for p in before if "endpoints" in str(p)]) + len(hit)
    assert rows_of(tables.snapshot("endpoints"), ()) == want
    # The next merge takes its ids from the committed figure, not from a scan.
    assert tables.get_meta(R.TOP_ID) == "1001"
    plan = transitions.plan_validation(
        tables.snapshot("endpoints"),
        spark.createDataFrame([(7, True, 50, None)], "proxy_id bigint, reachable boolean, latency_ms bigint, error_code string"),
        NOW,
    )
    want = rows_of(transitions.apply_validation(tables.snapshot("endpoints"), cut_lineage(plan), NOW), ())
    parts = dict(tables.ledger.latest().parts("endpoints"))
    R.apply_validation_plan(tables, plan, tables.snapshot("endpoints").select("id", "dedupe_key"), "v", NOW)
    after = tables.ledger.latest().parts("endpoints")
    assert len([b for b in after if after[b] != parts[b]]) == 1
    assert rows_of(tables.snapshot("endpoints"), ()) == want


def test_merge_again_behind_another_commit(spark, tmp_path, monkeypatch):
    tables = prepared(spark, tmp_path)
    plain, seen = Tables.write_endpoints, []

    def interrupted(self, rows, number, hit=None):
        if not seen:
            seen.append(1)
            tables.put_meta("k", "v", NOW)
        return plain(self, rows, number, hit)

    monkeypatch.setattr(Tables, "write_endpoints", interrupted)
    keys = spark.createDataFrame([(key(3),)], "dedupe_key string")
    R.change_hit(tables, keys, lambda rows, base: rows.withColumn("notes", F.lit("seen")), "x", NOW)
    assert tables.get_meta("k") == "v" and tables.snapshot("endpoints").filter("notes = 'seen'").count() > 0
    assert tables.snapshot("endpoints").count() == 30


def test_retention_by_day(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), 4)
    t = datetime(2026, 1, 1, 12)
    seen = F.when(F.col("id") % 2 == 0, F.lit(t - timedelta(days=20))).otherwise(F.lit(t)).cast("timestamp_ntz")
    tables.commit("endpoints", endpoints(spark, 20, status="dead", last_seen=seen), "0", NOW)
    facts = [(i, i % 20 + 1, t - timedelta(hours=5 * i)) for i in range(60)]
    frame = spark.createDataFrame(facts, "id bigint, proxy_id bigint, created_at timestamp_ntz")
    for batch, rows in (("a", frame.filter("id % 2 = 0")), ("b", frame.filter("id % 2 = 1"))):
        tables.append("checks", rows, batch)
    old = spark.createDataFrame([("c1", "completed", t - timedelta(days=40)), ("c2", "running", t - timedelta(days=40))], "cycle_id string, status string, started_at timestamp_ntz")
    tables.commit("cycles", old, "0", NOW)
    before = files_of(tmp_path)
    parts = dict(tables.ledger.latest().parts("checks"))
    lost = R.prune(tables, NOW, RetentionConfig(results_days=7))
    edge = t - timedelta(days=7)
    gone = {i for i in range(1, 21) if i % 2 == 0}
    kept = [f for f in facts if f[2] >= edge]
    assert lost == {"checks": len(facts) - len(kept), "service_checks": 0, "endpoints": 10, "cycles": 1}
    assert sorted(r.id for r in tables.facts("checks").collect()) == [f[0] for f in kept if f[1] not in gone]
    assert {r.id for r in tables.snapshot("endpoints").collect()} == set(range(1, 21)) - gone
    # Days that stay are the same folders, files untouched.
    after = tables.ledger.latest().parts("checks")
    later = {k: f for k, f in parts.items() if k[:10] > edge.date().isoformat()}
    assert later and later.items() <= after.items() and min(k[:10] for k in after) == edge.date().isoformat()
    assert all(files_of(tmp_path)[p] == m for p, m in before.items())
    # The same id may come back: only facts up to the day it was dropped are left out.
    tables.append("checks", spark.createDataFrame([(999, 2, t + timedelta(days=1))], "id bigint, proxy_id bigint, created_at timestamp_ntz"), "c")
    assert 999 in {r.id for r in tables.facts("checks").collect()}
    # Folders that no kept commit names go, and nothing that is read.
    want = rows_of(tables.facts("checks")), rows_of(tables.snapshot("endpoints"))
    assert tables.ledger.vacuum(1)
    assert (rows_of(tables.facts("checks")), rows_of(tables.snapshot("endpoints"))) == want
    assert len(files_of(tmp_path)) < len(before) and tables.ledger.vacuum(1) == []


def test_commits_are_put_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    base, out, barrier = ledger.latest(), [], threading.Barrier(8)

    def put(n):
        barrier.wait(30)
        try:
            out.append(ledger.commit(base, f"r{n}", NOW, values={"who": str(n)}).run)
        except Lost:
            pass

    threads = [threading.Thread(target=put, args=(n,)) for n in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(out) == 1 and Ledger(spark, str(tmp_path)).latest().run == out[0]
    many = [threading.Thread(target=lambda n=n: Ledger(spark, str(tmp_path)).update("u", NOW, values={f"k{n}": "v"})) for n in range(6)]
    [t.start() for t in many]
    [t.join() for t in many]
    assert {f"k{n}" for n in range(6)} <= set(Ledger(spark, str(tmp_path)).latest().values)


def test_scratch_goes_with_its_block(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from tidewatch.session import scratch, shared_folder, written

    root = Path(urlparse(shared_folder(spark)).path)
    with scratch(spark) as outer:
        kept = written(spark.range(3))
        with scratch(spark) as inner:
            assert inner.startswith(outer) and written(kept).count() == 3
        assert kept.count() == 3 and not list(root.rglob(Path(inner).name))
    assert not list(root.rglob(Path(outer).name))
    assert written(spark.range(2)).count() == 2


def test_endpoint_keys_are_hashed_by_all_cores(spark):
    rows = queries_tables.keyed(endpoints(spark).coalesce(1))
    assert rows.rdd.getNumPartitions() >= 8
    assert rows.filter("length(dedupe_key) = 16").count() == 40
