"""Refresh cycles over the committed tables: start, run, commit as one, fail, recover, and the daily clean-up.

Each step ends in one commit of :class:`..sources.ledger.Ledger`. What a step writes before its commit is
named by nothing, so a run that dies anywhere leaves the tables as the last commit had them, and the same
cycle may run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CycleConfig, RetentionConfig
from ..functions.text import at, instant
from ..operators import history, merge, stats, transitions
from ..session import cut_lineage, scratch
from ..sources.ledger import Lost, Manifest
from ..sources.tables import FACTS, Tables
from .cycle import CycleInputs, run_cycle

#: Keys of the key/value rows a cycle keeps.
RUNNING, LAST_DONE, LAST_ERROR, NEXT_RUN, LAST_PRUNE, STATS = (
    "current_cycle_id",
    "last_completed_cycle_id",
    "last_cycle_error",
    "next_run_at",
    "last_prune_at",
    "stats_snapshot",
)
TOP_ID = "top_id"
#: Ids of facts: the number of the commit, then the endpoint.
FACT_BITS = 40


@dataclass(frozen=True)
class Outcome:
    """How a refresh ended: ``completed``, ``failed`` (with the error), or ``known``, done before."""

    status: str
    number: int
    error: str | None = None


def iso(moment: datetime | str) -> str:
    return instant(moment).isoformat(timespec="milliseconds") + "Z"


def start(tables: Tables, cycle_id: str, now: datetime | str) -> Manifest | None:
    """Commit the running row of a cycle and close those of runs that died; None if the cycle is done.

    Whoever loses the number to another run gets :class:`Lost`.
    """
    base = tables.ledger.latest()
    rows = tables.snapshot("cycles", base)
    own = F.col("cycle_id") == cycle_id
    if not rows.filter(own & (F.col("status") == "completed")).isEmpty():
        return None
    closed = history.recover_abandoned(rows.filter(~own), now).unionByName(rows.filter(own))
    cycles = tables.write_cycles(history.start_cycle(closed, cycle_id, now), base.number + 1)
    return tables.ledger.commit(base, cycle_id, now, {"cycles": cycles}, {RUNNING: cycle_id})


def numbered_facts(rows: DataFrame, number: int) -> DataFrame:
    """Facts with an id that only this commit and endpoint have, the same in every attempt."""
    return rows.withColumn("id", F.lit(number << FACT_BITS) + F.col("proxy_id"))


def refresh(
    tables: Tables,
    inputs: CycleInputs | Callable[[], CycleInputs],
    cycle_id: str,
    now: datetime | str,
    cfg: CycleConfig = CycleConfig(),
    finished: Callable[[], datetime | str] | None = None,
) -> Outcome:
    """One refresh cycle from the newest commit to the next.

    A cycle that is committed as completed is not run again. An error inside the cycle commits a failed row
    and leaves endpoints and facts alone; a process that dies commits nothing, and the next start closes its
    row. ``finished`` tells the instant of the end, ``now`` without it. Of two cycles that run at once one
    commits, the other raises :class:`Lost`.
    """
    # What the cycle writes on its way goes when it has committed.
    with scratch(tables.spark):
        return _refresh(tables, inputs, cycle_id, now, cfg, finished)


def _refresh(
    tables: Tables,
    inputs: CycleInputs | Callable[[], CycleInputs],
    cycle_id: str,
    now: datetime | str,
    cfg: CycleConfig,
    finished: Callable[[], datetime | str] | None,
) -> Outcome:
    begun = start(tables, cycle_id, now)
    if begun is None:
        return Outcome("known", tables.ledger.latest().number)
    end = finished or (lambda: now)
    number = begun.number + 1
    try:
        own = inputs() if callable(inputs) else inputs
        result = run_cycle(tables.snapshot("endpoints", begun), own, cycle_id, now, cfg, end)
        endpoints = tables.write_endpoints(result.endpoints, number)
        changes = {
            "endpoints": endpoints,
            "checks": tables.write_facts("checks", numbered_facts(result.checks, number), cycle_id, number, begun),
            "service_checks": tables.write_facts(
                "service_checks", numbered_facts(result.service_checks, number), cycle_id, number, begun
            ),
        }
        past = tables.snapshot("cycles", begun).filter(F.col("cycle_id") != cycle_id)
        changes["cycles"] = tables.write_cycles(past.unionByName(result.cycle), number)
        written = tables.snapshot("endpoints", Manifest(tables={"endpoints": {p: f for p, f in endpoints.items() if f}}))
        figures = stats.pool_stats(written, now, cfg.score.ttl_minutes, cfg.require_service_pass)
        said = written.agg(F.max("id")).first()[0]
        values = {
            RUNNING: None,
            LAST_DONE: cycle_id,
            LAST_ERROR: None,
            NEXT_RUN: iso(instant(now) + timedelta(minutes=cfg.interval_minutes)),
            STATS: figures.select(F.to_json(F.struct(*figures.columns, F.lit(iso(now)).alias("computed_at")))).first()[0],
            TOP_ID: str(said or 0),
            "buckets": str(tables.buckets),
        }
        done = tables.ledger.commit(begun, cycle_id, end(), changes, values)
    except Lost:
        raise
    except Exception as error:
        return fail(tables, begun, cycle_id, str(error) or type(error).__name__, now, end())
    if history.maintenance_due(done.value(LAST_PRUNE), end()):
        prune(tables, end(), cfg.retention)
    return Outcome("completed", done.number)


def fail(tables: Tables, begun: Manifest, cycle_id: str, error: str, now: datetime | str, end: datetime | str) -> Outcome:
    """Commit the failed row of a started cycle."""
    took = round((instant(end) - instant(now)).total_seconds() * 1000)
    rows = history.fail_cycle(tables.snapshot("cycles", begun), cycle_id, error, end, took)
    cycles = tables.write_cycles(rows, begun.number + 1)
    done = tables.ledger.commit(begun, cycle_id, end, {"cycles": cycles}, {RUNNING: None, LAST_ERROR: error[:300]})
    return Outcome("failed", done.number, error[:300])


# Changes of some buckets ----------------------------------------------------------


def change_hit(
    tables: Tables, keys: DataFrame, change: Callable[[DataFrame, Manifest], DataFrame], run: str, now: datetime | str
) -> Manifest:
    """Rewrite the buckets that ``keys`` (dedupe_key) hit by ``change``, which gets all of their rows.

    Other buckets are neither read nor written. Should another commit come first, the change is made again
    on what that one left.
    """
    listed = keys.select(tables.bucket().alias("bucket")).distinct()
    # As many rows as there are buckets at most.
    hit = sorted(r["bucket"] for r in listed.collect())
    while True:
        base = tables.ledger.latest()
        if not hit:
            return base
        rows = change(tables.snapshot("endpoints", base, hit), base)
        parts = tables.write_endpoints(rows, base.number + 1, hit)
        written = [f"{tables.root}/{f}" for f in parts.values() if f]
        most = tables.spark.read.parquet(*written).agg(F.max("id")).first()[0] if written else 0
        top = max(int(base.value(TOP_ID) or 0), most or 0)
        try:
            return tables.ledger.commit(
                base, run, now, {"endpoints": parts}, {TOP_ID: str(top), "buckets": str(tables.buckets)}
            )
        except Lost:
            continue


def top_id(tables: Tables, base: Manifest) -> int:
    """The largest endpoint id: the committed figure, or a scan of the ids where there is none."""
    said = base.value(TOP_ID)
    return int(said) if said else tables.snapshot("endpoints", base).agg(F.max("id")).first()[0] or 0


def merge_candidates(tables: Tables, candidates: DataFrame, cycle_id: str, now: datetime | str) -> Manifest:
    """Upsert candidates (unique by ``dedupe_key``) into the buckets they hit."""
    with scratch(tables.spark):
        fresh = cut_lineage(candidates)
        change = lambda rows, base: merge.upsert_candidates(rows, fresh, cycle_id, now, top=top_id(tables, base))
        return change_hit(tables, fresh, change, cycle_id, now)


def apply_validation_plan(tables: Tables, plan: DataFrame, keys: DataFrame, run: str, now: datetime | str) -> Manifest:
    """Apply a validation plan to the buckets of its endpoints. ``keys``: id, dedupe_key."""
    with scratch(tables.spark):
        own = cut_lineage(plan)
        change = lambda rows, base: transitions.apply_validation(rows, own, now)
        return change_hit(tables, keys.join(own, "id", "left_semi"), change, run, now)


def apply_service_plan(tables: Tables, plan: DataFrame, keys: DataFrame, run: str, now: datetime | str) -> Manifest:
    """Apply a service plan to the buckets of its endpoints. ``keys``: id, dedupe_key."""
    with scratch(tables.spark):
        own = cut_lineage(plan)
        change = lambda rows, base: transitions.apply_service(rows, own, now)
        return change_hit(tables, keys.join(own, "id", "left_semi"), change, run, now)


# Retention ------------------------------------------------------------------------


def prune(tables: Tables, now: datetime | str, cfg: RetentionConfig = RetentionConfig()) -> dict[str, int]:
    """Commit the tables without what retention drops; how many rows each lost.

    Whole days of facts leave the commit, files and all; only the day the limit falls on is written again.
    Facts of dropped endpoints in days that stay are left out by a list that goes with those days.
    Of the endpoints only the buckets that lose rows are written again.
    """
    with scratch(tables.spark):
        return _prune(tables, now, cfg)


def _prune(tables: Tables, now: datetime | str, cfg: RetentionConfig) -> dict[str, int]:
    base = tables.ledger.latest()
    number, limit = base.number + 1, instant(now) - timedelta(days=cfg.results_days)
    edge, today = limit.date().isoformat(), instant(now).date().isoformat()
    changes: dict[str, dict[str, str | None]] = {}
    lost: dict[str, int] = {}

    def count(name: str, keys: list[str]) -> int:
        paths = [f"{tables.root}/{base.parts(name)[k]}" for k in keys]
        return tables.spark.read.schema(FACTS[name]).parquet(*paths).count() if paths else 0

    for name in FACTS:
        days = {key: key.partition("/")[0] for key in base.parts(name)}
        gone = [key for key, day in days.items() if day < edge]
        cut = [key for key, day in days.items() if day == edge]
        changes[name] = {key: None for key in gone}
        lost[name] = count(name, gone)
        if cut:
            paths = [f"{tables.root}/{base.parts(name)[k]}" for k in cut]
            rows = tables.spark.read.schema(FACTS[name]).parquet(*paths)
            kept = rows.filter(F.col("created_at") >= at(limit))
            left = tables.write_facts(name, kept, f"kept-{number}", number, Manifest())
            changes[name] |= {**{key: None for key in cut}, **left}
            have = [f"{tables.root}/{f}" for f in left.values() if f]
            lost[name] += count(name, cut) - (tables.spark.read.parquet(*have).count() if have else 0)

    endpoints = tables.snapshot("endpoints", base)
    buried = history.buried(now, cfg.dead_days)
    dropped = cut_lineage(endpoints.filter(buried).select("id", tables.bucket().alias("bucket")))
    lost["endpoints"] = dropped.count()
    changes["buried"] = {day: None for day in base.parts("buried") if day < edge}
    if lost["endpoints"]:
        hit = sorted(r["bucket"] for r in dropped.select("bucket").distinct().collect())
        changes["endpoints"] = tables.write_endpoints(tables.snapshot("endpoints", base, hit).filter(~buried), number, hit)
        changes["buried"] |= tables.write_buried(dropped.select(F.col("id").alias("proxy_id")), today, number, base)

    cycles = cut_lineage(tables.snapshot("cycles", base))
    old = history.old_cycle(now, cfg.cycles_days)
    lost["cycles"] = cycles.filter(old).count()
    if lost["cycles"]:
        changes["cycles"] = tables.write_cycles(cycles.filter(~old), number)
    tables.ledger.commit(base, "prune", now, changes, {LAST_PRUNE: iso(now)})
    return lost
