"""One refresh cycle over recorded inputs, from raw lines to the next snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CycleConfig
from ..functions.score import service_quality
from ..functions.text import at, instant
from ..operators import merge, parse, pool, stats, transitions
from ..schemas import CHECKS, CYCLES, ENDPOINTS, SERVICE_CHECKS, conform
from ..session import cut_lineage
from ..sources import feeds
from ..sources.catalogue import Discovered


@dataclass
class CycleInputs:
    """What collectors recorded for a cycle.

    ``lines``: source, line_no, line. ``sources``: source, source_ord, trust. ``outcomes``:
    proxy_id, reachable, latency_ms, error_code, one per endpoint, and what else a check row holds
    (transport, http_status, error_message, attempts, duration_ms) if it is known. ``probes``: proxy_id,
    verdict, latency_ms, reason, one per endpoint, and http_status and details if they are known.
    ``feeds``: source, body of JSON feeds, with their items at ``items_path``; ``mapped``: items of feeds
    that were read before (:func:`..sources.catalogue.read_catalogue`), ``faults``: source, reason of sources
    that could not be read. ``hint`` is the protocol the catalogue gives a ``source``. A source of the
    catalogue without lines or items has failed.
    """

    lines: DataFrame
    sources: DataFrame
    outcomes: DataFrame
    probes: DataFrame
    feeds: DataFrame | None = None
    items_path: str = ""
    mapped: DataFrame | None = None
    faults: DataFrame | None = None
    hint: Column | None = None

    @classmethod
    def from_catalogue(cls, found: Discovered, outcomes: DataFrame, probes: DataFrame) -> CycleInputs:
        """What a catalogue's sources gave, with the recorded checks."""
        return cls(found.lines, found.sources, outcomes, probes, mapped=found.mapped, faults=found.faults, hint=found.hint)


def discover(
    lines: DataFrame,
    bodies: DataFrame | None = None,
    items_path: str = "",
    mapped: DataFrame | None = None,
    hint: Column | None = None,
    keep: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Parsed lines and distinct entries per source, of line lists and of JSON feeds together.

    The items of a feed are lines like any other; what an item says besides its line (country,
    anonymity, account, protocol) is put back on its entry. ``mapped`` are items that were mapped before.
    With ``keep`` parsed lines are written, for callers that read both results.
    """
    held = cut_lineage if keep else lambda df: df
    lines = lines.select("source", "line_no", "line")
    if bodies is not None:
        # Bodies are parsed as JSON once.
        own = cut_lineage(feeds.map_json_fields(feeds.read_json_items(bodies, items_path)))
        mapped = own if mapped is None else mapped.unionByName(own)
    if mapped is None:
        parsed = held(parse.parse_lines(lines, hint))
        return parsed, parse.first_entries(parsed)
    parsed = held(parse.parse_lines(lines.unionByName(feeds.feed_lines(mapped)), hint))
    return parsed, feeds.attach_metadata(parse.first_entries(parsed), mapped)


@dataclass
class CycleResult:
    """The tables after a cycle; nothing is written yet."""

    endpoints: DataFrame
    checks: DataFrame
    service_checks: DataFrame
    cycle: DataFrame
    report: DataFrame
    #: source, reason of every source of the catalogue that gave nothing.
    faults: DataFrame | None = None


def source_faults(inputs: CycleInputs, per_source: DataFrame) -> DataFrame:
    """(source, reason) of the sources that failed: what is known of them, else that they had no lines."""
    silent = inputs.sources.select("source").join(per_source.select("source"), "source", "left_anti")
    known = []
    if inputs.faults is not None:
        known.append(inputs.faults.select("source", "reason"))
    if inputs.feeds is not None:
        known.append(feeds.feed_faults(inputs.feeds, inputs.items_path).select("source", "reason"))
    if not known:
        return silent.withColumn("reason", F.lit("no lines"))
    told = known[0] if len(known) == 1 else known[0].unionByName(known[1])
    told = told.groupBy("source").agg(F.min("reason").alias("told"))
    # A feed may fail beside lines of its source, and a source may be none of the catalogue.
    return silent.join(told, "source", "full").select("source", F.coalesce("told", F.lit("no lines")).alias("reason"))


def run_cycle(
    endpoints: DataFrame,
    inputs: CycleInputs,
    cycle_id: str,
    now: datetime | str,
    cfg: CycleConfig = CycleConfig(),
    finished: Callable[[], datetime | str] | None = None,
) -> CycleResult:
    """Discover, merge, upsert, validate, check the service, sweep and count.

    ``finished`` tells the instant of the end, ``now`` without it.

    What the stages hand on is read more than once, so it is written first; the endpoint table is written once after the merge and stays one lazy scan with small joins
    from there until the caller writes it.
    """
    old = conform(endpoints, ENDPOINTS)
    # Discovery.
    parsed, entries = discover(inputs.lines, inputs.feeds, inputs.items_path, inputs.mapped, inputs.hint, keep=True)
    per_source = cut_lineage(parse.source_report(parsed))
    candidates = cut_lineage(
        merge.with_policy(
            merge.merge_sources(entries, inputs.sources, cfg.candidate_cap), cfg.allow_private
        )
    )
    accepted = candidates.filter("allowed")
    # Read by every later stage, so it is written once instead of joined four times.
    upserted = cut_lineage(merge.upsert_candidates(old, accepted, cycle_id, now))
    # Validation. Decisions use the rows as they were before the claim.
    queue = cut_lineage(pool.validation_queue(upserted, now, cfg.queue))
    outcomes = inputs.outcomes.join(queue.select(F.col("id").alias("proxy_id")), "proxy_id", "left_semi")
    plan = cut_lineage(
        transitions.plan_validation(queue, outcomes, now, accepted.select("dedupe_key", "trust"), cfg.score)
    )
    claimed = transitions.mark_pending(upserted, queue, cycle_id)
    validated = transitions.apply_validation(claimed, plan, now)
    # Service checks.
    service_cfg = cfg.service
    if service_cfg.enabled and service_cfg.budget_per_cycle != 0:
        wanted = cut_lineage(pool.cycle_service_selection(validated, queue.select("id"), now, service_cfg))
        quality = service_quality(
            F.col("verdict"), F.col("latency_ms"), (F.col("_before") == "failed").cast("int")
        )
        before = wanted.select(F.col("id").alias("proxy_id"), F.col("service_status").alias("_before"))
        results = inputs.probes.join(before, "proxy_id").select(
            "proxy_id",
            quality["status"].alias("status"),
            "latency_ms",
            "reason",
            F.when(F.col("verdict") != "skipped", quality["quality"]).alias("quality"),
        )
        service_plan = cut_lineage(transitions.plan_service(wanted, results, now, cfg.score, service_cfg))
        checked = transitions.apply_service(validated, service_plan, now)
    else:
        wanted, service_plan, checked = queue.limit(0), None, validated
    # Sweeps and the row of the cycle.
    final = transitions.finalize(checked, cycle_id, now, cfg.score, cfg.max_active)
    sweeps = transitions.sweep_counts(final)
    counts = {
        "discovery": merge.discovery_totals(per_source, candidates, inputs.sources),
        "policy": candidates.agg(F.count_if(~F.col("allowed")).alias("blocked_by_policy")),
        "upsert": merge.upsert_counts(accepted, old),
        "queue": queue.agg(F.count("*").alias("queued")),
        "validation": stats.validation_tally(plan),
        "service": stats.service_tally(
            service_plan.withColumnRenamed("service_status", "status")
            if service_plan is not None
            else wanted.select("status")
        ),
        "pool": sweeps,
    }
    report = cut_lineage(cycle_report(counts, cycle_id, now))
    return CycleResult(
        endpoints=final.select(*ENDPOINTS.names),
        checks=check_rows(plan, queue, cycle_id, now, inputs.outcomes),
        service_checks=service_rows(service_plan, cycle_id, now, service_cfg.service, inputs.probes)
        if service_plan is not None
        else conform(wanted.select(), SERVICE_CHECKS),
        cycle=cycle_row(report, cycle_id, now, finished() if finished else now),
        report=report,
        faults=source_faults(inputs, per_source),
    )


def cycle_report(counts: dict[str, DataFrame], cycle_id: str, now: datetime | str) -> DataFrame:
    """One row with a struct per stage; every part is a one-row aggregate."""
    spark = next(iter(counts.values())).sparkSession
    parts: list[Column] = [
        df.select(F.struct(*df.columns).alias(name)).scalar().alias(name) for name, df in counts.items()
    ]
    return spark.range(1).select(F.lit(cycle_id).alias("cycle_id"), at(now).alias("started_at"), *parts)


def cycle_row(report: DataFrame, cycle_id: str, now: datetime | str, finished: datetime | str | None = None) -> DataFrame:
    """The completed cycle's row from its report."""
    c = F.col
    end = now if finished is None else finished
    took = round((instant(end) - instant(now)).total_seconds() * 1000)
    return conform(
        report.select(
            "cycle_id",
            F.lit("completed").alias("status"),
            at(now).alias("started_at"),
            at(end).alias("finished_at"),
            F.lit(took).alias("duration_ms"),
            c("discovery.discovered").alias("candidates_discovered"),
            c("upsert.inserted").alias("candidates_new"),
            c("validation.checked").alias("candidates_checked"),
            c("validation.passed").alias("candidates_passed"),
            c("validation.failed").alias("candidates_failed"),
            c("service.checked").alias("service_checked"),
            c("service.passed").alias("service_passed"),
            c("pool.pool_size").alias("pool_size"),
            c("validation.added").alias("pool_added"),
            c("pool.quarantined").alias("pool_quarantined"),
            c("pool.expired").alias("pool_expired"),
        ),
        CYCLES,
    )


def known_columns(recorded: DataFrame | None, names: tuple[str, ...]) -> DataFrame | None:
    """The columns of a record that a plan does not carry, by endpoint; None if it has none of them."""
    have = [] if recorded is None else [name for name in names if name in recorded.columns]
    return recorded.select(F.col("proxy_id").alias("id"), *have) if have else None


def check_rows(
    plan: DataFrame, queue: DataFrame, cycle_id: str, now: datetime | str, outcomes: DataFrame | None = None
) -> DataFrame:
    """The facts a validation plan appends, with what else its outcomes say."""
    facts = plan.join(queue.select("id", "protocol"), "id")
    more = known_columns(outcomes, ("transport", "http_status", "error_message", "attempts", "duration_ms"))
    if more is not None:
        facts = facts.join(more, "id", "left")
    return conform(
        facts.withColumns({"proxy_id": F.col("id"), "cycle_id": F.lit(cycle_id), "created_at": at(now), "id": F.lit(None)}),
        CHECKS,
    )


def service_rows(
    plan: DataFrame, cycle_id: str, now: datetime | str, service: str, probes: DataFrame | None = None
) -> DataFrame:
    """The facts a service plan appends, with what else its probes say."""
    facts = plan.select(
        F.col("id"),
        F.col("id").alias("proxy_id"),
        F.lit(cycle_id).alias("cycle_id"),
        F.lit(service).alias("service"),
        at(now).alias("created_at"),
        "passed",
        F.col("service_status").alias("status"),
        F.col("service_latency_ms").alias("latency_ms"),
        F.col("service_fail_reason").alias("reason"),
    )
    more = known_columns(probes, ("http_status", "details"))
    if more is not None:
        facts = facts.join(more, "id", "left")
    return conform(facts.withColumn("id", F.lit(None)), SERVICE_CHECKS)
