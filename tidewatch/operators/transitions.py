"""Status transitions of endpoints: plans from results, and the table after them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScoreConfig, ServiceConfig
from ..functions.score import combine_scores, score_detailed, should_quarantine
from ..functions.text import at, minutes_since
from .pool import over_capacity

# Notes and codes the sweeps leave behind.
NOTE_EXPIRED = "expired: no successful check within TTL"
NOTE_FAILURES = "quarantined: consecutive failures"
NOTE_CAPACITY = "quarantined: pool capacity"


def _set(df: DataFrame, when: Column, **values: str | Column) -> DataFrame:
    """Assign columns on the rows a condition holds for; types stay as they are."""
    schema = df.schema
    return df.select(
        *[
            (
                F.when(when, values[name] if isinstance(values[name], Column) else F.lit(values[name]))
                .otherwise(F.col(name))
                .cast(schema[name].dataType)
                .alias(name)
                if name in values
                else F.col(name)
            )
            for name in df.columns
        ]
    )


def plan_validation(
    endpoints: DataFrame,
    outcomes: DataFrame,
    now: datetime | str,
    trust: DataFrame | None = None,
    cfg: ScoreConfig = ScoreConfig(),
) -> DataFrame:
    """One update row per checked endpoint.

    A pass joins the pool if the score reaches the floor and is quarantined otherwise. A miss
    quarantines from the failure threshold on (or buries a never-passed row at three times
    it), spares a pool member before, and leaves others quarantined or new.
    ``outcomes``: proxy_id, reachable, latency_ms, error_code. ``trust``: dedupe_key, trust.
    """
    joined = outcomes.select(
        F.col("proxy_id").alias("id"),
        F.col("reachable").alias("_ok"),
        F.when(F.col("reachable"), F.col("latency_ms")).alias("_latency"),
        F.col("error_code").alias("_error"),
    ).join(endpoints, "id")
    if trust is not None:
        joined = joined.join(trust.select("dedupe_key", "trust"), "dedupe_key", "left")
    else:
        joined = joined.withColumn("trust", F.lit(None).cast("double"))
    ok = F.col("_ok")
    staged = joined.withColumns(
        {
            "_fails": F.when(ok, 0).otherwise(F.col("consecutive_failures") + 1),
            "_checks": F.col("check_count") + 1,
            "_passes": F.col("pass_count") + ok.cast("int"),
            "_idle": F.when(ok, F.lit(0.0)).otherwise(minutes_since(F.col("last_passed_at"), now)),
        }
    )
    scored = staged.withColumn(
        "_score",
        score_detailed(
            ok,
            F.col("_latency"),
            F.col("_checks"),
            F.col("_passes"),
            F.col("_fails"),
            F.col("_idle"),
            F.col("service_status"),
            F.col("service_status") == "blocked",
            F.col("trust"),
            F.col("anonymity"),
            cfg,
        ),
    )
    score, fails, before = F.col("_score.score"), F.col("_fails"), F.col("status")
    good = ok & (score >= cfg.min_score)
    worn = ~ok & should_quarantine(fails, cfg)
    hopeless = worn & F.col("last_passed_at").isNull() & (fails >= cfg.max_failures * 3)
    status = (
        F.when(good, "active")
        .when(ok, "quarantined")
        .when(hopeless, "dead")
        .when(worn, "quarantined")
        .when(before.isin("active", "quarantined"), before)
        .otherwise("new")
    )
    note = (
        F.when(good, F.lit(None))
        .when(ok, F.concat(F.lit("low_score:"), score.cast("string")))
        .when(hopeless, "unrecoverable")
        .when(worn, F.concat(F.lit("failures:"), fails.cast("string")))
        .when(before == "active", F.concat(F.lit("transient_failure:"), fails.cast("string")))
        .otherwise(F.concat(F.lit("failures:"), fails.cast("string")))
    )
    return scored.select(
        "id",
        before.alias("status_before"),
        ok.alias("reachable"),
        status.alias("status"),
        F.when(ok, "passed").otherwise("failed").alias("validation_status"),
        F.col("_latency").alias("latency_ms"),
        F.col("_error").alias("error_code"),
        fails.cast("int").alias("consecutive_failures"),
        score.alias("score"),
        F.col("_score.reasons").alias("score_reasons"),
        "service_status",
        note.cast("string").alias("notes"),
    )


def apply_validation(endpoints: DataFrame, plan: DataFrame, now: datetime | str) -> DataFrame:
    """The endpoint table after a validation plan; unchecked rows pass through."""
    update = plan.select(F.col("id").alias("_id"), F.struct(*plan.columns).alias("_new"))
    df = endpoints.join(update, F.col("id") == F.col("_id"), "left")
    new, hit = F.col("_new"), F.col("_id").isNotNull()
    passed = F.coalesce(new["reachable"], F.lit(False))
    df = _set(
        df,
        hit,
        last_passed_at=F.when(passed, at(now)).otherwise(F.col("last_passed_at")),
        last_checked_at=at(now),
        check_count=F.col("check_count") + 1,
        pass_count=F.col("pass_count") + passed.cast("int"),
        last_error_code=new["error_code"],
        notes=F.coalesce(new["notes"], F.col("notes")),
        **{
            name: new[name]
            for name in (
                "status",
                "validation_status",
                "latency_ms",
                "consecutive_failures",
                "score",
                "service_status",
            )
        },
    )
    return df.drop("_id", "_new")


def plan_service(
    endpoints: DataFrame,
    results: DataFrame,
    now: datetime | str,
    cfg: ScoreConfig = ScoreConfig(),
    service: ServiceConfig = ServiceConfig(),
) -> DataFrame:
    """New score and status per service verdict; a pass lifts into the pool, nothing evicts.

    ``results``: proxy_id, status, latency_ms, reason, quality (NULL for no verdict).
    """
    joined = results.select(
        F.col("proxy_id").alias("id"),
        *[F.col(name).alias(f"_{name}") for name in ("status", "latency_ms", "reason", "quality")],
    ).join(endpoints, "id")
    connectivity = score_detailed(
        F.col("validation_status") != "failed",
        F.col("latency_ms"),
        F.col("check_count"),
        F.col("pass_count"),
        F.col("consecutive_failures"),
        minutes_since(F.col("last_passed_at"), now),
        F.col("_status"),
        F.col("_status") == "blocked",
        None,
        F.col("anonymity"),
        cfg,
    )
    scored = joined.withColumn("_connectivity", connectivity["score"])
    passed = F.col("_status") == "passed"
    return scored.select(
        "id",
        passed.alias("passed"),
        F.col("_status").alias("service_status"),
        F.col("_latency_ms").alias("service_latency_ms"),
        F.col("_reason").alias("service_fail_reason"),
        combine_scores(F.col("_connectivity"), F.col("_quality"), service.connectivity_weight).alias("score"),
        F.when(passed, "active").otherwise(F.col("status")).alias("status_next"),
    )


def apply_service(endpoints: DataFrame, plan: DataFrame, now: datetime | str) -> DataFrame:
    """The endpoint table after a service plan."""
    update = plan.select(F.col("id").alias("_id"), F.struct(*plan.columns).alias("_new"))
    df = endpoints.join(update, F.col("id") == F.col("_id"), "left")
    new = F.col("_new")
    df = _set(
        df,
        F.col("_id").isNotNull(),
        service_checked_at=at(now),
        status=new["status_next"],
        **{
            name: new[name]
            for name in ("service_status", "service_latency_ms", "service_fail_reason", "score")
        },
    )
    return df.drop("_id", "_new")


def mark_pending(endpoints: DataFrame, ids: DataFrame, cycle_id: str) -> DataFrame:
    """Claim rows for a cycle; dead and pending rows are left alone."""
    claimed = ids.select(F.col("id").alias("_id")).distinct()
    df = endpoints.join(claimed, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & F.col("status").isin("new", "quarantined", "active")
    return _set(df, hit, status="pending", last_cycle_id=cycle_id).drop("_id")


def is_own_pending(cycle_id: str) -> Column:
    return (F.col("status") == "pending") & F.coalesce(F.col("last_cycle_id") == cycle_id, F.lit(False))


def is_foreign_pending(cycle_id: str) -> Column:
    return (F.col("status") == "pending") & F.coalesce(F.col("last_cycle_id") != cycle_id, F.lit(True))


def release_pending(endpoints: DataFrame, cycle_id: str, own: bool = True, foreign: bool = True) -> DataFrame:
    """Claims without a result go back to ``new``, this cycle's and leftovers of others."""
    hit = F.lit(False)
    if own:
        hit = hit | is_own_pending(cycle_id)
    if foreign:
        hit = hit | is_foreign_pending(cycle_id)
    return _set(endpoints, hit, status="new")


def is_stale(now: datetime | str, ttl_minutes: int = 90) -> Column:
    """A pool member without a pass inside the time to live."""
    return (F.col("status") == "active") & F.coalesce(F.col("last_passed_at") < at(now, ttl_minutes), F.lit(True))


def expire_stale(endpoints: DataFrame, now: datetime | str, ttl_minutes: int = 90) -> DataFrame:
    return _set(
        endpoints,
        is_stale(now, ttl_minutes),
        validation_status="failed",
        last_error_code="expired",
        notes=NOTE_EXPIRED,
        status="dead",
    )


def quarantine_failures(endpoints: DataFrame, max_failures: int = 3) -> DataFrame:
    hit = (F.col("status") == "active") & (F.col("consecutive_failures") >= max_failures)
    return _set(endpoints, hit, notes=NOTE_FAILURES, status="quarantined")


def enforce_capacity(endpoints: DataFrame, max_active: int | None) -> DataFrame:
    """Demote the worst pool members past the cap."""
    return _set(endpoints, over_capacity(endpoints, max_active), status="quarantined", notes=NOTE_CAPACITY)


def mark_service_untested(endpoints: DataFrame, ids: DataFrame, reason: str) -> DataFrame:
    listed = ids.select(F.col("id").alias("_id")).distinct()
    df = endpoints.join(listed, F.col("id") == F.col("_id"), "left")
    return _set(
        df, F.col("_id").isNotNull(), service_status="skipped", service_fail_reason=reason
    ).drop("_id")


def finalize(
    endpoints: DataFrame, cycle_id: str, now: datetime | str, cfg: ScoreConfig = ScoreConfig(), max_active: int | None = None
) -> DataFrame:
    """The sweeps in order: expire, quarantine, capacity, release. Adds ``swept``.

    ``swept`` names what a row went through, so the counts are one aggregate
    (:func:`sweep_counts`) instead of a before/after comparison per sweep.
    """
    worn = (F.col("status") == "active") & (F.col("consecutive_failures") >= cfg.max_failures)
    df = endpoints.withColumn(
        "swept",
        F.when(is_stale(now, cfg.ttl_minutes), "expired")
        .when(worn, "quarantined")
        .when(F.col("status") == "pending", "released"),
    )
    df = release_pending(
        quarantine_failures(expire_stale(df, now, cfg.ttl_minutes), cfg.max_failures), cycle_id
    )
    return _set(df, over_capacity(df, max_active), status="quarantined", notes=NOTE_CAPACITY, swept="demoted")


def sweep_counts(finalized: DataFrame) -> DataFrame:
    """expired, quarantined, demoted, released and the pool size after the sweeps."""
    return finalized.agg(
        *[
            F.count_if(F.col("swept") == name).alias(name)
            for name in ("expired", "quarantined", "demoted", "released")
        ],
        F.count_if(F.col("status") == "active").alias("pool_size"),
    )
