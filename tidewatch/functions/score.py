"""Endpoint score: factors, breakdown, service quality and pool eligibility."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ScoreConfig
from .text import at, clamp, lookup, round_half_up

DEFAULT = ScoreConfig()

# Factor per service status and per anonymity level.
SERVICE_FACTOR = {"passed": 1.0, "untested": 0.45, "skipped": 0.3, "failed": 0.1, "blocked": 0.0}
ANONYMITY_FACTOR = {"elite": 1.0, "anonymous": 0.75, "transparent": 0.4, "unknown": 0.6}


def latency_score(latency: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """1 up to the ideal, 0 from the maximum on, linear between; unknown is 0."""
    span = cfg.max_latency_ms - cfg.ideal_latency_ms
    return (
        F.when(latency.isNull() | (latency <= 0), 0.0)
        .when(latency <= cfg.ideal_latency_ms, 1.0)
        .when(latency >= cfg.max_latency_ms, 0.0)
        .otherwise((F.lit(cfg.max_latency_ms) - latency) / span)
    )


def freshness_score(minutes: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """Exponential decay since the last pass; never passed is 0."""
    return (
        F.when(minutes.isNull(), 0.0)
        .when(minutes <= 0, 1.0)
        .otherwise(F.pow(F.lit(0.5), minutes / cfg.half_life_minutes))
    )


def reliability_score(checks: Column, passes: Column, passed: Column) -> Column:
    """Historical pass rate with a head start for a first success."""
    return F.when(checks <= 0, F.when(passed, 0.5).otherwise(0.0)).otherwise(
        clamp(passes / checks, 0.0, 1.0)
    )


def penalty(failures: Column, blocked: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """Points for consecutive failures (at most 40) and for a blocking service."""
    points = F.greatest(failures - 1, F.lit(0)) * cfg.penalty_points + F.when(
        failures > 0, cfg.penalty_points / 2
    ).otherwise(0.0)
    return F.least(
        F.least(points, F.lit(40.0)) + F.when(blocked, 25.0).otherwise(0.0), F.lit(60.0)
    )


def score_detailed(
    passed: Column,
    latency: Column,
    checks: Column,
    passes: Column,
    failures: Column,
    minutes: Column,
    service_status: Column,
    blocked: Column,
    trust: Column | None = None,
    anonymity: Column | None = None,
    cfg: ScoreConfig = DEFAULT,
) -> Column:
    """struct(score, factors, reasons); a failed validation scores 0 outright."""
    trust = clamp(F.coalesce(trust, F.lit(0.5)), 0.0, 1.0) if trust is not None else F.lit(0.5)
    level = F.coalesce(anonymity, F.lit("unknown")) if anonymity is not None else F.lit("unknown")
    reliability = reliability_score(checks, passes, passed)
    speed = latency_score(latency, cfg)
    freshness = freshness_score(minutes, cfg)
    service = F.coalesce(lookup(SERVICE_FACTOR, service_status), F.lit(0.3))
    quality = clamp(trust * 0.6 + F.coalesce(lookup(ANONYMITY_FACTOR, level), F.lit(0.6)) * 0.4, 0.0, 1.0)
    points = penalty(failures, blocked, cfg)
    weights = (
        cfg.reliability_weight,
        cfg.latency_weight,
        cfg.freshness_weight,
        cfg.service_weight,
        cfg.quality_weight,
    )
    weighted = (
        reliability * weights[0]
        + speed * weights[1]
        + freshness * weights[2]
        + service * weights[3]
        + quality * weights[4]
    )
    score = round_half_up(clamp(weighted / sum(weights) * 100.0 - points, 0.0, 100.0)).cast("int")

    def shown(value: Column) -> Column:
        return F.when(passed, round_half_up(value, 3)).otherwise(0.0)

    # `score` is recomputed inside the reasons; Catalyst evaluates it once per row.
    reasons = F.filter(
        F.array(
            F.when(blocked, "service_blocked"),
            F.when(points > 0, F.concat(F.lit("failure_penalty:"), failures.cast("string"))),
            F.when(score < cfg.min_score, "below_min_pool_score"),
        ),
        lambda r: r.isNotNull(),
    )
    return F.struct(
        F.when(passed, score).otherwise(0).alias("score"),
        F.struct(
            shown(reliability).alias("reliability"),
            shown(speed).alias("latency"),
            shown(freshness).alias("freshness"),
            shown(service).alias("service"),
            shown(quality).alias("quality"),
            F.when(passed, points).otherwise(0.0).alias("penalty"),
        ).alias("factors"),
        F.when(passed, reasons).otherwise(F.array(F.lit("validation_failed"))).alias("reasons"),
    )


def combine_scores(connectivity: Column, quality: Column, weight: float = 0.55) -> Column:
    """Blend of connectivity and service quality; no verdict leaves connectivity alone."""
    weight = min(1.0, max(0.0, weight))
    base = clamp(connectivity / 100.0, 0.0, 1.0)
    blend = clamp(base * weight + clamp(quality, 0.0, 1.0) * (1 - weight), 0.0, 1.0)
    return round_half_up(F.when(quality.isNull(), base).otherwise(blend) * 100.0).cast("int")


def service_quality(
    verdict: Column, latency: Column, failures: Column, ideal_ms: float = 400.0, max_ms: float = 5000.0
) -> Column:
    """struct(quality, status, reasons) of one probe verdict."""
    speed = F.when(latency.isNull(), 0.6).otherwise(
        clamp((F.lit(max_ms) - latency) / (max_ms - max(1.0, ideal_ms - 1)), 0.0, 1.0)
    )
    stable = clamp(F.lit(1.0) - F.greatest(failures, F.lit(0)) * 0.25, 0.0, 1.0)
    misses = F.least(F.lit(0.3), F.greatest(failures - 1, F.lit(0)) * 0.1)
    quality = (
        F.when(verdict == "passed", clamp(F.lit(0.7) + speed * 0.2 + stable * 0.1, 0.0, 1.0))
        .when(verdict == "blocked", 0.05)
        .when(verdict == "skipped", 0.5)
        .otherwise(F.greatest(F.lit(0.0), F.lit(0.1) - misses))
    )
    note = (
        F.when(verdict == "passed", F.when(speed < 0.4, "slow_service_response"))
        .when(verdict == "blocked", "service_blocked_proxy")
        .when(verdict == "skipped", "no_service_verdict")
        .otherwise("service_check_failed")
    )
    return F.struct(
        quality.alias("quality"),
        status_for_verdict(verdict).alias("status"),
        F.filter(F.array(note), lambda r: r.isNotNull()).alias("reasons"),
    )


def status_for_verdict(verdict: Column) -> Column:
    return F.when(verdict.isin("passed", "blocked", "skipped"), verdict).otherwise("failed")


def should_quarantine(failures: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    return failures >= cfg.max_failures


def is_expired(last_passed: Column, now: datetime | str, ttl_minutes: int = DEFAULT.ttl_minutes) -> Column:
    """Never passed, or strictly older than the time to live."""
    return F.coalesce(last_passed < at(now, ttl_minutes), F.lit(True))


def pool_eligible(
    status: Column,
    score: Column,
    last_passed: Column,
    service_status: Column,
    latency: Column,
    now: datetime | str,
    require_service_pass: bool = True,
    min_score: float = DEFAULT.min_score,
    max_latency: float | None = None,
    ttl_minutes: int = DEFAULT.ttl_minutes,
) -> Column:
    """Healthy, fresh and good enough; an unknown latency never disqualifies."""
    ok = (status == "active") & (score >= min_score) & ~is_expired(last_passed, now, ttl_minutes)
    if require_service_pass:
        ok = ok & (service_status == "passed")
    if max_latency is not None:
        ok = ok & F.coalesce(latency <= max_latency, F.lit(True))
    return ok


def should_check_service(
    score: Column, service_status: Column, min_score: float, retest_blocked: bool
) -> Column:
    """Worth one of the limited service requests."""
    ok = (score >= min_score) & (service_status != "passed")
    return ok if retest_blocked else ok & (service_status != "blocked")


