"""Tunable numbers, with the defaults the results are defined by."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScoreConfig:
    """Weights and thresholds of the endpoint score."""

    ideal_latency_ms: float = 200.0
    max_latency_ms: float = 3000.0
    reliability_weight: float = 0.35
    latency_weight: float = 0.2
    freshness_weight: float = 0.15
    service_weight: float = 0.25
    quality_weight: float = 0.05
    half_life_minutes: float = 45.0
    max_failures: int = 3
    penalty_points: float = 12.0
    ttl_minutes: int = 90
    min_score: float = 25.0


@dataclass(frozen=True)
class QueueConfig:
    """Per-cycle work limits of the validation queue; None is all there is."""

    new_limit: int | None = None
    quarantine_limit: int | None = None
    recheck_limit: int | None = None
    recheck_after_minutes: int = 15
    max_per_cycle: int | None = None


@dataclass(frozen=True)
class ServiceConfig:
    """Limits of the service check stage; a budget of None is all there is."""

    service: str = "svc-a"
    enabled: bool = True
    budget_per_cycle: int | None = None
    min_score: float = 10.0
    recheck_after_minutes: int = 360
    connectivity_weight: float = 0.55


@dataclass(frozen=True)
class RetentionConfig:
    """How long history is kept, in days."""

    results_days: int = 7
    dead_days: int = 14
    cycles_days: int = 30


@dataclass(frozen=True)
class CycleConfig:
    """Everything one refresh cycle needs."""

    score: ScoreConfig = field(default_factory=ScoreConfig)
    queue: QueueConfig = field(default_factory=QueueConfig)
    service: ServiceConfig = field(default_factory=ServiceConfig)
    retention: RetentionConfig = field(default_factory=RetentionConfig)
    candidate_cap: int | None = None
    max_active: int | None = None
    interval_minutes: int = 15
    require_service_pass: bool = True
    allow_private: bool = False
