"""Aggregates over the inventory and its result history."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import at, round_half_up
from ..schemas import PROTOCOLS


def nearest_rank(column: str, p: float) -> Column:
    """Percentile by nearest rank (``p`` in 0..1), NULL without values.

    Exact; a task's state holds one counter per distinct value, which for millisecond
    latencies is bounded by the request timeout, not by the rows.
    """
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def exact_percentiles(rows: DataFrame, column: str, shares: Sequence[float], accuracy: int = 1000) -> DataFrame:
    """(p, value): percentiles by nearest rank of any numbers, in memory that hangs on no number of values.

    Selection by ranges: a sketch gives two bounds around a rank, one pass counts what lies below, on and
    between them, and the next looks only between them; each pass leaves about a ``accuracy``-th of the
    values. Nulls do not count, NaN is above all numbers; without values there is NULL. The result has a row
    per share; the driver sees counts and bounds alone.
    """
    value = F.col(column).cast("double")
    values = rows.select(value.alias("v")).filter("v is not null")
    total = values.count()
    found = [(float(p), _select(values, max(1, math.ceil(round(p * total, 9))), total, accuracy) if total else None) for p in shares]
    return rows.sparkSession.createDataFrame(found, "p double, value double")


def _select(values: DataFrame, rank: int, total: int, accuracy: int) -> float:
    """The ``rank``-th least of the values, from 1."""
    while total > accuracy:
        # The sketch may be off by a share of 1 / (10 accuracy), so bounds this far apart enclose the rank.
        low, high = max(0.0, (rank - 1) / total - 1 / accuracy), min(1.0, rank / total + 1 / accuracy)
        a, b = values.agg(F.percentile_approx("v", [low, high], 10 * accuracy)).first()[0]
        v = F.col("v")
        below, at_a, between, at_b = values.agg(
            F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if((v == b) & (v > a))
        ).first()
        if rank <= below:
            values, total = values.filter(v < a), below
        elif rank <= below + at_a:
            return a
        elif rank <= below + at_a + between:
            values, rank, total = values.filter((v > a) & (v < b)), rank - below - at_a, between
        elif rank <= below + at_a + between + at_b:
            return b
        else:
            rank -= below + at_a + between + at_b
            values, total = values.filter(v > b), total - below - at_a - between - at_b
    # At most ``accuracy`` values are left.
    return sorted((r[0] for r in values.collect()), key=lambda x: (math.isnan(x), x))[rank - 1]


def average(value: Column | str) -> Column:
    """Mean rounded to an integer, halves up, NULL without values."""
    return round_half_up(F.avg(value)).cast("bigint")


def status_counts() -> list[Column]:
    """Zero-filled rows per status and their total."""
    names = ["active", "quarantined", "dead", "new", "pending"]
    return [F.count_if(F.col("status") == name).alias(name) for name in names] + [F.count("*").alias("total")]


def count_by_status(endpoints: DataFrame) -> DataFrame:
    return endpoints.agg(*status_counts())


def in_pool(now: datetime | str, ttl_minutes: int = 90, require_service_pass: bool = True) -> Column:
    """Active and passed within the time to live, and passed by the service if required."""
    ok = (F.col("status") == "active") & F.coalesce(F.col("last_passed_at") >= at(now, ttl_minutes), F.lit(False))
    return ok & (F.col("service_status") == "passed") if require_service_pass else ok


def protocol_breakdown(endpoints: DataFrame, pool: Column) -> DataFrame:
    """Pool rows per protocol, one row per known protocol, zero-filled."""
    counts = endpoints.agg(*[F.count_if(pool & (F.col("protocol") == name)).alias(name) for name in PROTOCOLS])
    return counts.unpivot([], PROTOCOLS, "protocol", "n")


def pass_rate(checks: Column, passes: Column) -> Column:
    """Passes per check at four digits, NULL without checks."""
    return F.when(checks > 0, round_half_up(passes / checks, 4))


def pool_stats(
    endpoints: DataFrame, now: datetime | str, ttl_minutes: int = 90, require_service_pass: bool = True
) -> DataFrame:
    """Every pool statistic in one scan: one row, filtered aggregates, one partial per task.

    ``pool_size`` counts all active rows; latency, score and protocols cover the fresh pool.
    """
    pool = in_pool(now, ttl_minutes, require_service_pass)
    rated = F.col("status").isin("active", "quarantined")
    staged = endpoints.select(
        "status",
        "protocol",
        pool.alias("pooled"),
        F.when(pool, F.col("latency_ms")).alias("latency"),
        F.when(pool, F.col("score")).alias("points"),
        F.when(rated, F.col("check_count")).alias("checks"),
        F.when(rated, F.col("pass_count")).alias("passes"),
        (pool & (F.col("service_status") == "passed")).alias("served"),
        "last_checked_at",
        "last_passed_at",
    )
    return staged.agg(
        F.count_if(F.col("status") == "active").alias("pool_size"),
        *[c for c, name in zip(status_counts(), ["active", "quarantined", "dead", "new", "pending"]) if name != "new"],
        F.count("*").alias("total_known"),
        *[F.count_if(F.col("pooled") & (F.col("protocol") == name)).alias(name) for name in PROTOCOLS],
        average("latency").alias("avg_latency_ms"),
        nearest_rank("latency", 0.95).cast("bigint").alias("p95_latency_ms"),
        F.min("latency").alias("min_latency_ms"),
        F.max("latency").alias("max_latency_ms"),
        round_half_up(F.avg("points"), 1).alias("avg_score"),
        pass_rate(F.sum("checks"), F.sum("passes")).alias("pass_rate"),
        F.count_if("served").alias("service_passed"),
        F.coalesce(F.max("last_checked_at"), F.max("last_passed_at")).alias("last_update"),
    )


def service_summary(service_checks: DataFrame) -> DataFrame:
    """Per cycle and service: verdict counts, mean latency of the passes, last check."""
    status = F.col("status")
    return service_checks.groupBy("cycle_id", "service").agg(
        F.count("*").alias("checked"),
        *[F.count_if(status == name).alias(name) for name in ("passed", "blocked", "failed")],
        average(F.when(status == "passed", F.col("latency_ms"))).alias("avg_latency_ms"),
        F.max("created_at").alias("last_check"),
    )


def currently_valid(endpoints: DataFrame, now: datetime | str, ttl_minutes: int = 90) -> DataFrame:
    return endpoints.agg(F.count_if(in_pool(now, ttl_minutes)).alias("valid"))


def fresh_verdicts(endpoints: DataFrame, now: datetime | str, recheck_after_minutes: int = 360) -> DataFrame:
    """Pool members whose service pass is still recent."""
    hit = (
        (F.col("status") == "active")
        & (F.col("service_status") == "passed")
        & (F.col("service_checked_at") >= at(now, recheck_after_minutes))
    )
    return endpoints.agg(F.count_if(hit).alias("fresh"))


def error_breakdown(checks: DataFrame, cycle_id: str | Column | None = None, top: int | None = None) -> DataFrame:
    """Failed checks by code, most first; ``top`` also leaves out unnamed errors."""
    failed = checks.filter(~F.col("reachable"))
    if cycle_id is not None:
        failed = failed.filter(F.col("cycle_id") == cycle_id)
    counts = failed.groupBy(*([] if cycle_id is not None else ["cycle_id"]), "error_code").agg(
        F.count("*").alias("n")
    )
    if top is not None:
        counts = counts.filter("error_code is not null").orderBy(F.col("n").desc(), "error_code").limit(top)
    return counts


def reason_breakdown(service_checks: DataFrame, service: str, limit: int | None = None) -> DataFrame:
    """Reasons of the misses in the latest cycle of a service, most first, all or as many as asked for."""
    own = service_checks.filter(F.col("service") == service)
    latest = own.agg(F.max_by("cycle_id", F.struct("created_at", "id")).alias("cycle_id")).scalar()
    counts = (
        own.filter((F.col("cycle_id") == latest) & ~F.col("passed"))
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.col("reason").asc_nulls_first())
    )
    return counts if limit is None else counts.limit(limit)


def validation_tally(plan: DataFrame) -> DataFrame:
    """checked, passed, failed, added, retained and quarantined of a validation plan."""
    status, before, passed = F.col("status"), F.col("status_before"), F.col("reachable")
    return plan.agg(
        F.count("*").alias("checked"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
        F.count_if(passed & (status == "active") & (before != "active")).alias("added"),
        F.count_if((status == "active") & (before == "active")).alias("retained"),
        F.count_if(status == "quarantined").alias("quarantined"),
    )


def service_tally(results: DataFrame) -> DataFrame:
    """checked, passed, blocked, failed and skipped; anything unknown is skipped."""
    named = ("passed", "blocked", "failed")
    return results.agg(
        F.count("*").alias("checked"),
        *[F.count_if(F.col("status") == name).alias(name) for name in named],
        F.count_if(~F.col("status").isin(*named)).alias("skipped"),
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    """Rows per table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
