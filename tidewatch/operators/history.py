"""Cycle rows, result history, key/value rows and retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RetentionConfig
from ..functions.text import at, instant
from ..schemas import CYCLES, META, conform

# Fixed value: the error of a cycle that never came to its end.
ABANDONED = "abandoned: worker restarted mid-cycle"


# Cycles -----------------------------------------------------------------------


def latest_completed(cycles: DataFrame) -> DataFrame:
    """The completed cycle that finished last (one row, or none)."""
    return (
        cycles.filter("status = 'completed'")
        .orderBy(F.col("finished_at").desc_nulls_last(), F.col("cycle_id").desc())
        .limit(1)
    )


def current_cycle(cycles: DataFrame) -> DataFrame:
    return cycles.filter("status = 'running'").orderBy(F.col("started_at").desc()).limit(1)


def list_cycles(cycles: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest cycles by start, all of them or as many as asked for."""
    ordered = cycles.orderBy(F.col("started_at").desc(), F.col("cycle_id").desc())
    return ordered if limit is None else ordered.limit(limit)


def latest_versions(rows: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """Newest row per key of an appended table, as a grouped maximum."""
    rest = [name for name in rows.columns if name != key]
    newest = F.max_by(F.struct(*rest), F.struct(*version))
    return rows.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def start_cycle(cycles: DataFrame, cycle_id: str, now: datetime | str) -> DataFrame:
    """Insert a running cycle, or restart the one with the same id."""
    known = F.col("cycle_id") == cycle_id
    kept = conform(cycles, CYCLES).withColumns(
        {
            "status": F.when(known, "running").otherwise(F.col("status")),
            "started_at": F.when(known, at(now)).otherwise(F.col("started_at")),
            "error": F.when(~known, F.col("error")),
        }
    )
    found = kept.agg(F.count_if(known).alias("n")).scalar()
    row = cycles.sparkSession.range(1).filter(found == 0).select(
        F.lit(cycle_id).alias("cycle_id"), F.lit("running").alias("status"), at(now).alias("started_at")
    )
    return kept.unionByName(conform(row, CYCLES))


def complete_cycle(cycles: DataFrame, cycle_id: str, counters: dict[str, Column | int], now: datetime | str) -> DataFrame:
    """Fill in the counters of a finished cycle."""
    return _close(cycles, F.col("cycle_id") == cycle_id, now, status="completed", error=None, **counters)


def fail_cycle(cycles: DataFrame, cycle_id: str, error: str, now: datetime | str, duration_ms: int | None = None) -> DataFrame:
    return _close(
        cycles, F.col("cycle_id") == cycle_id, now, status="failed", error=error, duration_ms=duration_ms
    )


def recover_abandoned(cycles: DataFrame, now: datetime | str) -> DataFrame:
    """A row still running at a start belongs to a run that died."""
    return _close(cycles, F.col("status") == "running", now, status="failed", error=ABANDONED)


def _close(cycles: DataFrame, hit: Column, now: datetime | str, **values: object) -> DataFrame:
    values = {"finished_at": at(now), **values}
    return conform(cycles, CYCLES).select(
        *[
            F.when(hit, v if isinstance(v := values[f.name], Column) else F.lit(v))
            .otherwise(F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            if f.name in values
            else F.col(f.name)
            for f in CYCLES.fields
        ]
    )


def next_check(
    cycles: DataFrame, planned: datetime | str | None, now: datetime | str, interval_minutes: int = 15
) -> DataFrame:
    """Planned time, else last finish plus the interval, else now plus it; and seconds until then."""
    finish = latest_completed(cycles).select("finished_at").scalar()
    step = F.make_dt_interval(mins=F.lit(interval_minutes))
    due = F.coalesce(*([at(planned)] if planned else []), finish + step, at(now) + step)
    one = cycles.sparkSession.range(1)
    return one.select(finish.alias("last_check"), due.alias("next_check")).withColumn(
        "seconds_until",
        F.greatest(
            F.floor(F.timestamp_diff("MILLISECOND", at(now), F.col("next_check")) / 1000.0 + 0.5), F.lit(0)
        ),
    )


def maintenance_due(last_prune: datetime | str | None, now: datetime | str) -> bool:
    """At most one clean-up a day."""
    return last_prune is None or instant(now) - instant(last_prune) >= timedelta(hours=24)


# Results ----------------------------------------------------------------------


def results_of_cycle(
    results: DataFrame, cycle_id: str, limit: int | None = None, service: str | None = None
) -> DataFrame:
    """Results of a cycle, newest first, all of them or as many as asked for."""
    own = results.filter(F.col("cycle_id") == cycle_id)
    if service is not None:
        own = own.filter(F.col("service") == service)
    ordered = own.orderBy(F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def recent_per_endpoint(checks: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` newest checks per endpoint.

    The rank filter is pushed below the shuffle as a per-task group limit, so a busy
    endpoint sends no more than ``limit`` rows per task.
    """
    order = Window.partitionBy("proxy_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    ranked = checks.withColumn("nth", F.row_number().over(order))
    return ranked.filter(F.col("nth") <= limit)


def latest_result(results: DataFrame, keys: Sequence[str] = ("proxy_id", "service")) -> DataFrame:
    """Newest result per key, as a grouped maximum with map-side combine."""
    rest = [name for name in results.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id"))
    return results.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


# Key/value rows ---------------------------------------------------------------


def meta_latest(meta: DataFrame) -> DataFrame:
    """Current value per key of the appended key/value table; removed keys are gone."""
    rows = conform(meta, META).withColumn("seq", F.coalesce("seq", F.lit(0)))
    newest = latest_versions(rows, "key", ["updated_at", "seq", "value"])
    return newest.filter(~F.coalesce(F.col("deleted"), F.lit(False))).drop("seq")


def meta_json(meta: DataFrame, key: str, path: str, kind: str = "string") -> DataFrame:
    """One field of a JSON value; text that is no JSON reads as NULL."""
    value = F.try_variant_get(F.try_parse_json("value"), path, kind)
    return meta_latest(meta).filter(F.col("key") == key).select(value.alias("value"))


# Retention --------------------------------------------------------------------


def buried(now: datetime | str, dead_days: int) -> Column:
    """A dead endpoint that never passed and has not been seen for so long."""
    unseen = F.coalesce(F.col("last_seen") < at(now, dead_days * 24 * 60), F.lit(False))
    return (F.col("status") == "dead") & unseen & F.col("last_passed_at").isNull()


def old_cycle(now: datetime | str, cycles_days: int) -> Column:
    """A cycle that ended, or else began, so long ago and is not running."""
    ended = F.coalesce("finished_at", "started_at")
    return (F.col("status") != "running") & F.coalesce(ended < at(now, cycles_days * 24 * 60), F.lit(False))


def prune_history(
    endpoints: DataFrame,
    checks: DataFrame,
    service_checks: DataFrame,
    cycles: DataFrame,
    now: datetime | str,
    cfg: RetentionConfig = RetentionConfig(),
) -> dict[str, DataFrame]:
    """The four tables without what retention drops, and ``counts`` of the dropped rows.

    Results are dropped by time, which on date-partitioned tables is a partition filter.
    Dropped endpoints take their results along: the facts are anti-joined to the dropped ids, the
    small side.
    """
    day = 24 * 60
    results_before = at(now, cfg.results_days * day)
    old_result = F.col("created_at") < results_before
    gone_for_good, outdated = buried(now, cfg.dead_days), old_cycle(now, cfg.cycles_days)
    kept = endpoints.filter(~gone_for_good)
    gone = endpoints.filter(gone_for_good).select(F.col("id").alias("proxy_id"))
    n = lambda df, test: df.agg(F.count_if(test).alias("n")).scalar()
    counts = endpoints.sparkSession.range(1).select(
        n(checks, old_result).alias("checks"),
        n(service_checks, old_result).alias("service_checks"),
        n(endpoints, gone_for_good).alias("endpoints"),
        n(cycles, outdated).alias("cycles"),
    )
    return {
        "endpoints": kept,
        "checks": checks.filter(~old_result).join(gone, "proxy_id", "left_anti"),
        "service_checks": service_checks.filter(~old_result).join(gone, "proxy_id", "left_anti"),
        "cycles": cycles.filter(~outdated),
        "counts": counts,
    }
