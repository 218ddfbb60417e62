"""Result documents: metric rows, API envelopes, summaries."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import at, clamp, iso_text, lookup, safe_message, squeeze_ends
from ..operators import history, stats
from ..schemas import PROTOCOLS, PUBLIC_COLUMNS

# Error codes of the API and their HTTP status.
ERROR_STATUS = {
    "bad_request": 400,
    "unauthorized": 401,
    "forbidden": 403,
    "not_found": 404,
    "method_not_allowed": 405,
    "conflict": 409,
    "payload_too_large": 413,
    "rate_limited": 429,
    "timeout": 504,
    "unavailable": 503,
    "upstream_error": 502,
    "internal_error": 500,
}


def pool_metrics(stats_row: DataFrame, cycles: DataFrame, service: str) -> DataFrame:
    """(metric, labels, value): one row per metric and label, absent numbers are 0."""

    def metric(name: str, value: Column, **labels: str) -> Column:
        tags = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map()
        return F.struct(
            F.lit(name).alias("metric"),
            tags.cast("map<string,string>").alias("labels"),
            F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"),
        )

    done = lambda status: cycles.agg(F.count_if(F.col("status") == status).alias("n")).scalar()
    wide = stats_row.withColumns({"_completed": done("completed"), "_failed": done("failed")})
    rows = [
        metric("up", F.lit(1)),
        metric("pool_size", F.col("pool_size")),
        *[metric("proxies", F.col(s), status=s) for s in ("active", "quarantined", "dead", "pending")],
        metric("service_passed", F.col("service_passed"), service=service),
        metric("avg_latency_ms", F.col("avg_latency_ms")),
        metric("cycles_total", F.col("_completed"), result="completed"),
        metric("cycles_total", F.col("_failed"), result="failed"),
    ]
    return wide.select(F.inline(F.array(*rows)))


def _meta(request_id: str, now: datetime | str, **more: Column) -> Column:
    return F.struct(
        F.lit(request_id).alias("request_id"),
        iso_text(at(now)).alias("timestamp"),
        *[value.alias(name) for name, value in more.items()],
    )


def envelope(page: DataFrame, service: str, request_id: str, now: datetime | str) -> DataFrame:
    """One row with the JSON document of a pool page (:func:`..operators.pool.read_pool`).

    Only a page is gathered, never the pool; ``last_update`` is the first row's last pass.
    """
    shown = [
        iso_text(F.col("last_passed")).alias("last_passed") if name == "last_passed" else F.col(name)
        for name in PUBLIC_COLUMNS
    ]
    keyed = page.select(F.struct(*shown).alias("row"), "pool_size", *[F.col(n) for n in ("score", "latency_ms", "id")])
    order = F.struct(-F.col("score"), F.col("latency_ms").isNull(), "latency_ms", "id")
    listed = keyed.agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "row"))), lambda x: x["row"]).alias("rows"),
        F.coalesce(F.max("pool_size"), F.lit(0)).alias("total"),
    )
    document = F.struct(
        F.lit(True).alias("ok"),
        F.struct(
            F.lit(service).alias("service"),
            F.col("total").alias("pool_size"),
            F.size("rows").alias("count"),
            F.col("rows").alias("proxies"),
        ).alias("data"),
        _meta(
            request_id,
            now,
            pool_size=F.col("total"),
            last_update=F.get("rows", F.lit(0))["last_passed"],
            service=F.lit(service),
        ).alias("meta"),
    )
    return listed.select(F.lit(200).alias("status"), F.to_json(document).alias("body"))


def error_envelopes(errors: DataFrame, request_id: str, now: datetime | str) -> DataFrame:
    """Add ``status`` and ``body`` to rows of (code, message)."""
    document = F.struct(
        F.lit(False).alias("ok"),
        F.struct(F.col("code"), safe_message(F.col("message")).alias("message")).alias("error"),
        _meta(request_id, now).alias("meta"),
    )
    return errors.withColumns(
        {
            "status": F.coalesce(lookup(ERROR_STATUS, F.col("code")), F.lit(500)),
            "body": F.to_json(document),
        }
    )


def pool_requests(
    requests: DataFrame, params: str = "params", max_offset: int | None = 100_000, max_latency_ms: int | None = 600_000
) -> DataFrame:
    """Read pool queries from a log: (limit, offset, ..., service, warnings, error).

    ``max_offset`` and ``max_latency_ms`` are the largest values a request may ask for, larger ones are
    clamped to them without a warning; None: as large as it says.

    ``params`` is a string map. Numbers that are no integers fall back; the first wrong
    enumeration is the error and resets the filters.
    """

    def get(name: str) -> Column:
        return F.try_element_at(F.col(params), F.lit(name))

    def whole(name: str, fallback: int, low: int, high: int) -> Column:
        number = F.when(get(name).rlike(r"\S"), squeeze_ends(get(name)).try_cast("double"))
        sound = number.isNotNull() & ~F.isnan(number) & (number == F.floor(number))
        return F.when(sound, clamp(number, low, high)).otherwise(fallback).cast("int")

    wanted = whole("limit", 50, 1, 5000)
    cut = get("limit").isNotNull() & (wanted > 500)
    protocol, country = get("protocol"), get("country")
    service = F.coalesce(get("service"), F.lit("required"))
    error = (
        F.when(
            ~protocol.isin(*PROTOCOLS),
            F.concat(F.lit('invalid protocol "'), protocol, F.lit('" (expected http, https, socks4 or socks5)')),
        )
        .when((country != "") & ~country.rlike("^[A-Za-z]{2}$"), "invalid country (expected a two letter ISO code)")
        .when(
            ~service.isin("required", "preferred", "off"),
            "invalid service filter (expected required, preferred or off)",
        )
    )
    good = F.col("error").isNull()
    return requests.withColumn("error", error).select(
        *requests.columns,
        F.when(cut, 500).otherwise(wanted).alias("limit"),
        F.when(good, whole("offset", 0, 0, MOST if max_offset is None else max_offset)).otherwise(0).alias("offset"),
        F.when(good, protocol).alias("protocol"),
        F.when(good, whole("min_score", 0, 0, 100)).otherwise(0).alias("min_score"),
        F.when(good & (get("max_latency_ms") != ""), whole("max_latency_ms", 0, 0, MOST if max_latency_ms is None else max_latency_ms)).alias("max_latency_ms"),
        F.when(good & (country != ""), F.upper(country)).alias("country"),
        F.when(good, service).otherwise("required").alias("service"),
        F.when(cut, F.array(F.lit("limit clamped to 500"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        "error",
    )


#: The largest value of an integer column.
MOST = (1 << 31) - 1
CYCLE_FIELDS = [
    "cycle_id",
    "status",
    "started_at",
    "finished_at",
    "duration_ms",
    "candidates_discovered",
    "candidates_checked",
    "candidates_passed",
    "candidates_failed",
    "service_checked",
    "service_passed",
    "pool_size",
]


def tpool_summary(
    endpoints: DataFrame,
    cycles: DataFrame,
    service: str,
    now: datetime | str,
    planned: datetime | str | None = None,
    ttl_minutes: int = 90,
    interval_minutes: int = 15,
) -> DataFrame:
    """One row: valid endpoints, last and next check, the latest completed cycle or NULLs."""
    due = history.next_check(cycles, planned, now, interval_minutes)
    valid = stats.currently_valid(endpoints, now, ttl_minutes).scalar()
    have = [name for name in CYCLE_FIELDS if name in cycles.columns]
    latest = history.latest_completed(cycles).select(F.struct(*have).alias("cycle")).scalar()
    return due.select(F.lit(service).alias("service"), valid.alias("valid"), "last_check", "next_check").withColumn(
        "cycle", latest
    )


def stats_document(
    endpoints: DataFrame,
    cycles: DataFrame,
    checks: DataFrame,
    service_checks: DataFrame,
    service: str,
    now: datetime | str,
    settings: Mapping[str, object],
    with_errors: bool = True,
    ttl_minutes: int = 90,
    require_service_pass: bool = True,
    most_errors: int | None = 8,
    most_reasons: int | None = 5,
) -> DataFrame:
    """One row: the pool statistics, settings, last cycle and its breakdowns.

    The breakdowns list the most frequent error codes and reasons, all of them with None.
    """
    base = stats.pool_stats(endpoints, now, ttl_minutes, require_service_pass)
    last = history.latest_completed(cycles)
    out = base.withColumns(
        {
            "service": F.lit(service),
            **{f"setting_{name}": F.lit(value) for name, value in settings.items()},
            "last_cycle": last.select(F.struct(*cycles.columns).alias("c")).scalar(),
        }
    )
    if with_errors:
        cycle = last.select("cycle_id").scalar()
        errors = stats.error_breakdown(checks, cycle, most_errors)
        reasons = stats.reason_breakdown(service_checks, service, most_reasons)
        gather = lambda df, name: df.agg(
            F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(name).alias("code"), "n"))).alias("x")
        ).select(F.transform("x", lambda v: F.struct(v["code"].alias("code"), v["n"].alias("count"))).alias("x"))
        out = out.withColumns(
            {
                "last_cycle_errors": gather(errors, "error_code").scalar(),
                "last_cycle_service_reasons": gather(reasons, "reason").scalar(),
            }
        )
    return out
