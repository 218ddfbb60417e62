"""Ordered decisions over request logs: rate windows, spacing, deciding attempts, retries."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probe import TRANSIENT, backoff_ms
from ..functions.text import epoch_ms
from .running import BLOCK, cut_by_rows, running, running_by_rows


def rate_limit(
    requests: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    most: int = 120,
    window_seconds: int = 60,
) -> DataFrame:
    """Fixed-window decision per request: the n-th of its key and window passes iff n <= most.

    Adds ``window_no, nth, allowed, remaining, reset_seconds, retry_after_seconds``. A busy
    client's window is cut by rows, so no task numbers more than one range of them.
    """
    second = F.floor(epoch_ms(F.col(ts)) / 1000)
    numbered = running_by_rows(
        requests.withColumn("window_no", F.floor(second / window_seconds)),
        [*keys, "window_no"],
        [ts, *order],
        {"nth": ("sum", F.lit(1))},
    )
    allowed = F.col("nth") <= most
    reset = F.lit(window_seconds) - second % window_seconds
    return numbered.withColumns(
        {
            "allowed": allowed,
            "remaining": F.greatest(F.lit(most) - F.col("nth"), F.lit(0)),
            "reset_seconds": reset,
            "retry_after_seconds": F.when(allowed, 0).otherwise(reset),
        }
    )


def crawl_spacing(
    requests: DataFrame, key: str, at_ms: str, order: Sequence[str], delay_ms: str
) -> DataFrame:
    """Add ``slot_ms``, the time each request may go: max(own time, previous slot + delay).

    With i the position in the key, slot(i) = i*d + max over j<=i of (t(j) - j*d), so the
    recurrence is a running count and a running maximum over blocks of rows. ``delay_ms`` is a
    column that is constant per key; without a delay a request goes at once.
    """
    spots = [at_ms, *order]
    cut = cut_by_rows(requests, [key], spots)
    numbered = running(cut, [key], spots, F.col(BLOCK), {"_nth": ("sum", F.lit(1))})
    shifted = F.col(at_ms) - F.col("_nth") * F.col(delay_ms)
    spaced = running(numbered, [key], spots, F.col(BLOCK), {"_lead": ("max", shifted)})
    slot = F.when(F.col(delay_ms) > 0, F.col("_lead") + F.col("_nth") * F.col(delay_ms)).otherwise(F.col(at_ms))
    return spaced.withColumn("slot_ms", slot).drop("_nth", "_lead", BLOCK)


def collapse_attempts(
    attempts: DataFrame, keys: Sequence[str], max_attempts: int = 2, carry: Sequence[str] = ("status", "latency_ms")
) -> DataFrame:
    """The attempt that decides each check, and how many were made.

    Attempts go on after a transient error only and up to ``max_attempts``, so the deciding
    one is the first final attempt or the one at the limit: two grouped minimums.
    """
    tried = attempts.filter(F.col("attempt") <= max_attempts)
    final = ~F.coalesce(F.col("error_code").isin(*TRANSIENT), F.lit(False))
    row = F.struct("attempt", "error_code", *carry)
    return (
        tried.groupBy(*keys)
        .agg(F.min(F.when(final, row)).alias("_final"), F.max(row).alias("_last"))
        .withColumn("_row", F.coalesce("_final", "_last"))
        .select(
            *keys,
            F.col("_row.attempt").alias("attempts"),
            F.col("_row.error_code").alias("error_code"),
            *[F.col(f"_row.{name}").alias(name) for name in carry],
        )
    )


def retry_plan(
    failures: DataFrame, max_attempts: int, u: Column, base_ms: float = 400.0, most_ms: float = 4000.0, jitter: float = 0.35
) -> DataFrame:
    """Add ``action`` (retry or drop), ``next_attempt`` and ``delay_ms`` to failed jobs."""
    again = F.col("attempt") < max_attempts
    return failures.withColumns(
        {
            "action": F.when(again, "retry").otherwise("drop"),
            "next_attempt": F.when(again, F.col("attempt") + 1),
            "delay_ms": F.when(again, backoff_ms(F.col("attempt"), base_ms, u, 2.0, most_ms, jitter)),
        }
    )


# Endpoint state from the check log -------------------------------------------


def place_of(created_at: Column, check_id: Column) -> Column:
    """The place of a check in time: its instant, checks of one instant by their id (0 or more).

    One number, so that the latest place is a plain maximum that hash aggregation keeps in place.
    """
    micros = F.unix_micros(created_at.cast("timestamp")).cast("decimal(18,0)")
    return (micros * F.lit(Decimal(10**19)) + check_id.cast("decimal(19,0)")).cast("decimal(38,0)")


def endpoint_totals(checks: DataFrame) -> DataFrame:
    """Per endpoint: checks, passes, last check, last pass and its place; combined before the shuffle."""
    passed = F.col("reachable")
    return checks.groupBy("proxy_id").agg(
        F.count(F.lit(1)).alias("check_count"),
        F.count_if(passed).alias("pass_count"),
        F.max("created_at").alias("last_checked_at"),
        F.max(F.when(passed, F.col("created_at"))).alias("last_passed_at"),
        F.max(F.when(passed, place_of(F.col("created_at"), F.col("id")))).alias("last_pass"),
    )


def endpoint_state(checks: DataFrame) -> DataFrame:
    """Fold the check log: checks, passes, trailing failures, last check and last pass.

    Counts and the place of the last pass are one grouped aggregate, which combines before the shuffle.
    The failed checks alone then meet that one row per endpoint, with their place as their only other
    column, to count those behind the last pass; a hot endpoint's share of them is split by AQE.
    """
    totals = endpoint_totals(checks)
    missed = checks.filter(~F.col("reachable")).select(
        F.col("proxy_id").alias("own"), place_of(F.col("created_at"), F.col("id")).alias("place")
    )
    last = totals.select("proxy_id", "last_pass")
    behind = F.col("last_pass").isNull() | (F.col("place") > F.col("last_pass"))
    tail = (
        missed.join(last, (F.col("own") == F.col("proxy_id")) & behind)
        .groupBy("proxy_id")
        .agg(F.count(F.lit(1)).alias("tail"))
    )
    return totals.join(tail, "proxy_id", "left").select(
        "proxy_id",
        "check_count",
        "pass_count",
        F.coalesce("tail", F.lit(0)).alias("consecutive_failures"),
        "last_checked_at",
        "last_passed_at",
    )
