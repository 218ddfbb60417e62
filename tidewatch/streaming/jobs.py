"""Micro-batch sinks: job retries, endpoint counters and whole refresh cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import CycleConfig
from ..plans.cycle import CycleInputs
from ..plans.refresh import refresh
from ..session import cut_lineage, scratch
from ..sources.jobs import parse_jobs, split_jobs
from ..sources.tables import Tables
from .state import EndpointStates


def retry_failed(failed: DataFrame, max_attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """Failed jobs to send again with the next attempt number, and jobs to give up."""
    again = F.col("attempt") < max_attempts
    return failed.filter(again).withColumn("attempt", F.col("attempt") + 1), failed.filter(~again)


def once(parsed: DataFrame, sent_at: str, late: str = "10 minutes") -> DataFrame:
    """Parsed messages without those that came before, of a stream or a table.

    A message is its job and attempt, or its body if it names no job; a job sent again after a failure is a
    new attempt and stays. A stream remembers messages for ``late`` behind the newest ``sent_at``, so what it
    keeps is bounded; an instant that cannot be read counts as the oldest.
    """
    name = F.concat_ws("#", "job_id", F.col("attempt").cast("string"))
    named = parsed.withColumn("_name", F.when(F.col("fault").isNull(), name).otherwise(F.sha2("body", 256)))
    if not parsed.isStreaming:
        return named.dropDuplicates(["_name"]).drop("_name")
    timed = named.withColumn("_sent", F.coalesce(F.col(sent_at).cast("timestamp"), F.lit("1970-01-01").cast("timestamp")))
    return timed.withWatermark("_sent", late).dropDuplicatesWithinWatermark(["_name"]).drop("_name", "_sent")


def run_jobs(
    messages: DataFrame,
    handle: Callable[[DataFrame], DataFrame],
    root: str,
    max_attempts: int = 2,
    sent_at: str | None = None,
    late: str = "10 minutes",
) -> StreamingQuery:
    """Work through a stream of job messages.

    ``handle`` maps a batch of jobs to the same rows with a boolean ``ok``. Rejected messages
    go to ``rejected``, failed jobs to ``retry`` (which the caller may feed back in) or, out
    of attempts, to ``dropped``. Each batch overwrites its own folders, so a batch that runs
    again after a lost executor leaves the same rows. With ``sent_at``, the column of a message's instant,
    a message that is delivered twice within ``late`` is worked on once (:func:`once`). ``counts`` has a
    row per batch: how many messages were done, sent again, given up and rejected.
    """

    def work(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            sort_out(batch, number)

    def sort_out(batch: DataFrame, number: int) -> None:
        # Handled and written once, read for each outcome.
        jobs, rejected = split_jobs(batch)
        done = cut_lineage(handle(jobs))
        again, dropped = retry_failed(done.filter("not ok"), max_attempts)
        parts = {"rejected": rejected, "done": done.filter("ok"), "retry": again, "dropped": dropped}
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        spark = batch.sparkSession
        sizes = {name: spark.read.parquet(f"{root}/{name}/batch={number}").count() for name in parts}
        row = spark.createDataFrame([tuple(sizes.values())], ", ".join(f"{name} long" for name in sizes))
        row.coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/batch={number}")

    parsed = parse_jobs(messages)
    return (
        (parsed if sent_at is None else once(parsed, sent_at, late))
        .writeStream.foreachBatch(work)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def fold_checks(checks: DataFrame, root: str, buckets: int = 64, late: str | None = None) -> StreamingQuery:
    """Keep the endpoint counters of a check stream; :class:`.state.EndpointStates` reads them.

    Checks may come late and micro-batches in any order.
    """
    states = EndpointStates(checks.sparkSession, f"{root}/state", buckets, late)
    return (
        checks.writeStream.foreachBatch(lambda batch, number: states.fold(batch, number))
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def refresh_stream(
    lines: DataFrame,
    sources: DataFrame,
    recorded: Callable[[SparkSession], tuple[DataFrame, DataFrame]],
    tables: Tables,
    clock: Callable[[int], str],
    cfg: CycleConfig = CycleConfig(),
    every: str | None = None,
) -> StreamingQuery:
    """A refresh cycle per micro-batch of raw lines.

    ``recorded`` gives the outcomes and probes of the moment, ``clock`` the instant of a
    batch. ``every`` is the cadence; without it the query works off what is there. A batch starts, commits
    or fails its cycle as :func:`..plans.refresh.refresh` does: one that is committed is not run again, one
    that died runs again from the commit it started from. Folders no recent commit names are removed.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        def inputs() -> CycleInputs:
            outcomes, probes = recorded(batch.sparkSession)
            return CycleInputs(batch, sources, outcomes, probes)

        refresh(tables, inputs, f"cyc_{number:08d}", clock(number), cfg)
        tables.ledger.vacuum()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        lines.writeStream.foreachBatch(cycle)
        .option("checkpointLocation", f"{tables.root}/_checkpoint")
        .trigger(**trigger)
        .start()
    )
