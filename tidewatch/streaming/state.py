"""Stateful streams: endpoint counters and request counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.admission import endpoint_totals, place_of
from ..session import cut_lineage, scratch
from ..sources.ledger import Ledger, Manifest


def request_counts(
    requests: DataFrame, keys: list[str], ts: str, most: int = 120, window_seconds: int = 60, late: str = "2 minutes"
) -> DataFrame:
    """Requests per client and window with how many of them the limit let through.

    A plain windowed count: partial counts are merged before the shuffle, so a busy client
    costs one row per task and window.
    """
    window = F.window(F.col(ts).cast("timestamp"), f"{window_seconds} seconds")
    return (
        requests.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(*keys, window.alias("window"))
        .agg(F.count("*").alias("requests"))
        .select(
            *keys,
            F.floor(F.col("window.start").cast("bigint") / window_seconds).alias("window_no"),
            "requests",
            F.least(F.col("requests"), F.lit(most)).alias("allowed"),
            F.greatest(F.col("requests") - most, F.lit(0)).alias("refused"),
        )
    )


COUNTERS = ["check_count", "pass_count", "consecutive_failures", "last_checked_at", "last_passed_at"]
#: One row per endpoint; ``settled`` counts trailing failures older than the lateness, whose places are gone.
SUMMARY = (
    "proxy_id BIGINT, check_count BIGINT, pass_count BIGINT, last_checked_at TIMESTAMP_NTZ, last_passed_at TIMESTAMP_NTZ, "
    "last_pass DECIMAL(38,0), settled BIGINT"
)
#: The places of trailing failures that a late pass may still clear.
FAILURES = "proxy_id BIGINT, created_at TIMESTAMP_NTZ, place DECIMAL(38,0)"


def merge_summaries(
    summary: DataFrame, failures: DataFrame, batch: DataFrame, horizon: Column | None = None, settled_to: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fold a batch of checks of any age into (summary, failures).

    Counts add up and places take their maximum, so batches may come in any order: a pass clears the
    failures in front of its place and leaves those behind it, whenever it arrives. Failures before
    ``horizon`` are settled into a count, which bounds what is kept; ``settled_to`` is the horizon of the
    batch before, and a pass that is older than that clears none of what was settled.
    """
    news = endpoint_totals(batch).withColumn("settled", F.lit(0).cast("bigint"))
    columns = ["proxy_id", "check_count", "pass_count", "last_checked_at", "last_passed_at", "last_pass", "settled"]
    both = summary.select(*columns, F.col("last_pass").alias("before")).unionByName(
        news.select(*columns, F.lit(None).cast("decimal(38,0)").alias("before"))
    )
    merged = both.groupBy("proxy_id").agg(
        *[F.sum(name).alias(name) for name in ("check_count", "pass_count", "settled")],
        *[F.max(name).alias(name) for name in ("last_checked_at", "last_passed_at", "last_pass", "before")],
    )
    # What was settled lies in front of the horizon of its time, so a pass in time clears all of it.
    cleared = F.col("last_pass") > F.coalesce("before", F.lit(-1))
    if settled_to is not None:
        cleared = cleared & (F.col("last_pass") >= place_of(settled_to, F.lit(0)))
    merged = merged.withColumn("settled", F.when(cleared, 0).otherwise(F.coalesce("settled", F.lit(0))).cast("bigint")).drop("before")
    merged = cut_lineage(merged)
    missed = batch.filter(~F.col("reachable")).select(
        "proxy_id", F.col("created_at"), place_of(F.col("created_at"), F.col("id")).alias("place")
    )
    last = merged.select(F.col("proxy_id").alias("own"), "last_pass")
    trailing = F.col("last_pass").isNull() | (F.col("place") > F.col("last_pass"))
    open_ = (
        failures.select("proxy_id", "created_at", "place")
        .unionByName(missed)
        .join(last, (F.col("proxy_id") == F.col("own")) & trailing)
        .select("proxy_id", "created_at", "place")
    )
    if horizon is None:
        return merged, open_
    open_ = cut_lineage(open_)
    old = open_.filter(F.col("created_at") < horizon).groupBy("proxy_id").agg(F.count(F.lit(1)).alias("more"))
    merged = merged.join(old, "proxy_id", "left").withColumn("settled", F.col("settled") + F.coalesce("more", F.lit(0))).drop("more")
    return merged, open_.filter(F.col("created_at") >= horizon)


def counters(summary: DataFrame, failures: DataFrame) -> DataFrame:
    """The endpoint counters as :func:`..operators.admission.endpoint_state` gives them."""
    tail = failures.groupBy("proxy_id").agg(F.count(F.lit(1)).alias("tail"))
    failed = (F.col("settled") + F.coalesce("tail", F.lit(0))).alias("consecutive_failures")
    return summary.join(tail, "proxy_id", "left").select(
        "proxy_id", "check_count", "pass_count", failed, "last_checked_at", "last_passed_at"
    )


class EndpointStates:
    """Endpoint counters of a check stream, committed per micro-batch.

    The state lies in buckets of endpoints. A batch reads and writes the buckets it hits and commits them
    with its number, so one that runs again after a commit changes nothing. ``late`` is how far behind the
    newest check a pass may arrive and still clear exactly the failures in front of it; None: however far.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, late: str | None = None) -> None:
        self.spark, self.root, self.late = spark, root.rstrip("/"), late
        self.ledger = Ledger(spark, root)
        self.buckets = int(self.ledger.latest().value("buckets") or buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("proxy_id"), F.lit(self.buckets)).cast("int")

    def read(self, name: str, base: Manifest | None = None, hit: list[int] | None = None) -> DataFrame:
        base, schema = base or self.ledger.latest(), SUMMARY if name == "summary" else FAILURES
        folders = [f for b, f in base.parts(name).items() if hit is None or int(b) in hit]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def write(self, name: str, rows: DataFrame, number: int, hit: list[int]) -> dict[str, str | None]:
        folder = f"{name}/v={number:08d}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        rows.withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        have = (n.removeprefix("bucket=") for n in self.ledger.names(folder) if n.startswith("bucket="))
        return {**{str(b): None for b in hit}, **{b: f"{folder}/bucket={b}" for b in have}}

    def horizon(self, newest: str | None) -> Column | None:
        """The instant before which failures are settled."""
        if self.late is None or newest is None:
            return None
        return F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.late}")

    def fold(self, batch: DataFrame, number: int) -> None:
        """Fold micro-batch ``number``."""
        with scratch(self.spark):
            self._fold(batch, number)

    def _fold(self, batch: DataFrame, number: int) -> None:
        base = self.ledger.latest()
        if int(base.value("batch") or -1) >= number:
            return
        batch = cut_lineage(batch.select("id", "proxy_id", "created_at", "reachable"))
        # As many rows as there are buckets at most.
        hit = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())
        values = {"batch": str(number), "buckets": str(self.buckets)}
        tables = {}
        if hit:
            newest = batch.agg(F.max("created_at").cast("string")).first()[0]
            values["newest"] = max(x for x in (newest, base.value("newest")) if x)
            summary, failures = merge_summaries(
                self.read("summary", base, hit),
                self.read("failures", base, hit),
                batch,
                self.horizon(values["newest"]),
                self.horizon(base.value("newest")),
            )
            tables = {
                "summary": self.write("summary", summary, base.number + 1, hit),
                "failures": self.write("failures", failures, base.number + 1, hit),
            }
        self.ledger.commit(base, f"batch {number}", datetime(1970, 1, 1), tables, values)
        self.ledger.vacuum()

    def rows(self) -> DataFrame:
        """The counters of every endpoint."""
        base = self.ledger.latest()
        return counters(self.read("summary", base), self.read("failures", base))
