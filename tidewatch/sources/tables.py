"""The engine's tables on a shared folder: bucketed endpoints, facts by day, cycle rows and key/value rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHECKS, CYCLES, ENDPOINTS, META, SERVICE_CHECKS, conform
from .ledger import Ledger, Manifest

FACTS = {"checks": CHECKS, "service_checks": SERVICE_CHECKS}
SNAPSHOTS = {"endpoints": ENDPOINTS, "cycles": CYCLES}
#: Ids of endpoints that retention has dropped; facts written up to their day leave them out.
BURIED = "proxy_id bigint"
BUCKETS = 64


class Tables:
    """Parquet tables under one root, whose state is the newest commit of a :class:`.ledger.Ledger`.

    Endpoints lie in buckets by the hash of their key, and a commit names a folder per bucket, so a change
    writes the buckets it hits. Facts lie by batch and day; a batch that is written again takes the place of
    its own rows, so a retried micro-batch adds nothing twice. ``write_*`` only write folders and return the
    parts a commit is to name; the other methods also commit.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.ledger = Ledger(spark, root)
        self.buckets = int(self.ledger.latest().value("buckets") or buckets)

    def bucket(self, key: Column | str = "dedupe_key") -> Column:
        """The bucket of an endpoint key."""
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # Writing folders.

    def _folder(self, prefix: str, number: int) -> str:
        # No attempt writes where another one has written.
        return f"{prefix}={number:08d}-{uuid.uuid4().hex[:12]}"

    def write_endpoints(self, rows: DataFrame, number: int, hit: Iterable[int] | None = None) -> dict[str, str | None]:
        """Write endpoints by bucket. ``hit`` names the buckets that ``rows`` is all of; None: every bucket."""
        folder = f"endpoints/{self._folder('v', number)}"
        placed = conform(rows, ENDPOINTS).withColumn("bucket", self.bucket())
        # One file per bucket, however many tasks hold its rows.
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        parts: dict[str, str | None] = {str(b): None for b in (range(self.buckets) if hit is None else hit)}
        written = (n.removeprefix("bucket=") for n in self.ledger.names(folder) if n.startswith("bucket="))
        return {**parts, **{b: f"{folder}/bucket={b}" for b in written}}

    def write_cycles(self, rows: DataFrame, number: int) -> dict[str, str | None]:
        """Write all cycle rows."""
        folder = f"cycles/{self._folder('v', number)}"
        conform(rows, CYCLES).coalesce(1).write.parquet(f"{self.root}/{folder}")
        return {"all": folder}

    def write_facts(self, name: str, rows: DataFrame, batch: str, number: int, base: Manifest) -> dict[str, str | None]:
        """Write a batch of facts by day, in place of what the batch wrote before."""
        folder = f"{name}/{self._folder('batch', number)}"
        dated = conform(rows, FACTS[name]).withColumn("dt", F.to_date("created_at"))
        dated.write.partitionBy("dt").parquet(f"{self.root}/{folder}")
        earlier: dict[str, str | None] = {p: None for p in base.parts(name) if p.partition("/")[2] == batch}
        days = (n.removeprefix("dt=") for n in self.ledger.names(folder) if n.startswith("dt="))
        return {**earlier, **{f"{day}/{batch}": f"{folder}/dt={day}" for day in days}}

    def write_buried(self, ids: DataFrame, day: str, number: int, base: Manifest) -> dict[str, str | None]:
        """Write the ids (proxy_id) of endpoints dropped on a day, with those of the day already there."""
        folder = f"buried/{self._folder('v', number)}/day={day}"
        have = base.parts("buried").get(day)
        listed = ids if have is None else ids.unionByName(self.spark.read.schema(BURIED).parquet(f"{self.root}/{have}"))
        listed.distinct().write.parquet(f"{self.root}/{folder}")
        return {day: folder}

    # Facts.

    def append(self, name: str, rows: DataFrame, batch: str) -> None:
        """Write one batch of facts; the same batch id replaces what it wrote before."""
        base = self.ledger.latest()
        parts = self.write_facts(name, rows, batch, base.number + 1, base)
        self.ledger.update(f"append {name} {batch}", datetime(1970, 1, 1), {name: parts})

    def facts(self, name: str, base: Manifest | None = None) -> DataFrame:
        """All batches of a fact table without the rows of buried endpoints; ``dt`` prunes partitions."""
        base = base or self.ledger.latest()
        schema = FACTS[name]
        parts = base.parts(name)
        if not parts:
            return self.spark.createDataFrame([], schema).select("*", F.lit(None).cast("date").alias("dt"))
        rows = (
            self.spark.read.option("basePath", f"{self.root}/{name}")
            .schema(schema)
            .parquet(*(f"{self.root}/{folder}" for folder in parts.values()))
            .select(*schema.names, F.col("dt").cast("date").alias("dt"))
        )
        graves = base.parts("buried").values()
        if graves:
            gone = self.spark.read.option("basePath", f"{self.root}/buried").schema(BURIED)
            lists = gone.parquet(*(f"{self.root}/{folder}" for folder in graves))
            last = lists.groupBy(F.col("proxy_id").alias("_gone")).agg(F.max(F.col("day").cast("date")).alias("_day"))
            rows = rows.join(last, (F.col("proxy_id") == F.col("_gone")) & (F.col("dt") <= F.col("_day")), "left_anti")
        return rows

    # Snapshots.

    def commit(self, name: str, rows: DataFrame, version: str, now: datetime | str) -> None:
        """Write a whole new version and commit it."""
        number = self.ledger.latest().number + 1
        parts = self.write_endpoints(rows, number) if name == "endpoints" else self.write_cycles(rows, number)
        self.ledger.update(f"commit {name} {version}", now, {name: parts}, {f"version.{name}": version, "buckets": str(self.buckets)})

    def committed(self, name: str) -> str | None:
        """The version committed last."""
        return self.ledger.latest().value(f"version.{name}")

    def snapshot(self, name: str, base: Manifest | None = None, hit: Iterable[int] | None = None) -> DataFrame:
        """The rows of the newest commit, an empty table before the first; ``hit`` reads some buckets only."""
        base = base or self.ledger.latest()
        schema = SNAPSHOTS[name]
        wanted = None if hit is None else {str(b) for b in hit}
        folders = [f for p, f in base.parts(name).items() if wanted is None or p in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)).select(*schema.names)

    # Key/value rows.

    def put_meta(self, key: str, value: str | None, now: datetime | str) -> None:
        """Set a value, or remove it when ``value`` is None."""
        self.ledger.update(f"meta {key}", now, values={key: value})

    def meta(self) -> DataFrame:
        """The key/value rows of the newest commit."""
        values = self.ledger.latest().values
        rows = [(key, value, moment) for key, (value, moment) in sorted(values.items())]
        frame = self.spark.createDataFrame(rows, "key string, value string, updated_at string")
        return conform(frame.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")), META)

    def get_meta(self, key: str) -> str | None:
        return self.ledger.latest().value(key)
