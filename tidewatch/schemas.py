"""Table schemas and the value sets their columns are limited to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The value sets of the enumerated columns.
PROTOCOLS = ["http", "https", "socks4", "socks5"]
STATUSES = ["new", "pending", "active", "quarantined", "dead"]
VALIDATION_STATUSES = ["unchecked", "passed", "failed"]
SERVICE_STATUSES = ["untested", "passed", "failed", "blocked", "skipped"]
ANONYMITY_LEVELS = ["elite", "anonymous", "transparent", "unknown"]
JOB_TYPES = ["DISCOVER", "VALIDATE", "SERVICE_CHECK", "RECHECK", "POOL_UPDATE", "STATS_UPDATE"]
JOB_REASONS = ["new", "recheck", "revive", "manual", "stale_service"]


_KINDS = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "TAGS": T.MapType(T.StringType(), T.StringType()),
}


def _table(text: str) -> T.StructType:
    """A schema from ``name KIND, ...``; unlike DDL it needs no running session."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


ENDPOINTS = _table(
    """id BIGINT, dedupe_key STRING, host STRING, port INT, protocol STRING, username STRING,
    password STRING, source STRING, status STRING, validation_status STRING, service_status STRING,
    score DOUBLE, latency_ms BIGINT, service_latency_ms BIGINT, service_checked_at TIMESTAMP_NTZ,
    service_fail_reason STRING, last_error_code STRING, country STRING, anonymity STRING,
    first_seen TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ, first_cycle_id STRING, last_cycle_id STRING,
    last_checked_at TIMESTAMP_NTZ, last_passed_at TIMESTAMP_NTZ, consecutive_failures INT,
    check_count INT, pass_count INT, notes STRING"""
)
CHECKS = _table(
    """id BIGINT, proxy_id BIGINT, cycle_id STRING, created_at TIMESTAMP_NTZ, reachable BOOLEAN,
    latency_ms BIGINT, protocol STRING, transport STRING, http_status INT, error_code STRING,
    error_message STRING, attempts INT, duration_ms BIGINT"""
)
SERVICE_CHECKS = _table(
    """id BIGINT, proxy_id BIGINT, cycle_id STRING, service STRING, created_at TIMESTAMP_NTZ,
    passed BOOLEAN, status STRING, http_status INT, latency_ms BIGINT, reason STRING,
    details TAGS"""
)
CYCLES = _table(
    """cycle_id STRING, status STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ,
    candidates_discovered BIGINT, candidates_new BIGINT, candidates_checked BIGINT,
    candidates_passed BIGINT, candidates_failed BIGINT, service_checked BIGINT,
    service_passed BIGINT, pool_size BIGINT, pool_added BIGINT, pool_quarantined BIGINT,
    pool_expired BIGINT, duration_ms BIGINT, error STRING"""
)
META = _table("key STRING, value STRING, updated_at TIMESTAMP_NTZ, deleted BOOLEAN, seq BIGINT")
JOBS = _table(
    """job_id STRING, type STRING, cycle_id STRING, issued_at STRING, proxy_id DOUBLE,
    reason STRING, attempt INT"""
)

DEFAULTS = {
    "status": "new",
    "validation_status": "unchecked",
    "service_status": "untested",
    "score": 0.0,
    "anonymity": "unknown",
    "consecutive_failures": 0,
    "check_count": 0,
    "pass_count": 0,
    "attempts": 1,
    "duration_ms": 0,
    **{
        name: 0
        for name in CYCLES.names
        if name.startswith(("candidates_", "service_", "pool_"))
    },
}
# The only columns that may leave the inventory.
PUBLIC_COLUMNS = [
    "id",
    "host",
    "port",
    "protocol",
    "source",
    "score",
    "latency_ms",
    "country",
    "anonymity",
    "last_passed",
]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a table schema; columns the input lacks get their default or NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (
                F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))
            ).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def endpoint_faults() -> Column:
    """First broken rule of an endpoint row, NULL for a sound one."""
    rules = [
        (F.col("host").isNull() | (F.col("host") == ""), "host"),
        (~F.coalesce(F.col("port").between(1, 65535), F.lit(False)), "port"),
        (~F.coalesce(F.col("protocol").isin(*PROTOCOLS), F.lit(False)), "protocol"),
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"),
        (~F.coalesce(F.col("validation_status").isin(*VALIDATION_STATUSES), F.lit(False)), "validation_status"),
        (~F.coalesce(F.col("service_status").isin(*SERVICE_STATUSES), F.lit(False)), "service_status"),
        (~F.coalesce(F.col("anonymity").isin(*ANONYMITY_LEVELS), F.lit(False)), "anonymity"),
    ]
    return F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules])


def split_sound(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows and rejected rows with the column at fault."""
    marked = endpoints.withColumn("fault", endpoint_faults())
    return marked.filter("fault is null").drop("fault"), marked.filter("fault is not null")
