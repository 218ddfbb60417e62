"""Job messages: parse, check, set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import JOB_REASONS, JOB_TYPES, JOBS

NEEDS_ENDPOINT = ["VALIDATE", "RECHECK", "SERVICE_CHECK"]


def parse_jobs(messages: DataFrame, body: str = "body") -> DataFrame:
    """Add the job columns and ``fault``, NULL for a message to work on.

    Works on a stream as on a table. Field kinds are looked at in the variant, since a
    cast would take a number for a text.
    """
    doc = messages.withColumn("_doc", F.try_parse_json(body))

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_doc", f"$.{name}", "variant"))

    def value(name: str, as_type: str) -> Column:
        return F.try_variant_get("_doc", f"$.{name}", as_type)

    def is_text(name: str) -> Column:
        return F.coalesce(kind(name) == "STRING", F.lit(False))

    absent = value("proxy_id", "variant").isNull()
    numeric = kind("proxy_id").isin("BIGINT", "DOUBLE", "FLOAT") | kind("proxy_id").startswith("DECIMAL")
    job_type = value("type", "string")
    fault = (
        F.when(F.col("_doc").isNull(), "not json")
        .when(~(is_text("job_id") & is_text("cycle_id") & is_text("type")), "missing field")
        .when(~job_type.isin(*JOB_TYPES), "unknown type")
        .when(~absent & ~F.coalesce(numeric, F.lit(False)), "invalid proxy_id")
        .when(job_type.isin(*NEEDS_ENDPOINT) & absent, "proxy_id required")
    )
    reason = value("reason", "string")
    shown = {
        "reason": F.when(is_text("reason") & reason.isin(*JOB_REASONS), reason),
        "attempt": F.coalesce(value("attempt", "int"), F.lit(1)),
        "proxy_id": F.when(F.coalesce(numeric, F.lit(False)), value("proxy_id", "double")),
    }
    return doc.select(
        *[F.col(name) for name in messages.columns],
        *[
            shown.get(f.name, F.when(is_text(f.name), value(f.name, "string"))).cast(f.dataType).alias(f.name)
            for f in JOBS.fields
        ],
        fault.alias("fault"),
    ).withColumn("proxy_id", F.col("proxy_id").cast("bigint"))


def split_jobs(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs to work on and rejected messages with their fault."""
    return parsed.filter("fault is null").drop("fault"), parsed.filter("fault is not null")
