"""Probe rules as rows: what a service's answers mean, registered by name and looked up per response."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``status_low`` and ``status_high`` bound the status, ``header`` must be there (with ``header_value`` in it),
#: ``marker`` must be in the body; what is null does not count. ``{status}`` in a reason is the status.
RULES = (
    "service string, ordinal int, status_low int, status_high int, header string, header_value string, marker string, "
    "verdict string, reason string"
)
NAMES = [field.split()[0] for field in RULES.split(", ")]
VERDICTS = ("passed", "blocked", "failed", "skipped")
_RULES: dict[str, list[dict]] = {}


def register_probe_rules(service: str, rules: Iterable[Mapping[str, object]]) -> None:
    """Name the rules of a service, in the order they are tried; they take the place of earlier ones."""
    listed = []
    for ordinal, rule in enumerate(rules):
        unknown = set(rule) - set(NAMES)
        if unknown or rule.get("verdict") not in VERDICTS:
            raise ValueError(f"rule {ordinal} of {service}: unknown {sorted(unknown) or rule.get('verdict')!r}")
        listed.append({"service": service, "ordinal": ordinal, **rule})
    _RULES[service] = listed


def probe_rules(spark: SparkSession) -> DataFrame:
    """All registered rules as a table."""
    rows = [tuple(rule.get(name) for name in NAMES) for rules in _RULES.values() for rule in rules]
    return spark.createDataFrame(rows, RULES)


def rule_fits(rule: Column, status: Column, headers: Column, body: Column) -> Column:
    """Whether a response meets all that a rule asks for."""
    value = F.lower(F.try_element_at(headers, F.lower(rule["header"])))
    return (
        (rule["status_low"].isNull() | F.coalesce(status >= rule["status_low"], F.lit(False)))
        & (rule["status_high"].isNull() | F.coalesce(status <= rule["status_high"], F.lit(False)))
        & (
            rule["header"].isNull()
            | (value.isNotNull() & (rule["header_value"].isNull() | F.contains(value, F.lower(rule["header_value"]))))
        )
        & (rule["marker"].isNull() | F.contains(body, F.lower(rule["marker"])))
    )


def classify_by_rules(
    responses: DataFrame,
    rules: DataFrame,
    service: str = "service",
    status: str = "status",
    headers: str = "headers",
    body: str = "body_text",
) -> DataFrame:
    """Add ``rule`` (the ordinal of the first that fits, null if none does), ``verdict`` and ``reason``.

    The rules of a service are one row, in order, so a response meets one row and is neither copied per rule
    nor grouped again. Names of ``headers`` (a map) are lower case.
    """
    row = F.struct(*[F.col(name) for name in NAMES if name != "service"])
    ordered = rules.groupBy(F.col("service").alias("_service")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("nth"), row.alias("rule")))).alias("_rules")
    )
    joined = responses.join(ordered, F.col(service) == F.col("_service"), "left").withColumn(
        "_body", F.lower(F.coalesce(F.col(body), F.lit("")))
    )
    fits = lambda r: rule_fits(r["rule"], F.col(status), F.col(headers), F.col("_body"))
    first = joined.withColumn("_first", F.get(F.filter("_rules", fits), F.lit(0))["rule"])
    reason = F.replace(F.col("_first.reason"), F.lit("{status}"), F.coalesce(F.col(status).cast("string"), F.lit("")))
    return first.select(
        *responses.columns, F.col("_first.ordinal").alias("rule"), F.col("_first.verdict").alias("verdict"), reason.alias("reason")
    )
