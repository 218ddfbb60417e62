"""Cross-source merge, policy filter and the upsert into the endpoint table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import bare_host, endpoint_allowed, inspect_address
from ..functions.keys import dedupe_hash
from ..functions.text import at, let
from ..schemas import ENDPOINTS, conform
from .parse import BLOCK_LINES, CANDIDATE

IDENTITY = ["protocol", "host", "port", "username"]


def trust_of(value: Column) -> Column:
    """Relative trust of a source, 0..1, a half when unrated."""
    return F.least(F.greatest(F.coalesce(value, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def merge_sources(entries: DataFrame, sources: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per endpoint over all sources; the first source in order gives ``source`` and ``trust``.

    ``entries`` are distinct per source (:func:`..parse.first_entries`); ``sources`` has
    ``source, source_ord, trust``. The identity text is grouped and hashed once per
    survivor. ``cap`` keeps the first candidates in source and line order.
    """
    placed = entries.join(sources.select("source", "source_ord", trust_of(F.col("trust")).alias("trust")), "source")
    first = F.min(F.struct("source_ord", "line_no", "source", "trust", *CANDIDATE))
    merged = (
        placed.groupBy("entry_key")
        .agg(first.alias("_first"), F.count("*").alias("reported_by"))
        .select("_first.*", "reported_by")
    )
    if cap is not None:
        merged = merged.orderBy("source_ord", "line_no").limit(cap)
    return merged.withColumn("dedupe_key", dedupe_hash(*[F.col(name) for name in IDENTITY]))


def discovery_totals(
    report: DataFrame, merged: DataFrame, sources: DataFrame | None = None
) -> DataFrame:
    """One row: discovered lines, accepted candidates, rejects, duplicates, sources ok and failed.

    Duplicates are repeats inside a source, repeats across sources and everything past
    the cap, so they are whatever was accepted per source but is no candidate.
    """
    per_source = report.agg(
        F.coalesce(F.sum("total_lines"), F.lit(0)).alias("discovered"),
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("repeats"),
        F.count("*").alias("sources_ok"),
    )
    kept = merged.agg(F.count("*").alias("n")).scalar()
    wanted = sources.agg(F.count("*").alias("n")).scalar() if sources is not None else F.col("sources_ok")
    return per_source.withColumn("accepted", kept).select(
        "discovered",
        "accepted",
        "rejected",
        (F.col("repeats") + F.col("entries") - F.col("accepted")).alias("duplicates"),
        "sources_ok",
        (wanted - F.col("sources_ok")).alias("sources_failed"),
    )


def listed_hosts(hosts: DataFrame, allowed: DataFrame, host: str = "host", subdomains: bool = True) -> DataFrame:
    """Add ``listed``: whether a host, or a domain it lies under, is in a table of hosts of any length.

    Every distinct host gives the suffixes that begin at its labels, and these meet the list by an equi-join,
    so the plan does not grow with the list and the work not with list times hosts. Case does not matter.
    ``allowed``: host. Without ``subdomains`` only whole hosts count.
    """
    own = hosts.select(F.col(host).alias("_host")).filter("_host is not null").distinct()
    labels = F.split(F.lower("_host"), r"\.")
    starts = F.sequence(F.lit(1), F.size(labels)) if subdomains else F.array(F.lit(1))
    suffix = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    entries = allowed.select(F.lower("host").alias("_suffix")).filter("_suffix is not null").distinct()
    found = own.select("_host", F.explode(suffix).alias("_suffix")).join(entries, "_suffix").select("_host").distinct()
    marked = found.withColumn("_listed", F.lit(True))
    joined = hosts.join(marked, F.col(host) == F.col("_host"), "left")
    return joined.withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_host", "_listed")


def with_policy(candidates: DataFrame, allow_private: bool = False, allow: Sequence[str] | DataFrame = ()) -> DataFrame:
    """Add ``allowed``; the number of refused rows is a plain aggregate over it.

    ``allow`` are hosts that pass whatever they are: a few names, or a table (``host``) of any size.
    """
    host = F.col("host")
    if isinstance(allow, DataFrame):
        marked = listed_hosts(candidates.withColumn("_bare", bare_host(host)), allow, "_bare", subdomains=False)
        ok = let(inspect_address(host), lambda verdict: endpoint_allowed(verdict, host, allow_private))
        return marked.withColumn("allowed", F.col("listed") | ok).drop("_bare", "listed")
    ok = let(inspect_address(host), lambda verdict: endpoint_allowed(verdict, host, allow_private, allow))
    return candidates.withColumn("allowed", ok)


def resolve_hosts(
    records: DataFrame, name: str, address: str, order: str, allow_private: bool = False
) -> DataFrame:
    """Policy over recorded resolutions: (name, outcome, address, records).

    A metadata address blocks the name outright, else the first allowed address counts, IPv4
    before IPv6. Names without a record (a NULL address) are DNS errors.
    """
    facts = let(
        inspect_address(F.col(address)),
        lambda v: F.struct(
            (v["classification"] == "cloud_metadata").alias("meta"),
            endpoint_allowed(v, F.col(address), allow_private).alias("ok"),
            F.when(v["kind"] == "ipv6", 6).otherwise(4).alias("family"),
        ),
    )
    rows = records.select(name, address, order, facts.alias("f"))
    grouped = rows.groupBy(name).agg(
        F.bool_or("f.meta").alias("meta"),
        F.min(F.when(F.col("f.ok"), F.struct("f.family", order, address))).alias("first"),
        F.count(address).alias("records"),
    )
    barred = F.lit(False) if allow_private else F.coalesce("meta", F.lit(False))
    return grouped.select(
        name,
        F.when(F.col("records") == 0, "dns_error")
        .when(barred | F.col("first").isNull(), "blocked")
        .otherwise("ok")
        .alias("outcome"),
        F.when(~barred, F.col(f"first.{address}")).alias("address"),
        "records",
    )


def existing_keys(endpoints: DataFrame, keys: DataFrame, column: str = "dedupe_key") -> DataFrame:
    """Endpoints whose key is listed (a semi join; no key list is collected)."""
    return endpoints.join(keys.select(column).distinct(), column, "left_semi")


def split_known(candidates: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates to insert and candidates that only touch a known endpoint."""
    known = endpoints.select("dedupe_key")
    return (
        candidates.join(known, "dedupe_key", "left_anti"),
        candidates.join(known, "dedupe_key", "left_semi"),
    )


def upsert_counts(candidates: DataFrame, endpoints: DataFrame) -> DataFrame:
    """total, inserted and touched in one pass over the joined keys."""
    known = endpoints.select("dedupe_key", F.lit(True).alias("known"))
    return (
        candidates.select("dedupe_key")
        .distinct()
        .join(known, "dedupe_key", "left")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("known").isNull()).alias("inserted"),
            F.count_if(F.col("known").isNotNull()).alias("touched"),
        )
    )


def number_rows(df: DataFrame, order: Sequence[str], block: Column, name: str = "nth") -> DataFrame:
    """Dense 1-based number in ``order`` without sorting all rows in one task.

    Rows are numbered inside blocks; only the block sizes meet in one small window.
    ``block`` must be unique to a stretch of the order and not decrease along it.
    """
    blocked = df.withColumn("_block", block)
    sizes = blocked.groupBy("_block").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(*order)
    return (
        blocked.withColumn("_in", F.row_number().over(inside))
        .join(offsets, "_block")
        .withColumn(name, F.col("_before") + F.col("_in"))
        .drop("_block", "_in", "_before")
    )


def upsert_candidates(
    endpoints: DataFrame,
    candidates: DataFrame,
    cycle_id: str,
    now: datetime | str,
    block_lines: int = BLOCK_LINES,
    top: int | None = None,
) -> DataFrame:
    """The endpoint table after a merge of ``candidates`` (unique by ``dedupe_key``).

    Unknown keys are inserted as ``new`` with ids behind the highest one, in source and
    line order. Known rows are touched: seen time and cycle move, a missing country or
    account is filled in and a dead row turns ``new``; source and anonymity stay. ``top`` is the
    highest id where ``endpoints`` are not all there are.
    """
    old = conform(endpoints, ENDPOINTS)
    fresh = candidates.select("dedupe_key", "source", "source_ord", "line_no", *CANDIDATE).alias("n")
    seen = F.col("n.dedupe_key").isNotNull()
    moves = {
        "last_seen": F.when(seen, at(now)).otherwise(F.col("o.last_seen")),
        "last_cycle_id": F.when(seen, F.lit(cycle_id)).otherwise(F.col("o.last_cycle_id")),
        "status": F.when(seen & (F.col("o.status") == "dead"), "new").otherwise(F.col("o.status")),
        **{
            name: F.when(seen, F.coalesce(f"o.{name}", f"n.{name}")).otherwise(F.col(f"o.{name}"))
            for name in ("country", "username", "password")
        },
    }
    touched = old.alias("o").join(fresh, F.col("o.dedupe_key") == F.col("n.dedupe_key"), "left").select(
        *[moves.get(f, F.col(f"o.{f}")).cast(ENDPOINTS[f].dataType).alias(f) for f in ENDPOINTS.names]
    )
    inserted = candidates.join(old.select("dedupe_key"), "dedupe_key", "left_anti")
    numbered = number_rows(
        inserted,
        ["source_ord", "line_no"],
        F.struct("source_ord", F.floor(F.col("line_no") / block_lines).alias("part")),
    )
    highest = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar() if top is None else F.lit(top)
    rows = numbered.select(
        (highest + F.col("nth")).alias("id"),
        "dedupe_key",
        "source",
        *CANDIDATE,
        *[at(now).alias(name) for name in ("first_seen", "last_seen")],
        *[F.lit(cycle_id).alias(name) for name in ("first_cycle_id", "last_cycle_id")],
    )
    return touched.unionByName(conform(rows, ENDPOINTS))
