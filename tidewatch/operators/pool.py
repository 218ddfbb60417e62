"""Ranked reads of the inventory: pages, work queues, capacity and weighted picks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QueueConfig, ServiceConfig
from ..functions.text import at, round_half_up
from .running import global_rank, rank_within, ranked_table


@dataclass(frozen=True)
class PoolQuery:
    """Filters and page of a pool read."""

    limit: int = 50
    offset: int = 0
    protocol: str | None = None
    min_score: float = 0
    max_latency_ms: int | None = None
    country: str | None = None
    service: str = "required"  # required, preferred or off
    ttl_minutes: int = 90


def pool_filter(query: PoolQuery, now: datetime | str) -> Column:
    """Plain comparisons with constants, so the scan gets them."""
    ok = (
        (F.col("status") == "active")
        & (F.col("score") >= float(query.min_score))
        & F.col("last_passed_at").isNotNull()
        & (F.col("last_passed_at") >= at(now, query.ttl_minutes))
    )
    if query.protocol:
        ok = ok & (F.col("protocol") == query.protocol)
    if query.country:
        ok = ok & (F.col("country") == query.country.upper())
    if query.max_latency_ms is not None:
        ok = ok & F.col("latency_ms").isNotNull() & (F.col("latency_ms") <= query.max_latency_ms)
    if query.service == "required":
        ok = ok & (F.col("service_status") == "passed")
    return ok


def by_score(*first: Column) -> list[Column]:
    """Best first: score, then known low latency, then id."""
    return [*first, F.col("score").desc(), F.col("latency_ms").asc_nulls_last(), F.col("id").asc()]


def public_view(endpoints: DataFrame) -> DataFrame:
    """The ten columns that may leave; credentials are not among them."""
    return endpoints.select(
        "id",
        "host",
        "port",
        "protocol",
        "source",
        round_half_up(F.col("score"), 2).alias("score"),
        "latency_ms",
        "country",
        "anonymity",
        F.col("last_passed_at").alias("last_passed"),
    )


def read_pool(endpoints: DataFrame, query: PoolQuery, now: datetime | str) -> DataFrame:
    """One page of the pool; a top-k, never a full sort. Adds ``pool_size``, the unpaged total."""
    matching = endpoints.filter(pool_filter(query, now))
    total = matching.agg(F.count("*").alias("n")).scalar()
    preferred = [(F.col("service_status") == "passed").desc()] if query.service == "preferred" else []
    page = matching.orderBy(*by_score(*preferred)).offset(query.offset).limit(query.limit)
    return public_view(page).withColumn("pool_size", total)


def list_by_status(endpoints: DataFrame, status: str, limit: int, offset: int = 0) -> DataFrame:
    return (
        endpoints.filter(F.col("status") == status)
        .orderBy(F.col("score").desc(), F.col("id").asc())
        .offset(offset)
        .limit(limit)
    )


def sort_by_score(entries: DataFrame) -> DataFrame:
    """A range-partitioned sort, best first."""
    return entries.orderBy(*by_score())


def ordered_union(*branches: DataFrame, pos: str = "pos") -> DataFrame:
    """Distinct union by id; the first branch, then the lowest ``pos``, wins.

    A grouped minimum does the choice, so no window sorts the union.
    """
    columns = branches[0].columns
    tagged = None
    for number, branch in enumerate(branches):
        part = branch.withColumn("branch", F.lit(number))
        tagged = part if tagged is None else tagged.unionByName(part)
    rest = [name for name in columns if name not in ("id", pos)]
    return (
        tagged.groupBy("id")
        .agg(F.min(F.struct("branch", pos, *rest)).alias("_first"))
        .select("id", "_first.*")
    )


def _ranked(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """All rows, or the first ``limit``, with their position. Only rows that a limit keeps meet in one window."""
    if limit is None:
        return global_rank(df, order)
    kept = df.orderBy(*order).limit(limit)
    return kept.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def validation_queue(endpoints: DataFrame, now: datetime | str, cfg: QueueConfig = QueueConfig()) -> DataFrame:
    """Work of one cycle: new rows, then quarantined ones, then pool members due a recheck.

    Adds ``branch`` and ``pos``; their order is the queue order. Without limits ids and order columns of all
    branches are sorted at once, and the rows take their places by a join.
    """
    oldest = [F.col("last_checked_at").asc_nulls_first(), F.col("id").asc()]
    stale = F.col("last_checked_at").isNull() | (F.col("last_checked_at") < at(now, cfg.recheck_after_minutes))
    status = F.col("status")
    if cfg.new_limit is cfg.quarantine_limit is cfg.recheck_limit is None:
        branch = F.when(status == "new", 0).when(status == "quarantined", 1).when((status == "active") & stale, 2)
        # New rows go by their id alone.
        since = F.when(status != "new", F.col("last_checked_at"))
        narrow = endpoints.select("id", branch.alias("branch"), since.alias("_since")).filter("branch is not null")
        places = rank_within(narrow, "branch", [F.col("_since").asc_nulls_first(), F.col("id").asc()]).drop("_since")
        queue = endpoints.join(places, "id").select(*endpoints.columns, "branch", "pos")
        return queue if cfg.max_per_cycle is None else queue.orderBy("branch", "pos").limit(cfg.max_per_cycle)
    branches = [
        (status == "new", [F.col("id").asc()], cfg.new_limit),
        (status == "quarantined", oldest, cfg.quarantine_limit),
        ((status == "active") & stale, oldest, cfg.recheck_limit),
    ]
    union = ordered_union(*[_ranked(endpoints.filter(test), order, limit) for test, order, limit in branches])
    ordered = union.orderBy("branch", "pos")
    return ordered if cfg.max_per_cycle is None else ordered.limit(cfg.max_per_cycle)


def service_candidates(
    endpoints: DataFrame, now: datetime | str, limit: int | None, cfg: ServiceConfig = ServiceConfig()
) -> DataFrame:
    """Pool members whose service verdict is missing or stale, best first; unknown latency leads."""
    due = F.col("service_checked_at").isNull() | (F.col("service_checked_at") < at(now, cfg.recheck_after_minutes))
    order = [F.col("score").desc(), F.col("latency_ms").asc_nulls_first(), F.col("id").asc()]
    return _ranked(
        endpoints.filter((F.col("status") == "active") & (F.col("score") >= cfg.min_score) & due), order, limit
    )


def cycle_service_selection(
    endpoints: DataFrame, validated: DataFrame, now: datetime | str, cfg: ServiceConfig = ServiceConfig()
) -> DataFrame:
    """Service checks of one cycle, at most the budget if there is one.

    Just validated rows (``validated`` holds their ids) that passed but lack a service pass
    come first; stale pool members fill what is left of the budget.
    """
    if cfg.budget_per_cycle is None:
        return _all_service_checks(endpoints, validated, now, cfg)
    fresh = _ranked(
        endpoints.join(validated.select("id").distinct(), "id", "left_semi").filter(
            (F.col("validation_status") == "passed")
            & (F.col("score") >= cfg.min_score)
            & (F.col("service_status") != "passed")
        ),
        [F.col("score").desc(), F.col("id").asc()],
        cfg.budget_per_cycle,
    ).withColumn("branch", F.lit(0))
    # The remainder is taken off before repeats are dropped, so fewer rows may come back.
    used = fresh.agg(F.count("*").alias("n")).scalar()
    stale = service_candidates(endpoints, now, cfg.budget_per_cycle, cfg)
    if cfg.budget_per_cycle is not None:
        stale = stale.filter(F.col("pos") <= F.lit(cfg.budget_per_cycle) - used)
    stale = (
        stale.join(fresh.select("id"), "id", "left_anti")
        .withColumn("branch", F.lit(1))
    )
    return fresh.unionByName(stale)


def _all_service_checks(endpoints: DataFrame, validated: DataFrame, now: datetime | str, cfg: ServiceConfig) -> DataFrame:
    """The same without a budget: both branches ranked by one sort of ids and order columns."""
    listed = validated.select(F.col("id").alias("_id")).distinct()
    fresh = (
        F.col("_id").isNotNull()
        & (F.col("validation_status") == "passed")
        & (F.col("score") >= cfg.min_score)
        & (F.col("service_status") != "passed")
    )
    due = F.col("service_checked_at").isNull() | (F.col("service_checked_at") < at(now, cfg.recheck_after_minutes))
    stale = (F.col("status") == "active") & (F.col("score") >= cfg.min_score) & due
    told = lambda test: F.coalesce(test, F.lit(False))
    branches = F.filter(F.array(F.when(told(fresh), 0), F.when(told(stale), 1)), lambda b: b.isNotNull())
    narrow = endpoints.join(listed, F.col("id") == F.col("_id"), "left").select(
        "id", F.col("score").alias("_score"), F.col("latency_ms").alias("_latency"), told(fresh).alias("_fresh"), F.explode(branches).alias("branch")
    )
    # Latency does not order fresh rows.
    order = [F.col("_score").desc(), F.when(F.col("branch") == 1, F.col("_latency")).asc_nulls_first(), F.col("id").asc()]
    # A stale row that is fresh as well keeps its place there and is left out here.
    places = rank_within(narrow, "branch", order).filter("branch = 0 or not _fresh").select("id", "branch", "pos")
    return endpoints.join(places, "id").select(*endpoints.columns, "pos", "branch")


#: Up to this cap the row at the cap is found by a top-k, beyond it by sorted ranges.
TOP_K = 100_000


def over_capacity(endpoints: DataFrame, max_active: int | None) -> Column:
    """Whether an active row of ``endpoints`` is past the cap, worst first to go.

    The row at the cap is the last of a top-k, or is found from sorted ranges and their sizes where the cap
    is large; all rows behind it go by a plain comparison, so the table is neither joined nor sorted in one task.
    """
    active = F.col("status") == "active"
    if max_active is None:
        return F.lit(False)
    if max_active <= 0:
        return active
    score = F.coalesce(F.col("score"), F.lit(float("-inf")))
    latency = F.coalesce(F.col("latency_ms").cast("double"), F.lit(float("inf")))
    keys = endpoints.filter(active).select(score.alias("score"), latency.alias("latency"), "id")
    order = [F.col("score").desc(), F.col("latency").asc(), F.col("id").desc()]
    if max_active <= TOP_K:
        last = keys.orderBy(*order).offset(max_active - 1).limit(1).select(F.struct("score", "latency", "id")).scalar()
    else:
        ranked = global_rank(keys, order)
        last = ranked.filter(F.col("pos") == max_active).select(F.struct("score", "latency", "id")).scalar()
    behind = (score < last["score"]) | (
        (score == last["score"])
        & ((latency > last["latency"]) | ((latency == last["latency"]) & (F.col("id") < last["id"])))
    )
    return F.coalesce(active & behind, F.lit(False))


def weighted_pick(ranked: DataFrame, u: float) -> DataFrame:
    """The row a draw ``u`` in 0..1 lands on, weight max(1, score), best first, over all rows.

    ``u`` is given, so the pick is repeatable. Weights are summed per range of the sorted rows; only
    the range that the draw lands in is summed row by row.
    """
    order = by_score()
    weight = F.greatest(F.lit(1.0), F.col("score"))
    table = ranked_table(ranked, order)
    sums = table.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    # One row per range.
    so_far = F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    upto = sums.select("_range", so_far.alias("_upto"), F.sum("_sum").over(Window.partitionBy()).alias("_total"), "_sum")
    target = F.col("_total") * u
    landed = upto.filter(F.col("_upto") >= target).orderBy("_upto").limit(1)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = table.join(landed, "_range").withColumn("_here", F.col("_upto") - F.col("_sum") + F.sum(weight).over(inside))
    hit = rows.filter(F.col("_here") >= target).orderBy("_here").limit(1)
    return hit.drop("_range", "_upto", "_total", "_sum", "_here")


def draw(seed: str, *parts: Column) -> Column:
    """A number above 0 and up to 1 from a seed and the parts that name a row: the same on every run and engine."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def weighted_sample(rows: DataFrame, groups: list[str], k: int, seed: str, weight: Column | None = None, id: str = "id") -> DataFrame:
    """``k`` rows of every group without replacement, likelier the larger their weight; adds ``nth``, the order drawn.

    Every row draws an exponential key, ``-ln(u) / weight``, and the least ``k`` of a group are its sample.
    Spark keeps the least ``k`` per group in each task before it shuffles, so a group of any size sends few
    rows. ``weight`` is max(1, score) by default; rows whose weight is not above 0 are not drawn.
    """
    size = F.greatest(F.lit(1.0), F.col("score")) if weight is None else weight
    drawn = rows.withColumn("_weight", size.cast("double")).filter("_weight > 0")
    keyed = drawn.withColumn("_key", -F.log(draw(seed, F.col(id))) / F.col("_weight"))
    order = Window.partitionBy(*groups).orderBy("_key", id)
    return keyed.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("_weight", "_key")
