"""Ordered running values that survive a hot key.

A window over one key sorts that key's rows in one task. Here a key is cut into
blocks along its order: values run inside a block, and only one row per block is
carried over to the next, so the largest task holds one block, not one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_BLOCK = "_block"


def evaluate_once(keep: Sequence[Column | str], staged: Sequence[Column]) -> list[Column]:
    """Select list that ends a chain of staged columns.

    A filter on a staged result would be pushed down by writing the whole chain into
    the predicate, which grows with every stage. Filters do not pass a generator, so
    the chain is closed by one that emits exactly one row.
    """
    return [*keep, F.inline(F.array(F.struct(*staged)))]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum``, ``max`` or ``last`` columns per key in ``order``.

    ``block`` must not decrease along ``order``. ``last`` is the latest value that
    is not NULL. ``values`` maps a new column to (kind, expression). With
    ``inclusive`` off the current row is left out of ``last`` and ``max``.
    """
    blocked = df.withColumn(_BLOCK, block)
    spot = F.struct(*order)
    fold = {
        "sum": lambda c: F.sum(c),
        "max": lambda c: F.max(c),
        "last": lambda c: F.max_by(c, F.when(c.isNotNull(), spot)),
    }
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry_over = {
        "sum": lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)),
        "max": lambda c: F.max(c).over(earlier),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
    }
    totals = blocked.groupBy(*keys, _BLOCK).agg(
        *[fold[kind](expr).alias(f"_total_{name}") for name, (kind, expr) in values.items()]
    )
    carried = totals.select(
        *keys,
        _BLOCK,
        *[carry_over[kind](F.col(f"_total_{name}")).alias(f"_carry_{name}") for name, (kind, _) in values.items()],
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = {
        "sum": lambda c: F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "max": lambda c: F.max(c).over(upto),
        "last": lambda c: F.last(c, ignorenulls=True).over(upto),
    }
    stepped = blocked.select(
        *df.columns,
        _BLOCK,
        *[local[kind](expr).alias(f"_here_{name}") for name, (kind, expr) in values.items()],
    ).join(carried, [*keys, _BLOCK], "left")
    join_up = {
        "sum": lambda here, before: before + here,
        "max": lambda here, before: F.greatest(here, before),
        "last": lambda here, before: F.coalesce(here, before),
    }
    return stepped.select(
        *df.columns,
        *[
            join_up[kind](F.col(f"_here_{name}"), F.col(f"_carry_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )


def ranked_table(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows as a written table sorted by ``order``, with ``_range``, the number of their range.

    Ranges are about equal in rows, so no task holds more than its share, however the values lie.
    """
    return written(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Add the place of every row in ``order``, from 1, without sorting all rows in one task."""
    table = ranked_table(df, order)
    counts = table.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = table.withColumn("_inside", inside).join(starts, "_range")
    return numbered.withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def rank_within(df: DataFrame, branch: str, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Add the place of every row in ``order`` within its ``branch``, from 1.

    All branches are sorted at once, by ranges; a branch begun in earlier ranges goes on from their sizes.
    """
    table = ranked_table(df, [F.col(branch), *order])
    counts = table.groupBy("_range", branch).agg(F.count(F.lit(1)).alias("_n"))
    # One row per range and branch in it.
    before = Window.partitionBy(branch).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", branch, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range", branch).orderBy(*order))
    numbered = table.withColumn("_inside", inside).join(starts, ["_range", branch])
    return numbered.withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


BLOCK = "_rows"


def cut_by_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add a block number for :func:`running`, by ranges of the sorted rows.

    A block holds about as many rows as any other, whatever a key does at one moment.
    """
    return ranked_table(df, [F.col(name) for name in (*keys, *order)]).withColumnRenamed("_range", BLOCK)


def running_by_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]]
) -> DataFrame:
    """:func:`running` over blocks of rows."""
    return running(cut_by_rows(df, keys, order), keys, order, F.col(BLOCK), values).drop(BLOCK)
