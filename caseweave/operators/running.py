"""Running totals in a given order, without a task that holds a whole stratum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.session import stored

BLOCK_ROWS = 500_000
_BLOCK = "_block"
_KEY = "_key"


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL equals NULL, keeping the keys once (those of the left side)."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])


def largest_stratum(df: DataFrame, strata: Sequence[str]) -> int:
    """Row count of the largest stratum: one number, counted by the executors over the key columns."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.agg(F.max("rows")).first()[0] or 0


def running_totals(
    df: DataFrame,
    strata: Sequence[str],
    order: Sequence[Column],
    running: Mapping[str, Column],
    whole: Mapping[str, Column] | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add running sums within ``strata`` in the given order, ties row by row.

    ``running`` holds the sums to run, ``whole`` sums over the complete stratum that
    every row gets as well. The input is written once, and counted by that write. Rows are summed inside blocks, and blocks are
    shifted by the totals of those before them. A stratum of up to ``block_rows`` rows is one block. If some stratum is
    larger, rows are cut by ranges of (strata, order) and written with their block, so that the totals,
    which read three columns of that table, and the rows see the same blocks. ``order`` should be unique within a stratum.
    """
    whole = whole or {}
    block_rows = block_rows or BLOCK_ROWS
    inputs = {f"_in_{name}": value for name, value in {**running, **whole}.items()}
    rows, total = stored(df.withColumns(inputs))
    # One struct key: equal when its NULL parts are, and shared by the window and the join.
    key = F.struct(*strata) if strata else F.lit(0)
    cut = total > block_rows and largest_stratum(rows, strata) > block_rows
    if cut:
        keys = [F.col(name).asc() for name in strata]
        ranged = rows.repartitionByRange(-(-total // block_rows), *keys, *order)
        rows, _ = stored(ranged.withColumn(_BLOCK, F.spark_partition_id()))
    else:
        rows = rows.withColumn(_BLOCK, F.lit(0))
    rows = rows.withColumn(_KEY, key)
    block = W.partitionBy(_KEY, _BLOCK)
    inside = block.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = {name: F.sum(f"_in_{name}").over(inside) for name in running}
    if not cut:
        sums |= {name: F.sum(f"_in_{name}").over(block) for name in whole}
        return rows.withColumns(sums).select(*df.columns, *running, *whole)

    before = W.partitionBy(_KEY).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    complete = W.partitionBy(_KEY)
    shifts = rows.groupBy(_KEY, _BLOCK).agg(*[F.sum(name).alias(name) for name in inputs])
    shifts = shifts.select(
        _KEY,
        _BLOCK,
        *[F.sum(f"_in_{name}").over(before).alias(f"_shift_{name}") for name in running],
        *[F.sum(f"_in_{name}").over(complete).alias(name) for name in whole],
    )
    shifted = rows.withColumns(sums).join(shifts, [_KEY, _BLOCK])
    # As in one window, a total is NULL only while nothing known has been seen in this block or before it.
    totals = {name: F.coalesce(F.col(name) + F.col(f"_shift_{name}"), name, f"_shift_{name}") for name in running}
    return shifted.withColumns(totals).select(*df.columns, *running, *whole)
