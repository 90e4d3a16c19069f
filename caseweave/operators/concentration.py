"""Lorenz curves, Gini indices and Pareto tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.operators.running import running_totals

# Steps per doubling of the rate; bounds both the number of blocks and what shares one.
BLOCKS_PER_DOUBLING = 1024


def curve_rate(cases: str, population: str) -> Column:
    """Sort key of a curve: cases per person, infinite where there is nobody to divide by."""
    cases, population = F.col(cases).cast("double"), F.col(population).cast("double")
    return F.when((population == 0) & (cases > 0), F.lit(float("inf"))).otherwise(
        F.try_divide(cases, population)
    )


def lorenz(
    df: DataFrame,
    strata: Sequence[str],
    cases: str,
    population: str,
    tie: Sequence[str],
    origin: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """Cumulative case and population shares (c_i, p_i) by descending rate.

    ``tie`` orders rows of equal rate and should make rows unique in a stratum.
    With ``origin`` one (0, 0) row per stratum is added, other columns NULL. Shares are
    NULL in a stratum with a missing or zero total.
    """
    case, pop = F.col(cases).cast("double"), F.col(population).cast("double")
    ranked = df.withColumn("_rate", curve_rate(cases, population))
    order = [F.col("_rate").desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]]
    summed = running_totals(
        ranked,
        strata,
        order,
        {"case_cumsum": case, "pop_cumsum": pop, "_place": F.lit(1)},
        {"_cases": case, "_population": pop, "_unknown": (case.isNull() | pop.isNull()).cast("int")},
        block_rows,
    )
    known = F.col("_unknown") == 0
    curve = summed.withColumns({
        "c_i": F.when(known, F.try_divide("case_cumsum", "_cases")),
        "p_i": F.when(known, F.try_divide("pop_cumsum", "_population")),
    })
    columns = [*df.columns, "case_cumsum", "pop_cumsum", "c_i", "p_i"]
    if not origin:
        return curve.select(*columns)
    # The first row of a stratum brings the origin with it.
    own = F.struct(*columns)
    zero = {c: F.col(c) for c in strata} | {"c_i": F.lit(0.0), "p_i": F.lit(0.0)}
    start = F.struct(*[zero.get(c, F.lit(None).cast(curve.schema[c].dataType)).alias(c) for c in columns])
    return curve.select(F.inline(F.when(F.col("_place") == 1, F.array(start, own)).otherwise(F.array(own))))


def gini(
    df: DataFrame,
    strata: Sequence[str],
    cases: str,
    population: str,
    tie: Sequence[str] = (),
    origin: bool = True,
    total: str | None = None,
) -> DataFrame:
    """Gini index ``g`` per stratum, positive because the curve runs by descending rate.

    ``total`` names a column for the sum of the cases, which is known here anyway.

    Rows of equal rate lie on one straight piece of the curve, so they are added up
    before anything is sorted. What is left is cut into blocks by a fixed rule on the
    rate; each block yields its sums and its own area, and the blocks of a stratum are
    put together by their totals. A task holds the distinct rates of one block.

    Without ``origin`` the piece from (0, 0) to the first row is left out; ``tie``
    decides which row is first, and a stratum of one row gets NULL. So does a stratum
    with a missing or zero total.
    """
    case, pop = F.col(cases).cast("double"), F.col(population).cast("double")
    # Smallest tie value first, NULL last.
    ties = [part for t in tie for part in (F.col(t).isNull().alias(f"_no_{t}"), F.col(t))]
    ranked = df.select(
        *strata,
        case.alias("_c"),
        pop.alias("_p"),
        curve_rate(cases, population).alias("_rate"),
        F.struct(*ties, case.alias("_fc"), pop.alias("_fp")).alias("_first"),
    )
    first = [] if origin else [F.min("_first").alias("_first")]
    steps = ranked.groupBy(*strata, "_rate").agg(
        F.sum("_c").alias("_c"),
        F.sum("_p").alias("_p"),
        F.count_if(F.col("_c").isNull() | F.col("_p").isNull()).alias("_unknown"),
        F.count(F.lit(1)).alias("_rows"),
        *first,
    )
    return gini_of_steps(steps, strata, _rate_block(F.col("_rate")), F.col("_rate"), origin, total)


def _rate_block(value: Column) -> Column:
    """Order-preserving block number of a rate."""
    finite = F.floor(F.log2(value) * BLOCKS_PER_DOUBLING)
    lowest, highest = F.lit(-(2**40)), F.lit(2**40)
    return (
        F.when(value.isNull(), lowest - 1)
        .when(value <= 0, lowest)
        .when(value == float("inf"), highest)
        .otherwise(finite)
    )


def gini_of_steps(
    steps: DataFrame, strata: Sequence[str], block: Column, rank: Column, origin: bool = True, total: str | None = None
) -> DataFrame:
    """Gini index from rows (_c, _p, _unknown, _rows, _first) that are one straight piece each.

    ``rank`` orders the pieces, highest first, and ``block`` must be a non-decreasing
    function of it. Twice the area under the curve is the sum over blocks of
    ``area + 2 * cases before the block * population of the block``.
    """
    inside = (
        W.partitionBy(*strata, "_block").orderBy(F.col("_rank").desc_nulls_last())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    sums = [F.sum(name).alias(name) for name in ("_c", "_p", "_area", "_unknown", "_rows")]
    first = [] if origin else [F.max_by("_first", "_rank").alias("_first")]
    blocks = (
        steps.withColumns({"_block": block, "_rank": rank})
        .withColumn("_area", F.col("_p") * (2 * F.sum("_c").over(inside) - F.col("_c")))
        .groupBy(*strata, "_block")
        .agg(*sums, *first)
    )
    before = W.partitionBy(*strata).orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    first = [] if origin else [F.max_by("_first", "_block").alias("_first")]
    result = (
        blocks.withColumn(
            "_area", F.col("_area") + 2 * F.coalesce(F.sum("_c").over(before), F.lit(0.0)) * F.col("_p")
        )
        .groupBy(*strata)
        .agg(*sums, *first)
    )
    area, defined = F.col("_area"), F.col("_unknown") == 0
    if not origin:
        area = area - F.col("_first._fc") * F.col("_first._fp")
        defined = defined & (F.col("_rows") > 1)
    index = F.try_divide(area, F.col("_c") * F.col("_p")) - 1
    totals = [F.col("_c").alias(total)] if total else []
    return result.select(*strata, F.when(defined, index).alias("g"), *totals)


def as_percent(g: Column | str, digits: int = 3) -> Column:
    """Index in percent, rounded before it is scaled."""
    g = F.col(g) if isinstance(g, str) else g
    return F.round(g, digits) * 100


def pareto(
    df: DataFrame,
    unit: str,
    strata: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Units by descending count ``n`` with running total and running percent; ties by unit.

    Without ``strata`` all units form one table; it is still summed in blocks.
    """
    counts = df.groupBy(*strata, unit).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col(unit).asc_nulls_last()]
    summed = running_totals(counts, strata, order, {"cumsum": F.col("n")}, {"_total": F.col("n")}, block_rows)
    percent = F.lit(100.0) * F.col("cumsum") / F.col("_total")
    return summed.select(*strata, unit, "n", "cumsum", percent.alias("cumprop"))


def top_units(df: DataFrame, unit: str, k: int) -> DataFrame:
    """The ``k`` units with most rows; ties by unit. Sorted with a bounded heap, not a full sort."""
    counts = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(unit).asc_nulls_last()).limit(k)
