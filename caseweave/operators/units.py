"""Reporting units: how many there are, and rows for those that never reported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.operators.running import lookup

ROWS_PER_CHUNK = 10_000


def distinct_units(df: DataFrame, keys: Sequence[str], unit: str, name: str) -> DataFrame:
    """Number of distinct units per key; an unnamed (NULL) unit counts as one."""
    return df.select(*keys, unit).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_units_of(df: DataFrame, keys: Sequence[str], unit: str, split: str, names: Mapping[object, str]) -> DataFrame:
    """Number of distinct units per key for several values of ``split`` at once, NULL where there is none.

    ``names`` maps each value to its output column.
    """
    seen = df.select(*keys, split, unit).distinct()
    counts = [F.nullif(F.count_if(F.col(split) == value), F.lit(0)).alias(name) for value, name in names.items()]
    return seen.groupBy(*keys).agg(*counts)


def full_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join on keys where NULL equals NULL, keys kept once."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    joined = left.withColumn("_l", F.lit(True)).join(renamed, condition, "full")
    # A NULL key is a value here, so the side that matched decides, not coalesce.
    merged = [F.when(F.col("_l"), F.col(key)).otherwise(F.col(f"_r_{key}")).alias(key) for key in keys]
    others = [c for c in [*left.columns, *right.columns] if c not in keys]
    return joined.select(*merged, *others)


def estimate_units(
    observed: DataFrame, official: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "n_hu"
) -> DataFrame:
    """Largest of several unit counts per key, ignoring the missing ones; keys of either table stay."""
    joined = full_lookup(observed, official, keys)
    return joined.select(*keys, *columns, F.greatest(*columns).alias(name))


def split_population(df: DataFrame, estimate: DataFrame, keys: Sequence[str], population: str, units: str, name: str) -> DataFrame:
    """Attach the unit estimate and an equal share of the population per unit."""
    joined = lookup(df, estimate, keys)
    return joined.withColumn(name, F.try_divide(F.col(population).cast("double"), F.col(units)))


def _with_gap(df: DataFrame, keys: Sequence[str], unit: str, units: str, inherit: Sequence[str]) -> DataFrame:
    """Add ``_gap``, on one row of each key: how many units of the estimate have no row there; 0 on the others.

    ``_m_<name>`` holds the value of ``units`` and of each ``inherit`` column, which are constant per key. Rows are dealt by
    key once, and read once.
    """
    order = W.partitionBy(*keys).orderBy(F.col(unit).asc_nulls_first())
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = df.withColumns({
        **{f"_m_{name}": F.max(name).over(every) for name in dict.fromkeys([units, *inherit])},
        "_observed": F.count(F.lit(1)).over(every),
        "_place": F.row_number().over(order),
    })
    gap = F.ceil(F.col(f"_m_{units}") - F.col("_observed")).cast("long")
    gap = F.when((F.col("_place") == 1) & (gap > 0), gap).otherwise(F.lit(0).cast("long"))
    return counted.withColumn("_gap", gap).drop("_observed", "_place")


def _silent(df: DataFrame, counted: DataFrame, own: Column, keys: Sequence[str], values: Mapping[str, Column]) -> list[Column]:
    """The columns of ``df`` for its own rows, and those of a silent unit for the others."""
    out = []
    for name in df.columns:
        value = values.get(name, F.lit(None).cast(counted.schema[name].dataType))
        out.append((F.col(name) if name in keys else F.when(own, F.col(name)).otherwise(value)).alias(name))
    return out


def pad_units(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    units: str,
    cases: str,
    inherit: Sequence[str] = (),
) -> DataFrame:
    """Append a zero-case row with no unit name for every unit that did not report.

    Adds ``pad``: 0 on observed rows, 1, 2, … on appended ones. One row of a key brings the
    appended ones with it, in chunks of ``ROWS_PER_CHUNK``, so the table is neither read twice nor joined with itself.
    """
    counted = _with_gap(df, keys, unit, units, inherit)
    chunk = F.lit(ROWS_PER_CHUNK).cast("long")
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_gap") / chunk))))
    start = F.col("_chunk") * chunk
    last = F.least(start + chunk - 1, F.col("_gap"))
    rows = chunks.withColumn("pad", F.explode(F.sequence(start, last)))
    values = {cases: F.lit(0.0), **{name: F.col(f"_m_{name}") for name in (units, *inherit)}}
    return rows.select(*_silent(df, counted, F.col("pad") == 0, keys, values), "pad")


def weigh_missing_units(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    units: str,
    cases: str,
    unit_population: str,
) -> DataFrame:
    """Same curve as ``pad_units`` with one row per key: all silent units at once, their population added up.

    Rows of equal rate lie on one straight piece of the curve, so a Gini index with
    its origin is the same as over single zero rows.
    """
    narrow = df.select(*keys, unit, cases, units, unit_population)
    counted = _with_gap(narrow, keys, unit, units, [unit_population])
    kinds = F.when(F.col("_gap") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    rows = counted.withColumn("_own", F.explode(kinds))
    values = {cases: F.lit(0.0), unit_population: F.col(f"_m_{unit_population}") * F.col("_gap")}
    return rows.select(*_silent(narrow, counted, F.col("_own"), keys, values)).drop(units)
