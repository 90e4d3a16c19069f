"""Spreading a mixed category over its parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING_RULES = ("strict", "lenient", "zero")


def category_counts(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    columns: Mapping[str, str],
    count: str | None = None,
) -> DataFrame:
    """Wide counts: one column per listed category, NULL where a cell has no row.

    ``columns`` maps output columns to categories. ``count`` names a column of
    counts when the rows are already aggregated. Rows of other categories still
    make their key combination appear.
    """
    cells = []
    for name, value in columns.items():
        hit = F.col(category) == F.lit(value)
        cell = F.sum(F.when(hit, F.col(count) if count else F.lit(1)))
        cells.append(cell.cast("double").alias(name))
    return df.groupBy(*keys).agg(*cells)


def split_mixed(
    wide: DataFrame,
    parts: Sequence[str],
    mixed: str,
    weight: float = 0.5,
    missing: str = "strict",
) -> DataFrame:
    """Add ``weight`` times the mixed count to every part of a wide count table.

    ``missing`` decides what an absent cell means: ``strict`` makes the result
    NULL, ``lenient`` reads an absent mixed count as 0, ``zero`` reads all as 0.
    """
    if missing not in MISSING_RULES:
        raise ValueError(f"missing must be one of {MISSING_RULES}")
    zero = F.lit(0.0)
    mixed_count = F.col(mixed) if missing == "strict" else F.coalesce(F.col(mixed), zero)
    filled = {}
    for part in parts:
        own = F.coalesce(F.col(part), zero) if missing == "zero" else F.col(part)
        filled[part] = own + mixed_count * F.lit(float(weight))
    return wide.withColumns(filled).drop(mixed)


def allocate_mixed(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    parts: Sequence[str],
    mixed: str,
    weight: float = 0.5,
    missing: str = "strict",
    value: str = "case",
    count: str | None = None,
) -> DataFrame:
    """Long counts of the parts after allocation: one row per key combination and part.

    Only key combinations with at least one part or mixed row appear. They are
    selected after counting: a filter before it would make Spark evaluate a computed
    category twice per row, and counting is done before the shuffle anyway.
    """
    columns = {f"_p{i}": part for i, part in enumerate(parts)} | {"_mixed": mixed}
    wide = category_counts(df, keys, category, columns, count)
    wide = wide.filter(F.coalesce(*columns).isNotNull())
    wide = split_mixed(wide, [f"_p{i}" for i in range(len(parts))], "_mixed", weight, missing)
    return to_long(wide, keys, {f"_p{i}": part for i, part in enumerate(parts)}, category, value)


def to_long(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], name: str, value: str) -> DataFrame:
    """Wide to long; ``columns`` maps each value column to its label. NULL cells stay."""
    cells = F.array(*[
        F.struct(F.lit(label).alias(name), F.col(column).alias(value)) for column, label in columns.items()
    ])
    return df.select(*keys, F.inline(cells))
