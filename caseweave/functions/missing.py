"""Arithmetic in which a missing value stays missing instead of being skipped or raising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_sum(value: Column | str) -> Column:
    """Aggregate sum that is NULL as soon as one row of the group is NULL."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))


def strict_greatest(*values: Column | str) -> Column:
    """Largest value of the row, NULL if any of them is NULL."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    anything_missing = columns[0].isNull()
    for column in columns[1:]:
        anything_missing = anything_missing | column.isNull()
    return F.when(~anything_missing, F.greatest(*columns))


def rate(cases: Column | str, population: Column | str, per: float = 1000.0) -> Column:
    """Cases per ``per`` persons; NULL when the population is zero or missing."""
    cases = F.col(cases) if isinstance(cases, str) else cases
    population = F.col(population) if isinstance(population, str) else population
    return F.try_divide(cases.cast("double"), population.cast("double")) * F.lit(float(per))


def share_where(condition: Column) -> Column:
    """Aggregate share of rows that meet ``condition``; unknown counts as not met, all rows as the base."""
    return F.count_if(condition) / F.count(F.lit(1))
