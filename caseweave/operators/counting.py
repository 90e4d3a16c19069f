"""Counts, shares and orders of categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.functions.missing import share_where
from caseweave.operators.running import running_totals


def count_by(df: DataFrame, keys: Sequence[str], name: str = "case") -> DataFrame:
    """Rows per key combination; NULL is a key like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_with_constant(
    df: DataFrame, keys: Sequence[str], constants: Mapping[str, str], name: str = "case"
) -> DataFrame:
    """Rows per key combination with attributes that are constant within it.

    ``constants`` maps output to input columns. An attribute that is not constant
    fans the combination out into one row per value, each with the full count.
    """
    totals = df.groupBy(*keys, *constants.values()).agg(F.count(F.lit(1)).alias("_n"))
    return totals.select(
        *keys,
        F.sum("_n").over(W.partitionBy(*keys)).alias(name),
        *[F.col(source).alias(target) for target, source in constants.items()],
    )


def shares_by(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Row count and the share of rows that meet each condition, in one pass."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("case"),
        *[share_where(condition).alias(name) for name, condition in conditions.items()],
    )


def composition(counts: DataFrame, bars: Sequence[str], category: str, count: str = "case") -> DataFrame:
    """Share of each category within a bar, from counts by bar and category; NULL is a category."""
    per_bar = counts.groupBy(*bars, category).agg(F.sum(count).alias("case"))
    return per_bar.withColumn("share", F.col("case") / F.sum("case").over(W.partitionBy(*bars)))


def order_by_mean(df: DataFrame, category: str, score: Column, weight: str | None = None) -> DataFrame:
    """Categories numbered by the mean of a score, lowest first; ties by name.

    ``weight`` holds the number of rows a row stands for.
    """
    rows = F.col(weight) if weight else F.lit(1)
    mean = F.try_divide(F.sum(score * rows), F.sum(F.when(score.isNotNull(), rows)))
    means = df.filter(F.col(category).isNotNull()).groupBy(category).agg(mean.alias("score"))
    return _numbered(means, category)


def order_by_median(df: DataFrame, category: str, value: str, weight: str | None = None) -> DataFrame:
    """Categories numbered by the median of a value, lowest first; ties by name.

    ``weight`` holds the number of rows a row stands for, so that the median over
    patients can be taken from counts.
    """
    value_col = F.col(value)
    median = F.percentile(value_col, 0.5) if weight is None else F.percentile(value_col, 0.5, F.col(weight))
    medians = df.filter(F.col(category).isNotNull()).groupBy(category).agg(median.alias("score"))
    return _numbered(medians, category)


def _numbered(scores: DataFrame, category: str) -> DataFrame:
    ordered = running_totals(
        scores, [], [F.col("score").asc_nulls_last(), F.col(category).asc()], {"ord": F.lit(1)}
    )
    return ordered.select(category, "score", F.col("ord").cast("long").alias("ord"))
