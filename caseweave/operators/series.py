"""Monthly and annual case series put together from several sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.functions.dates import month_start
from caseweave.functions.missing import rate, strict_greatest, strict_sum
from caseweave.operators.counting import count_by
from caseweave.operators.running import lookup

SERIES_COLUMNS = ["year", "month", "date", "province", "city", "case"]


def best_of_two(df: DataFrame, first: str, second: str, name: str = "case") -> DataFrame:
    """Larger of two reported totals; NULL when either is missing."""
    return df.withColumn(name, strict_greatest(first, second))


def monthly_counts(line: DataFrame) -> DataFrame:
    """Monthly district series counted from individual rows."""
    counts = count_by(line, ["year_dx", "month_dx", "province", "city"])
    return counts.select(
        F.col("year_dx").alias("year"),
        F.col("month_dx").alias("month"),
        month_start("year_dx", "month_dx").alias("date"),
        "province",
        "city",
        F.col("case").cast("double").alias("case"),
    )


def replace_years(sources: Mapping[str, DataFrame], source_of_year: Mapping[int, str], default: str) -> DataFrame:
    """One series from several, each year taken from one source only.

    Years not listed come from ``default``. Every source is filtered before the
    union, so a year is never read from two places.
    """
    parts = None
    for name, df in sources.items():
        wanted = [year for year, source in source_of_year.items() if source == name]
        keep = F.col("year").isin(wanted)
        if name == default:
            keep = keep | ~F.col("year").isin(list(source_of_year))
        part = df.filter(keep).withColumn("source", F.lit(name))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts


def annual_totals(df: DataFrame, year: str, province: str, cases: str) -> DataFrame:
    """Annual totals per province; one missing report makes the total missing."""
    return df.groupBy(F.col(year).alias("year"), F.col(province).alias("province")).agg(
        strict_sum(cases).cast("double").alias("total_case")
    )


def year_grid(population: DataFrame, totals: DataFrame) -> DataFrame:
    """Every (year, province) of the population table with its total, rate NULL where nothing was reported."""
    filled = lookup(population, totals, ["year", "province"])
    return filled.withColumn("api", rate("total_case", "pop"))


def monthly_rate(series: DataFrame, population: DataFrame, exclude_years: Sequence[int] = ()) -> DataFrame:
    """Monthly cases per 1000 of the annual population, by province."""
    monthly = series.groupBy("date", "province").agg(strict_sum("case").alias("case"))
    monthly = monthly.withColumn("year", F.year("date"))
    if exclude_years:
        monthly = monthly.filter(~F.col("year").isin(list(exclude_years)))
    return lookup(monthly, population, ["year", "province"]).withColumn("api", rate("case", "pop"))
