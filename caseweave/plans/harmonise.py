"""The monthly district series put together from three sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave import codebooks as cb
from caseweave.functions.dates import month_start
from caseweave.functions.recode import title_case
from caseweave.operators import series
from caseweave.plans.cleaning import rename_province
from caseweave.sources.tables import fixed_table

SOURCE_OF_YEAR = {2018: "parts", 2019: "line", 2020: "line"}


def reported_series(aggregate: DataFrame) -> DataFrame:
    """Reported monthly totals: the larger of the totals by sex and by species."""
    best = series.best_of_two(aggregate, "POS_GENDER_TOTAL", "POS_SPECIES_TOTAL")
    return best.select(
        F.col("YEAR").alias("year"),
        F.col("MONTH").alias("month"),
        month_start("YEAR", "MONTH").alias("date"),
        title_case("ADMIN1").alias("province"),
        title_case("ADMIN2").alias("city"),
        F.col("case").cast("double").alias("case"),
    ).withColumn("province", rename_province("province"))


def part_series(parts: DataFrame, year: int = 2018) -> DataFrame:
    """Series from twelve month tables; a blank count is 0."""
    known = parts.filter(F.col("Provinsi").isin(cb.PROVINCES))
    return known.select(
        F.lit(year).alias("year"),
        F.col("month").cast("int").alias("month"),
        month_start(F.lit(year), "month").alias("date"),
        F.col("Provinsi").alias("province"),
        title_case("`Kabupaten/Kota`").alias("city"),
        F.coalesce(F.col("Positif"), F.lit(0.0)).alias("case"),
    ).withColumn("province", rename_province("province"))


def harmonised_series(line: DataFrame, aggregate: DataFrame, parts: DataFrame) -> DataFrame:
    """One monthly series: reported totals, with 2018 from the month tables and later years from the line list."""
    sources = {
        "reported": reported_series(aggregate),
        "parts": part_series(parts),
        "line": series.monthly_counts(line),
    }
    return series.replace_years(sources, SOURCE_OF_YEAR, "reported")


def province_population(spark) -> DataFrame:
    """Published population by (year, province)."""
    return fixed_table(spark, cb.province_population_rows(), "year INT, province STRING, pop DOUBLE")


def annual_series(aggregate: DataFrame, population: DataFrame) -> DataFrame:
    """Reported total and rate for every (year, province) of the population table."""
    best = series.best_of_two(aggregate, "POS_GENDER_TOTAL", "POS_SPECIES_TOTAL")
    totals = series.annual_totals(best, "YEAR", "ADMIN1", "case")
    named = totals.withColumn("province", title_case("province"))
    named = named.withColumn("province", rename_province("province"))
    return series.year_grid(population, named)
