"""Make-up of the cases: type of unit, severity and occupation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave import codebooks as cb
from caseweave.functions.missing import rate
from caseweave.functions.recode import level_of
from caseweave.operators.counting import composition, count_by, order_by_mean, order_by_median
from caseweave.operators.running import lookup
from caseweave.session import pin


def unit_type_mix(line: DataFrame) -> DataFrame:
    """Share of each unit type by (year, province, city), districts numbered by their mean type score.

    The score is the alphabetical position of the type, taken over all years.
    """
    bars = ["year_dx", "province", "city"]
    counts = pin(count_by(line, [*bars, "hu_type"]))
    mix = composition(counts, bars, "hu_type")
    order = order_by_mean(counts, "city", level_of("hu_type", cb.UNIT_TYPES), "case")
    return lookup(mix, order.select("city", "ord"), ["city"])


def severity_mix(line: DataFrame) -> DataFrame:
    """Share of each severity by (year, province, unit type); unknown severity is a share too."""
    bars = ["year_dx", "province", "hu_type"]
    mix = composition(count_by(line, [*bars, "severe"]), bars, "severe")
    return mix.withColumn("ord", level_of("hu_type", cb.UNIT_TYPES_DISPLAY))


def occupation_mix(line: DataFrame, population: DataFrame, year: int = 2020) -> DataFrame:
    """Share of each occupation among adults by (province, city), districts numbered by their median rate.

    Everything comes from one count table, so the line list is read once and nothing
    is joined to single rows.
    """
    keys = ["year_dx", "province", "city"]
    rows = line.filter(F.col("year_dx") == year)
    adult = F.coalesce(F.col("age") >= cb.ADULT_AGE, F.lit(False))
    counts = pin(count_by(rows.withColumn("adult", adult), [*keys, "occupation", "adult"]))
    places = counts.groupBy(*keys).agg(
        F.sum("case").alias("case"), F.sum(F.when(F.col("adult"), F.col("case"))).alias("adults")
    )
    rates = lookup(places, population, keys).withColumn("api", rate("case", "n"))
    order = order_by_median(rates.filter("adults > 0"), "city", "api", "adults")
    mix = composition(counts.filter("adult"), ["province", "city"], "occupation")
    return lookup(mix, order.select("city", "ord"), ["city"])
