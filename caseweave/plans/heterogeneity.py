"""Lorenz curves, Gini indices and their intervals across districts and health units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave import codebooks as cb
from caseweave.functions.missing import rate
from caseweave.functions.recode import bin_by, level_of
from caseweave.operators import concentration, regions, resample, units
from caseweave.operators.allocate import allocate_mixed
from caseweave.operators.counting import count_by
from caseweave.operators.running import lookup
from caseweave.plans.incidence import PARTS
from caseweave.session import stored
from caseweave.sources.sizing import broadcast_if_few

STRATA = ["year_dx", "province", "sp"]
DISTRICT = ["year_dx", "province", "city"]


def district_rates(line: DataFrame, population: DataFrame) -> DataFrame:
    """Cases, population and rate by (year, province, city, species); mixed cases split, absent counts 0."""
    counts = allocate_mixed(line, DISTRICT, "sp", PARTS, cb.MIXED, missing="zero")
    joined = lookup(counts, population, DISTRICT).withColumnRenamed("n", "pop")
    return joined.withColumn("api", rate("case", "pop"))


def count_units(line: DataFrame) -> DataFrame:
    """Cases ``n_case`` by (year, province, city, unit, species)."""
    return count_by(line, [*DISTRICT, "health_unit", "sp"], "n_case")


def unit_counts(line: DataFrame) -> DataFrame:
    """Cases ``n_case`` by (year, province, city, unit, species).

    All unit-level results start from this table. It is kept in the shared folder, so
    that the line list is read once however many of them are wanted.
    """
    return stored(count_units(line))[0]


def unit_estimate(counts: DataFrame, official: DataFrame) -> DataFrame:
    """Units per (province, city): the largest of the counts observed in each year and the official one (``n_hu_web``).

    Run once and broadcast where its rows are few, as the two keys would deal unit rows unevenly.
    """
    place = ["province", "city"]
    observed = units.distinct_units_of(
        counts, place, "health_unit", "year_dx", {2020: "n_hu_obs20", 2019: "n_hu_obs19"}
    )
    return broadcast_if_few(units.estimate_units(observed, official, place, ["n_hu_obs20", "n_hu_web", "n_hu_obs19"]))


def unit_rates(counts: DataFrame, population: DataFrame, estimate: DataFrame) -> DataFrame:
    """Cases and rate per (year, province, city, unit, species) with the population shared equally among units."""
    keys = [*DISTRICT, "health_unit"]
    spread = allocate_mixed(counts, keys, "sp", PARTS, cb.MIXED, missing="zero", value="case_hu", count="n_case")
    joined = lookup(spread, broadcast_if_few(population), DISTRICT).withColumnRenamed("n", "pop_city")
    joined = units.split_population(
        joined, estimate.select("province", "city", "n_hu"), ["province", "city"], "pop_city", "n_hu", "pop_hu"
    )
    return joined.withColumn("api_hu", rate("case_hu", "pop_hu"))


def padded_unit_rates(rates: DataFrame) -> DataFrame:
    """Unit rates with a zero row for every unit that reported nothing."""
    padded = units.pad_units(
        rates, [*DISTRICT, "sp"], "health_unit", "n_hu", "case_hu", inherit=["pop_city", "pop_hu"]
    )
    return padded.withColumn("api_hu", rate("case_hu", "pop_hu"))


def lorenz_districts(rates: DataFrame) -> DataFrame:
    return concentration.lorenz(rates, STRATA, "case", "pop", ["city"])


def lorenz_units(padded: DataFrame, block_rows: int | None = None) -> DataFrame:
    return concentration.lorenz(
        padded, STRATA, "case_hu", "pop_hu", ["city", "health_unit", "pad"], block_rows=block_rows
    )


def gini_districts(rates: DataFrame) -> DataFrame:
    return concentration.gini(rates, STRATA, "case", "pop", ["city"])


def gini_units(rates: DataFrame) -> DataFrame:
    """Gini index across units, silent ones included without a row each."""
    weighed = units.weigh_missing_units(rates, [*DISTRICT, "sp"], "health_unit", "n_hu", "case_hu", "pop_hu")
    return concentration.gini(weighed, STRATA, "case_hu", "pop_hu")


def bootstrap_districts(rates: DataFrame, **options) -> DataFrame:
    return resample.bootstrap_gini(rates, STRATA, "case", "pop", ["city"], **options)


def bootstrap_units(padded: DataFrame, **options) -> DataFrame:
    return resample.bootstrap_gini(padded, STRATA, "case_hu", "pop_hu", ["city", "health_unit", "pad"], **options)


def gini_per_district(
    counts: DataFrame, population: DataFrame, estimate: DataFrame, origin: bool = True
) -> DataFrame:
    """Gini index across the units of each district, all species together, with the district rate.

    ``origin=False`` leaves out the piece before the first unit, as the published figures do.
    """
    population = broadcast_if_few(population)
    totals = counts.groupBy(*DISTRICT, "health_unit").agg(F.sum("n_case").cast("double").alias("case"))
    joined = lookup(totals, population, DISTRICT).withColumnRenamed("n", "pop_city")
    shared = units.split_population(
        joined, estimate.select("province", "city", "n_hu"), ["province", "city"], "pop_city", "n_hu", "pop"
    )
    # Units of a district share its population equally, so silent ones can only come last on the curve.
    weighed = units.weigh_missing_units(shared, DISTRICT, "health_unit", "n_hu", "case", "pop")
    index = concentration.gini(weighed, DISTRICT, "case", "pop", ["health_unit"], origin=origin, total="case")
    index = index.withColumn("case", F.col("case").cast("long"))
    rated = lookup(index, population, DISTRICT).withColumn("api", rate("case", "n"))
    return rated.select(*DISTRICT, "g", "case", "api")


def pareto_units(line: DataFrame, species: str, strata: Sequence[str] = ("year_dx",)) -> DataFrame:
    """Health units by descending number of cases of one species, pure or mixed."""
    rows = line.filter(F.col("sp").isin(species, cb.MIXED))
    return concentration.pareto(rows, "health_unit", strata)


def region_rate_class(
    rates: DataFrame, map_regions: DataFrame, vertices: DataFrame, year: int, highest_first: bool = False
) -> DataFrame:
    """Outline vertices with the rate class of their region in one year and the position of the class (``api_ord``)."""
    levels = cb.MAP_RATE_CLASSES[::-1] if highest_first else cb.MAP_RATE_CLASSES
    values = rates.filter(F.col("year_dx") == year).select(F.col("city").alias("NAME_2"), "api")
    attributes = regions.attach_to_regions(values, map_regions, "NAME_2")
    drawn = regions.attach_to_outlines(vertices, attributes, "id")
    drawn = regions.with_class(drawn, bin_by("api", cb.MAP_RATE_BREAKS, cb.MAP_RATE_CLASSES), "api_cat")
    return drawn.withColumn("api_ord", level_of("api_cat", levels))


def region_gini_class(index: DataFrame, map_regions: DataFrame, vertices: DataFrame, year: int) -> DataFrame:
    """Outline vertices with the Gini class of their region in one year and its position, highest first (``gini_ord``)."""
    values = index.filter(F.col("year_dx") == year).select(F.col("city").alias("NAME_2"), "g")
    attributes = regions.attach_to_regions(values, map_regions, "NAME_2")
    drawn = regions.attach_to_outlines(vertices, attributes, "id")
    drawn = regions.with_class(drawn, bin_by("g", cb.GINI_BREAKS, cb.GINI_CLASSES), "gini_cat")
    return drawn.withColumn("gini_ord", level_of("gini_cat", cb.GINI_CLASSES[::-1]))
