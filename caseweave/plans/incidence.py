"""Incidence by month, age, sex, species and district."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave import codebooks as cb
from caseweave.functions.dates import month_axis, month_label, month_start
from caseweave.functions.missing import rate, strict_sum
from caseweave.functions.recode import bin_by, level_of, pair_label, recode, recode_or, title_case
from caseweave.operators.allocate import allocate_mixed, category_counts, split_mixed, to_long
from caseweave.operators.counting import count_by, shares_by
from caseweave.operators.running import lookup
from caseweave.sources.tables import fixed_table

PARTS = [cb.PF, cb.PV]


def weekly_vivax_share(line: DataFrame) -> DataFrame:
    """Share of vivax among allocated cases per (year, province, ISO week)."""
    keys = ["year_dx", "province", "week_dx"]
    wide = category_counts(line, keys, "sp", {"pf": cb.PF, "pv": cb.PV, "mixed": cb.MIXED, "other": cb.OTHER})
    split = split_mixed(wide, ["pf", "pv"], "mixed", missing="lenient")
    everything = F.col("pf") + F.col("pv") + F.coalesce("other", F.lit(0.0))
    return split.select(*keys, F.try_divide("pv", everything).alias("prop_pv"))


def with_month_ticks(weekly: DataFrame, year: int = 2020) -> DataFrame:
    """Weekly rows with the month that begins in their week of a 52-week axis and its exact position, NULL elsewhere."""
    ticks = weekly.sparkSession.range(1).select(F.inline(month_axis(year))).select(
        F.floor("week_position").cast("int").alias("week_dx"), month_label("month").alias("month_label"), "week_position"
    )
    return weekly.join(F.broadcast(ticks), "week_dx", "left")


def species_levels(line: DataFrame) -> DataFrame:
    """Cases by species and sex with the positions of the species and of the pair in their display orders."""
    named = count_by(line, ["sp", "sex"]).withColumn("cat", pair_label("sex", "sp", cb.SEX_SPECIES))
    return named.withColumns({
        "sp_ord": level_of("sp", cb.SPECIES_LEVELS), "cat_ord": level_of("cat", list(cb.SEX_SPECIES.values())),
    })


def two_species_series(line: DataFrame) -> DataFrame:
    """Monthly counts of the two species by (province, sex), mixed cases split strictly, rows with gaps dropped."""
    keys = ["province", "year_dx", "month_dx", "sex"]
    known = line.dropna(subset=keys)
    counts = allocate_mixed(known, keys, "sp", PARTS, cb.MIXED, missing="strict", value="n_case")
    return counts.select(
        "province",
        "year_dx",
        month_start("year_dx", "month_dx").alias("date"),
        "sex",
        "sp",
        "n_case",
        pair_label("sex", "sp", cb.SEX_SPECIES).alias("cat"),
    )


def monthly_sex_incidence(two_species: DataFrame, population: DataFrame) -> DataFrame:
    """Monthly cases per 1000 of the annual population of that sex; ``population`` has (province, year_dx, sex, pop)."""
    joined = lookup(two_species, population, ["province", "year_dx", "sex"])
    return joined.withColumn("monthly_perk", rate("n_case", "pop")).drop("pop")


def province_sex_population(spark) -> DataFrame:
    """Published population by (province, year, sex)."""
    return fixed_table(spark, cb.province_sex_rows(), "province STRING, year_dx INT, sex STRING, pop DOUBLE")


def age_sex_rate(line: DataFrame, place: str, population: DataFrame, year: int) -> DataFrame:
    """Annual rate by (place, age band, sex, species) in one year; ``population`` has (place, sex, age_cat, pop)."""
    keys = [place, "age_cat", "sex"]
    counts = allocate_mixed(
        line.filter(F.col("year_dx") == year), keys, "sp", PARTS, cb.MIXED, missing="lenient", value="annual_case"
    )
    joined = lookup(counts, population, keys)
    return joined.withColumns({
        "api": rate("annual_case", "pop"),
        "cat": pair_label("sex", "sp", cb.SEX_SPECIES),
    })


def province_age_population(spark) -> DataFrame:
    """Published population by (province, sex, age band)."""
    return fixed_table(spark, cb.province_age_rows(), "province STRING, sex STRING, age_cat STRING, pop DOUBLE")


def district_age_population(spark) -> DataFrame:
    """Published population of three districts by (city, sex, age band)."""
    return fixed_table(spark, cb.district_age_rows(), "city STRING, sex STRING, age_cat STRING, pop DOUBLE")


def district_sex_population(spark) -> DataFrame:
    """Published population of three districts by (city, sex)."""
    return fixed_table(spark, cb.district_sex_rows(), "city STRING, sex STRING, pop DOUBLE")


def plotted_age_rates(rates: DataFrame) -> DataFrame:
    """Rates as drawn: unknown rates as 0, rows without sex or age band left out."""
    return rates.withColumn("api", F.coalesce("api", F.lit(0.0))).dropna(subset=["sex", "age_cat"])


def district_month_incidence(
    line: DataFrame, population: DataFrame, districts: Sequence[str] = cb.FOCUS_DISTRICTS, year: int = 2020
) -> DataFrame:
    """Monthly rate by (district, sex, species) of some districts in one year; unknown rates are 0 in ``api``."""
    keys = ["city", "month_dx", "sex"]
    rows = line.filter((F.col("year_dx") == year) & F.col("city").isin(list(districts))).dropna(subset=["sex"])
    counts = allocate_mixed(rows, keys, "sp", PARTS, cb.MIXED, missing="lenient", value="n_case")
    joined = lookup(counts, population, ["city", "sex"])
    perk = rate("n_case", "pop")
    return joined.select(
        "city", "month_dx", "sex", "sp", pair_label("sex", "sp", cb.SEX_SPECIES).alias("cat"), "n_case",
        perk.alias("monthly_perk"), F.coalesce(perk, F.lit(0.0)).alias("api"),
    )


def district_api(line: DataFrame, population: DataFrame) -> DataFrame:
    """Annual cases per 1000 by (year, province, city), counted before the population is joined."""
    keys = ["year_dx", "province", "city"]
    joined = lookup(count_by(line, keys), population, keys).withColumnRenamed("n", "pop")
    return joined.withColumn("api", rate("case", "pop"))


def district_api_class(line: DataFrame, population: DataFrame) -> DataFrame:
    """District rate with its class."""
    return district_api(line, population).withColumn("api_cat", bin_by("api", cb.RATE_CLASS_BREAKS, cb.RATE_CLASSES))


def district_profile(line: DataFrame, population: DataFrame) -> DataFrame:
    """Share of males, adults and vivax (pure or mixed) with the rate of the district, in one pass."""
    keys = ["year_dx", "province", "city"]
    shares = shares_by(line, keys, {
        "male_prop": F.col("sex") == cb.MALE,
        "adult_prop": F.col("age") >= cb.ADULT_AGE,
        "vivax_prop": F.col("sp").isin(cb.PV, cb.MIXED),
    })
    joined = lookup(shares, population, keys).withColumnRenamed("n", "pop")
    return joined.withColumn("api", rate("case", "pop"))


def survey_area(name_province: str, name_district: str):
    """Condition on raw upper-case names: two whole provinces and some districts of a third."""
    return F.col(name_province).isin(cb.SURVEY_PROVINCES) | (
        (F.col(name_province) == cb.SURVEY_EXTRA_PROVINCE) & F.col(name_district).isin(cb.SURVEY_EXTRA_DISTRICTS)
    )


def coarse_age_population(age_population: DataFrame, admin: DataFrame, years: Sequence[int] = cb.STUDY_YEARS) -> DataFrame:
    """Population by (province, district, year, coarse age band), summed strictly over its five-year bands."""
    places = admin.filter(survey_area("ADMIN1", "ADMIN2")).select(
        F.col("IDADMIN2").alias("iddist"),
        title_case("ADMIN1").alias("province"),
        title_case("ADMIN2").alias("district"),
    )
    bands = {band: cb.coarse_band_of(band) for band in cb.AGE_BANDS}
    people = age_population.filter(F.col("YEAR").isin(list(years))).select(
        F.col("IDADMIN2").alias("iddist"),
        F.col("YEAR").alias("year"),
        recode("`AGE.GROUP`", bands).alias("age_cat"),
        F.col("POP").alias("pop"),
    )
    return (
        people.join(places, "iddist")
        .groupBy("province", "district", "year", "age_cat")
        .agg(strict_sum("pop").alias("pop"))
    )


def age_structured_api(raw: DataFrame, population: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Rate by (province, district, year, coarse age band, species), mixed cases counted for both species.

    Works on the raw line list and its reported year. Cells without a case are left
    out unless ``keep_zero`` is set.
    """
    keys = ["province", "district", "year", "age_cat"]
    codes = cb.COARSE_SPECIES_CODES
    rows = raw.filter(F.col("tahun").isin(cb.STUDY_YEARS) & survey_area("nama_propinsi", "nama_kabupaten"))
    # Age and species are cut down to a few codes before rows are counted; names are title-cased after it.
    counts = rows.groupBy(
        "nama_propinsi",
        "nama_kabupaten",
        F.col("tahun").alias("year"),
        bin_by("umur_th", cb.COARSE_AGE_BREAKS, cb.COARSE_AGE_BANDS).alias("age_cat"),
        recode_or("parasit", codes, cb.OTHER).alias("sp"),
    ).agg(F.count(F.lit(1)).alias("cases"))
    counts = counts.select(
        title_case("nama_propinsi").alias("province"),
        title_case("nama_kabupaten").alias("district"),
        "year", "age_cat", "sp", "cases",
    )
    wide = category_counts(counts, keys, "sp", {"pf": cb.PF, "pv": cb.PV, "mixed": "Mixed"}, count="cases")
    if keep_zero:
        cells = population.select(*keys).unionByName(wide.select(*keys)).distinct()
        wide = lookup(cells, wide, keys)
    joined = lookup(wide, population, keys)
    split = split_mixed(joined, ["pf", "pv"], "mixed", weight=1.0, missing="zero")
    long = to_long(split, [*keys, "pop"], {"pf": cb.PF, "pv": cb.PV}, "sp", "cases")
    return long.withColumn("api", rate("cases", "pop"))
