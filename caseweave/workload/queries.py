"""Registered queries: name -> function of (spark, folder of the benchmark tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave import codebooks as cb
from caseweave.functions import dates, missing, recode
from caseweave.operators import allocate, checks, concentration, counting, regions, resample, series, smoothing, units
from caseweave.operators.running import lookup
from caseweave.plans import cleaning, harmonise, heterogeneity, incidence, profile
from caseweave.session import new_table_path, stored
from caseweave.sources import tables
from caseweave.sources.schemas import MONTH_PART, POPULATION_PAPUA, POPULATION_WEST_PAPUA, UNIT_TABLE
from caseweave.workload import inputs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
DISTRICT = heterogeneity.DISTRICT
CHECK_REPLICATES = 10_000
CHECK_SEED = 13
UNIT_BUCKETS = ["province", "city", "health_unit"]


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as BIGINT and fractions rounded, so that results can be compared by value."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # Adding 0 turns a rounded -0.0 into 0.0.
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        columns.append(column.alias(field.name, metadata=field.metadata))
    return df.select(*columns)


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = lambda spark, sf_dir: plain(function(spark, sf_dir))
    return function


def sorted_query(*order: str) -> Callable[[Query], Query]:
    """Register a result table that comes sorted; the sort is by ranges, so no task holds the table."""
    def register(function: Query) -> Query:
        REGISTRY[function.__name__] = lambda spark, sf_dir: plain(function(spark, sf_dir).orderBy(*order))
        return function
    return register


# --- Cleaning -----------------------------------------------------------------


@query
def cleaned_line_list(spark, sf_dir):
    line, people = inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir)
    return cleaning.labelled(cleaning.attach_population(line, people))


@query
def labelled_columns(spark, sf_dir):
    """Every column with its label, as the schema of the cleaned table carries it, and in how many rows it is known."""
    line = plain(cleaned_line_list(spark, sf_dir))
    labels = tables.labels_of(line)
    known = line.agg(*[F.count(column).alias(column) for column in labels])
    return known.unpivot([], list(labels), "column", "known").withColumn("label", recode.recode("column", labels))


@query
def rejects_observed(spark, sf_dir):
    """Rows by what the cleaning did with them, counted by the write of the cleaned table itself."""
    counted = Observation()
    line = cleaning.clean_line_list(inputs.raw_line_list(spark, sf_dir), observed=counted)
    line.write.parquet(new_table_path(spark, "line"))
    return tables.fixed_table(spark, list(counted.get.items()), "reason STRING, rows BIGINT")


@query
def rejects_by_reason(spark, sf_dir):
    return counting.count_by(cleaning.rejected_rows(inputs.raw_line_list(spark, sf_dir)), ["reason", "year_dx"], "rows")


@query
def date_repair(spark, sf_dir):
    raw = inputs.raw_line_list(spark, sf_dir)
    repaired = raw.select("id", "tglkun", dates.repair_date("tglkun", "tahun", "bulankun").alias("date_dx"))
    return repaired.select(
        "id",
        "date_dx",
        F.weekofyear("date_dx").alias("week"),
        dates.month_label(F.month("date_dx")).alias("month_label"),
        dates.parse_dmy("tglkun").isNull().alias("repaired"),
    )


@query
def recode_by_vintage(spark, sf_dir):
    rows = cleaning.recoded(inputs.raw_line_list(spark, sf_dir))
    return counting.count_by(rows, ["year_dx", "sp", "sex"])


@query
def recode_dictionaries(spark, sf_dir):
    raw = inputs.raw_line_list(spark, sf_dir)
    rows = raw.select(
        recode.recode("derajat", cb.SEVERITY_CODES).alias("severe"),
        recode.recode("lab", cb.LAB_CODES).alias("lab"),
        recode.recode("pekerjaan", cb.OCCUPATION_CODES).alias("occupation"),
        recode.recode_or("parasit", cb.COARSE_SPECIES_CODES, cb.OTHER).alias("coarse_sp"),
    )
    return counting.count_by(rows, ["severe", "lab", "occupation", "coarse_sp"])


@query
def classify_text(spark, sf_dir):
    raw = inputs.raw_line_list(spark, sf_dir)
    rows = raw.select(
        "nama_fasyankes",
        recode.title_case("nama_fasyankes").alias("health_unit"),
        recode.classify("nama_fasyankes", cb.FACILITY_RULES, "Other").alias("hu_type"),
        recode.classify("p_rawat", cb.ADMISSION_RULES).alias("adm_stat"),
        recode.classify("kematian", cb.DEATH_RULES).alias("death"),
    )
    return counting.count_by(rows, ["health_unit", "hu_type", "adm_stat", "death"])


@query
def bin_ages(spark, sf_dir):
    raw = inputs.raw_line_list(spark, sf_dir)
    fine = recode.bin_by("umur_th", cb.AGE_BREAKS, cb.AGE_BANDS)
    rows = raw.select(
        fine.alias("age_cat"),
        recode.level_of(fine, cb.AGE_BANDS).alias("ord"),
        recode.bin_by("umur_th", cb.COARSE_AGE_BREAKS, cb.COARSE_AGE_BANDS).alias("coarse_age_cat"),
    )
    return counting.count_by(rows, ["age_cat", "ord", "coarse_age_cat"])


@query
def title_case_places(spark, sf_dir):
    customers = inputs.table(spark, sf_dir, "customer")
    return customers.select(
        "c_custkey",
        recode.title_case(F.concat_ws("-", "c_mktsegment", "c_name")).alias("title"),
        recode.drop_suffix("c_name", 3).alias("stem"),
    )


@query
def stored_line_list_by_year(spark, sf_dir):
    """Store the cleaned line list by year, read one year back, label it and count."""
    path = new_table_path(spark, "line_list")
    tables.write_table(inputs.line_list(spark, sf_dir), path, ["year_dx"])
    line = cleaning.labelled(tables.read_table(spark, path, [2020]))
    return counting.count_by(line, ["year_dx", "province", "sp"])


@query
def month_parts_by_file(spark, sf_dir):
    """Write the twelve month tables as files and read them back in one scan, the month taken from the file."""
    path = new_table_path(spark, "month_parts")
    parts = inputs.month_parts(spark, sf_dir).drop("month").hint("rebalance", "part")
    parts.write.partitionBy("part").option("header", True).csv(path)
    names = inputs.MONTH_PARTS
    read = tables.read_month_parts(spark, [f"{path}/part={name}" for name in names], MONTH_PART, names)
    return read.select(
        "month", F.col("Provinsi").alias("province"), F.col("Kabupaten/Kota").alias("city"), F.col("Positif").alias("case")
    )


@sorted_query("year_dx", "province", "city")
def population_from_sheets(spark, sf_dir):
    """District population from two wide text tables with heading and total rows."""
    papua, west_papua = inputs.population_sheets(spark, sf_dir)
    return tables.population_by_year(papua, west_papua, inputs.study_cities(spark, sf_dir))


def _through_csv(spark, df, name, schema):
    """Write a table as CSV files and read them back with a fixed schema."""
    path = new_table_path(spark, name)
    df.write.option("header", True).csv(path)
    return tables.read_csv(spark, path, schema)


@sorted_query("year_dx", "province", "city")
def population_from_files(spark, sf_dir):
    """The same from CSV files."""
    papua, west_papua = inputs.population_sheets(spark, sf_dir)
    papua = _through_csv(spark, papua, "population_a", POPULATION_PAPUA)
    west_papua = _through_csv(spark, west_papua, "population_b", POPULATION_WEST_PAPUA)
    return tables.population_by_year(papua, west_papua, inputs.study_cities(spark, sf_dir))


@query
def official_units_from_file(spark, sf_dir):
    """Official unit counts from one CSV table for each province, which end in a total."""
    official, parts = inputs.official_units(spark, sf_dir), {}
    for i, province in enumerate(cb.OFFICIAL_DISTRICTS):
        body = official.filter(F.col("province") == province)
        total = body.agg(F.lit("Jumlah").alias("city"), F.sum("n_hu_web").alias("n_hu_web"))
        sheet = body.select("city", "n_hu_web").unionByName(total)
        parts[province] = _through_csv(spark, sheet.toDF("Nama Kab/Kota", "Jumlah Unit"), f"units_{i}", UNIT_TABLE)
    return tables.official_units(parts, inputs.study_cities(spark, sf_dir))


# --- Missing values, reshaping, allocation --------------------------------------


@query
def strict_sum_by_year(spark, sf_dir):
    reported = inputs.aggregate_series(spark, sf_dir)
    return reported.groupBy("YEAR", "ADMIN2").agg(
        missing.strict_sum("POS_GENDER_TOTAL").alias("strict_total"), F.sum("POS_GENDER_TOTAL").alias("known_total")
    )


@query
def strict_greatest_rows(spark, sf_dir):
    reported = series.best_of_two(inputs.aggregate_series(spark, sf_dir), "POS_GENDER_TOTAL", "POS_SPECIES_TOTAL")
    return reported.select("YEAR", "MONTH", "ADMIN1", "ADMIN2", "case", F.greatest("POS_GENDER_TOTAL", "POS_SPECIES_TOTAL").alias("known_case"))


def _wide_species(spark, sf_dir):
    return allocate.category_counts(
        inputs.line_list(spark, sf_dir), [*DISTRICT, "month_dx", "sex"], "sp",
        {"pf": cb.PF, "pv": cb.PV, "mixed": cb.MIXED, "other": cb.OTHER},
    )


@query
def pivot_species(spark, sf_dir):
    return _wide_species(spark, sf_dir)


@query
def unpivot_species(spark, sf_dir):
    labels = {"pf": cb.PF, "pv": cb.PV, "mixed": cb.MIXED, "other": cb.OTHER}
    return allocate.to_long(_wide_species(spark, sf_dir), [*DISTRICT, "month_dx", "sex"], labels, "sp", "case")


def _allocated(rule: str, weight: float) -> Query:
    def run(spark, sf_dir):
        return allocate.allocate_mixed(
            inputs.line_list(spark, sf_dir), [*DISTRICT, "month_dx", "sex", "age_cat"], "sp",
            [cb.PF, cb.PV], cb.MIXED, weight=weight, missing=rule,
        )
    return run


for _name, _rule, _weight in (
    ("allocate_strict", "strict", 0.5), ("allocate_lenient", "lenient", 0.5),
    ("allocate_zero", "zero", 0.5), ("allocate_full", "zero", 1.0),
):
    REGISTRY[_name] = (lambda run: lambda spark, sf_dir: plain(run(spark, sf_dir)))(_allocated(_rule, _weight))


@query
def union_by_name(spark, sf_dir):
    """Unit tables of two kinds appended by column name, counted with their part tag."""
    official = inputs.official_units(spark, sf_dir)
    observed = units.distinct_units(inputs.line_list(spark, sf_dir), ["province", "city"], "health_unit", "n_hu_obs")
    return tables.union_parts({"official": official, "observed": observed}, "part")


# --- Incidence ------------------------------------------------------------------


@sorted_query("province", "date")
def api_monthly(spark, sf_dir):
    # The table leaves 2010 out, so no month may stand for that year.
    merged = _harmonised(spark, sf_dir, part_2010=False)
    return series.monthly_rate(merged, harmonise.province_population(spark), exclude_years=[2010])


@query
def weekly_vivax_share(spark, sf_dir):
    return incidence.weekly_vivax_share(inputs.line_list(spark, sf_dir))


@sorted_query("year_dx", "province", "week_dx")
def weekly_vivax_share_axis(spark, sf_dir):
    return incidence.with_month_ticks(incidence.weekly_vivax_share(inputs.line_list(spark, sf_dir)))


@query
def species_levels(spark, sf_dir):
    return incidence.species_levels(inputs.line_list(spark, sf_dir))


@query
def incidence_month_sex(spark, sf_dir):
    counts = incidence.two_species_series(inputs.line_list(spark, sf_dir))
    return incidence.monthly_sex_incidence(counts, incidence.province_sex_population(spark))


@query
def api_age_sex(spark, sf_dir):
    line = inputs.line_list(spark, sf_dir)
    return incidence.age_sex_rate(line, "province", incidence.province_age_population(spark), 2020)


@query
def incidence_focus_districts(spark, sf_dir):
    line = inputs.line_list(spark, sf_dir)
    return incidence.district_month_incidence(line, incidence.district_sex_population(spark))


@query
def api_age_sex_district(spark, sf_dir):
    line = inputs.line_list(spark, sf_dir).filter(F.col("city").isin(cb.FOCUS_DISTRICTS))
    rates = incidence.age_sex_rate(line, "city", incidence.district_age_population(spark), 2020)
    return incidence.plotted_age_rates(rates)


@query
def api_district_class(spark, sf_dir):
    return incidence.district_api_class(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))


@query
def district_profile(spark, sf_dir):
    return incidence.district_profile(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))


@query
def count_with_group_constant(spark, sf_dir):
    line = cleaning.attach_population(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))
    counts = counting.count_with_constant(line, DISTRICT, {"pop": "n"})
    return counts.withColumn("api", missing.rate("case", "pop"))


def _coarse_population(spark, sf_dir):
    return incidence.coarse_age_population(inputs.age_population(spark, sf_dir), inputs.admin_list(spark, sf_dir))


@query
def age_band_fold(spark, sf_dir):
    return _coarse_population(spark, sf_dir)


@query
def api_age_coarse(spark, sf_dir):
    return incidence.age_structured_api(inputs.raw_line_list(spark, sf_dir), _coarse_population(spark, sf_dir))


@query
def api_age_coarse_all_cells(spark, sf_dir):
    return incidence.age_structured_api(
        inputs.raw_line_list(spark, sf_dir), _coarse_population(spark, sf_dir), keep_zero=True
    )


# --- Series -----------------------------------------------------------------------


def _harmonised(spark, sf_dir, part_2010=True):
    reported = inputs.aggregate_series(spark, sf_dir, part_2010)
    return harmonise.harmonised_series(inputs.line_list(spark, sf_dir), reported, inputs.month_parts(spark, sf_dir))


@query
def series_replace_slice(spark, sf_dir):
    return _harmonised(spark, sf_dir)


@query
def series_best_of_two(spark, sf_dir):
    return harmonise.reported_series(inputs.aggregate_series(spark, sf_dir))


@query
def series_grid_fill(spark, sf_dir):
    return harmonise.annual_series(inputs.aggregate_series(spark, sf_dir), harmonise.province_population(spark))


# --- Units ------------------------------------------------------------------------


def _unit_counts(spark, sf_dir):
    """Counts by unit and the unit estimate that goes with them."""
    counts = heterogeneity.unit_counts(inputs.line_list(spark, sf_dir))
    return counts, heterogeneity.unit_estimate(counts, inputs.official_units(spark, sf_dir))


@query
def unit_counts_bucketed(spark, sf_dir):
    """Cases by unit from a line list stored in folders of years and buckets of units: counted without an exchange."""
    line = inputs.line_list(spark, sf_dir)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with tables.bucketed_table(line, new_table_path(spark, "line"), UNIT_BUCKETS, buckets, ["year_dx"]) as stored_line:
        counts, _ = stored(heterogeneity.count_units(stored_line))
    return counts


def _unit_rates(spark, sf_dir):
    counts, estimate = _unit_counts(spark, sf_dir)
    return heterogeneity.unit_rates(counts, inputs.population(spark, sf_dir), estimate)


@query
def distinct_units_with_unnamed(spark, sf_dir):
    return units.distinct_units(inputs.line_list(spark, sf_dir), DISTRICT, "health_unit", "n_units")


@query
def unit_count_estimate(spark, sf_dir):
    return _unit_counts(spark, sf_dir)[1]


@query
def unit_rates(spark, sf_dir):
    return _unit_rates(spark, sf_dir)


@query
def unit_zero_padding(spark, sf_dir):
    return heterogeneity.padded_unit_rates(_unit_rates(spark, sf_dir))


# --- Concentration ------------------------------------------------------------------


def _district_rates(spark, sf_dir):
    return heterogeneity.district_rates(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))


@query
def rates_district(spark, sf_dir):
    return _district_rates(spark, sf_dir)


@sorted_query("year_dx", "province", "sp", "p_i", "c_i")
def lorenz_district(spark, sf_dir):
    return heterogeneity.lorenz_districts(_district_rates(spark, sf_dir))


@sorted_query("year_dx", "province", "sp", "p_i", "c_i")
def lorenz_unit(spark, sf_dir):
    return heterogeneity.lorenz_units(heterogeneity.padded_unit_rates(_unit_rates(spark, sf_dir)))


@query
def lorenz_unit_blocked(spark, sf_dir):
    """The path of large strata: blocks of a few rows."""
    padded = heterogeneity.padded_unit_rates(_unit_rates(spark, sf_dir))
    return heterogeneity.lorenz_units(padded, block_rows=25)


@query
def gini_district(spark, sf_dir):
    index = heterogeneity.gini_districts(_district_rates(spark, sf_dir))
    return index.withColumn("g_percent", concentration.as_percent("g"))


@query
def gini_unit(spark, sf_dir):
    index = heterogeneity.gini_units(_unit_rates(spark, sf_dir))
    return index.withColumn("g_percent", concentration.as_percent("g"))


def _per_district(spark, sf_dir, origin):
    counts, estimate = _unit_counts(spark, sf_dir)
    return heterogeneity.gini_per_district(counts, inputs.population(spark, sf_dir), estimate, origin=origin)


@query
def gini_per_district(spark, sf_dir):
    return _per_district(spark, sf_dir, origin=True)


@query
def gini_per_district_no_origin(spark, sf_dir):
    return _per_district(spark, sf_dir, origin=False)


@sorted_query("year_dx", "cumsum")
def pareto_units_falciparum(spark, sf_dir):
    return heterogeneity.pareto_units(inputs.line_list(spark, sf_dir), cb.PF)


@sorted_query("year_dx", "cumsum")
def pareto_units_vivax(spark, sf_dir):
    return heterogeneity.pareto_units(inputs.line_list(spark, sf_dir), cb.PV)


@sorted_query("cumsum")
def pareto_units_both_years(spark, sf_dir):
    """One table over both years, as the published filter has it for falciparum."""
    return heterogeneity.pareto_units(inputs.line_list(spark, sf_dir), cb.PF, strata=[])


@sorted_query("cumsum")
def pareto_units_vivax_published(spark, sf_dir):
    """The published 2019 filter: the year binds to pure vivax only, so mixed cases come from both years."""
    line = inputs.line_list(spark, sf_dir)
    published = line.filter(((F.col("year_dx") == 2019) & (F.col("sp") == cb.PV)) | F.col("sp").isin(cb.PF, cb.MIXED))
    return heterogeneity.pareto_units(published, cb.PV, strata=[])


@sorted_query("cumsum")
def pareto_units_vivax_published_2020(spark, sf_dir):
    """The published 2020 filter, bound in the same way."""
    line = inputs.line_list(spark, sf_dir)
    published = line.filter(((F.col("year_dx") == 2020) & (F.col("sp") == cb.PV)) | F.col("sp").isin(cb.PF, cb.MIXED))
    return heterogeneity.pareto_units(published, cb.PV, strata=[])


@query
def top_units(spark, sf_dir):
    return concentration.top_units(inputs.line_list(spark, sf_dir), "health_unit", 10)


# --- Resampling -----------------------------------------------------------------------


def _options(origin, draw=resample.digest_draw):
    return {"replicates": CHECK_REPLICATES, "seed": CHECK_SEED, "origin": origin, "draw": draw}


def _district_replicates(spark, sf_dir, origin, **draw):
    return heterogeneity.bootstrap_districts(_district_rates(spark, sf_dir), **_options(origin, **draw))


def _unit_replicates(spark, sf_dir, origin, **draw):
    padded = heterogeneity.padded_unit_rates(_unit_rates(spark, sf_dir))
    return heterogeneity.bootstrap_units(padded, **_options(origin, **draw))


@query
def bootstrap_replicates_district(spark, sf_dir):
    return _district_replicates(spark, sf_dir, origin=True)


@query
def bootstrap_ci_district(spark, sf_dir):
    return resample.percentile_interval(_district_replicates(spark, sf_dir, True), heterogeneity.STRATA, "g")


@query
def bootstrap_ci_district_no_origin(spark, sf_dir):
    return resample.percentile_interval(_district_replicates(spark, sf_dir, False), heterogeneity.STRATA, "g")


@query
def bootstrap_ci_unit(spark, sf_dir):
    return resample.percentile_interval(_unit_replicates(spark, sf_dir, True), heterogeneity.STRATA, "g")


@query
def bootstrap_ci_unit_no_origin(spark, sf_dir):
    return resample.percentile_interval(_unit_replicates(spark, sf_dir, False), heterogeneity.STRATA, "g")


@query
def bootstrap_replicates_district_hashed(spark, sf_dir):
    """With the generator that is the default."""
    return _district_replicates(spark, sf_dir, True, draw=resample.hashed_draw)


@query
def bootstrap_replicates_unit_hashed(spark, sf_dir):
    return _unit_replicates(spark, sf_dir, False, draw=resample.hashed_draw)


@query
def bootstrap_ci_unit_hashed(spark, sf_dir):
    replicates = _unit_replicates(spark, sf_dir, True, draw=resample.hashed_draw)
    return resample.percentile_interval(replicates, heterogeneity.STRATA, "g")


# --- Profiles, orders, fits, maps ---------------------------------------------------------


@query
def unit_type_mix(spark, sf_dir):
    return profile.unit_type_mix(inputs.line_list(spark, sf_dir))


@query
def severity_mix(spark, sf_dir):
    return profile.severity_mix(inputs.line_list(spark, sf_dir))


@query
def occupation_mix(spark, sf_dir):
    return profile.occupation_mix(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))


@query
def category_order_by_mean(spark, sf_dir):
    rates = incidence.district_api(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))
    return counting.order_by_mean(rates, "city", F.col("api"))


@query
def category_order_by_median(spark, sf_dir):
    rates = incidence.district_api(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))
    return counting.order_by_median(rates, "city", "api", "case")


@query
def density_of_replicates(spark, sf_dir):
    return smoothing.density(_district_replicates(spark, sf_dir, True), heterogeneity.STRATA, "g")


@query
def local_fit_of_profile(spark, sf_dir):
    shares = incidence.district_profile(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))
    fits = {name: smoothing.local_fit(shares, ["year_dx"], "api", name) for name in ("male_prop", "adult_prop", "vivax_prop")}
    return plain(tables.union_parts(fits, "measure"), 4)


@query
def line_fit_of_gini(spark, sf_dir):
    return plain(smoothing.line_fit(_per_district(spark, sf_dir, True), ["year_dx"], "api", "g"), 5)


def _rate_map(spark, sf_dir, year):
    rates = incidence.district_api(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))
    return heterogeneity.region_rate_class(
        rates, inputs.map_regions(spark, sf_dir), inputs.vertices(spark, sf_dir), year, highest_first=year == 2019
    )


def _gini_map(spark, sf_dir, year):
    index = _per_district(spark, sf_dir, origin=False)
    return heterogeneity.region_gini_class(
        index, inputs.map_regions(spark, sf_dir), inputs.vertices(spark, sf_dir), year
    )


@query
def region_rate_class_2019(spark, sf_dir):
    return _rate_map(spark, sf_dir, 2019)


@query
def region_rate_class(spark, sf_dir):
    return _rate_map(spark, sf_dir, 2020)


@query
def region_gini_class(spark, sf_dir):
    return _gini_map(spark, sf_dir, 2019)


@query
def region_gini_class_2020(spark, sf_dir):
    return _gini_map(spark, sf_dir, 2020)


@query
def region_names_unmatched(spark, sf_dir):
    rates = incidence.district_api(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))
    values = rates.select(F.col("city").alias("NAME_2"))
    return regions.unmatched(values, inputs.map_regions(spark, sf_dir), "NAME_2")


# --- Checks -----------------------------------------------------------------------------


@query
def grid_check(spark, sf_dir):
    """Cells of district and year × month × sex × species without a case; the districts come from the population table."""
    line = inputs.line_list(spark, sf_dir)
    districts = inputs.population(spark, sf_dir).select(*DISTRICT)
    levels = {"month_dx": list(range(1, 13)), "sex": cb.SEXES, "sp": [cb.PF, cb.PV, cb.OTHER]}
    return checks.missing_cells(line, districts, levels)


@query
def row_count_check(spark, sf_dir):
    """Tables with a fixed number of rows: months of the focus districts, official districts, years by province."""
    def check(df, key, expected):
        fixed = tables.fixed_table(spark, list(expected.items()), f"{key} STRING, expected BIGINT")
        return checks.row_counts(df, fixed, [key]).withColumnRenamed(key, "key")

    return tables.union_parts({
        "district months": check(
            incidence_focus_districts(spark, sf_dir), "city", dict.fromkeys(cb.FOCUS_DISTRICTS, cb.DISTRICT_MONTH_ROWS)
        ),
        "official districts": check(inputs.official_units(spark, sf_dir), "province", cb.OFFICIAL_DISTRICTS),
        "years": check(series_grid_fill(spark, sf_dir), "province", cb.YEAR_PROVINCE_ROWS),
    }, "part")


@query
def group_constant_check(spark, sf_dir):
    """Districts and years whose population differs between rows; one row in some districts is made to."""
    line = cleaning.attach_population(inputs.line_list(spark, sf_dir), inputs.population(spark, sf_dir))
    odd = F.col("city").like("T%") & F.col("id").like("%1-2")
    return checks.varying_attributes(line.withColumn("n", F.col("n") + odd.cast("int")), DISTRICT, "n")


@query
def population_known_check(spark, sf_dir):
    rates = _district_rates_of_reported(spark, sf_dir)
    return checks.missing_population(rates, ["year_dx", "province", "city"], "n")


def _district_rates_of_reported(spark, sf_dir):
    """Reported yearly totals against the population table, which covers the study years only."""
    reported = harmonise.reported_series(inputs.aggregate_series(spark, sf_dir))
    totals = reported.groupBy(F.col("year").alias("year_dx"), "province", "city").agg(missing.strict_sum("case").alias("case"))
    return lookup(totals, inputs.population(spark, sf_dir), DISTRICT)


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
