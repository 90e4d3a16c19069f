"""From the raw line list and population tables to the cleaned line list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from caseweave import codebooks as cb
from caseweave.functions import dates, recode
from caseweave.operators.checks import first_reason, rejects
from caseweave.operators.running import lookup
from caseweave.sources.sizing import broadcast_if_few
from caseweave.sources.tables import with_labels

LINE_LIST_COLUMNS = [
    "id", "province", "city", "date_dx", "week_dx", "month_dx", "year_dx", "sp", "age", "age_cat", "sex",
    "health_unit", "hu_type", "severe", "adm_stat", "lab", "death", "occupation",
]


def recoded(
    raw: DataFrame,
    species_codes: Mapping[tuple[int, str], str] | None = None,
    sex_codes: Mapping[tuple[int, str], str] | None = None,
) -> DataFrame:
    """All rows with repaired dates, labels instead of codes and title-cased places."""
    # As a generated column the date is worked out once per row, also when rows are filtered by it.
    repaired = dates.repair_date("tglkun", "tahun", "bulankun")
    dated = raw.select("*", F.explode(F.array(repaired)).alias("date_dx"))
    calendar = dated.withColumns({
        "week_dx": F.weekofyear("date_dx"),
        "month_dx": F.month("date_dx"),
        "year_dx": F.year("date_dx"),
        "health_unit": recode.title_case("nama_fasyankes"),
    })
    return calendar.select(
        F.col("id").cast("string").alias("id"),
        recode.title_case("nama_propinsi").alias("province"),
        recode.title_case("nama_kabupaten").alias("city"),
        "date_dx",
        "week_dx",
        "month_dx",
        "year_dx",
        recode.recode_by_year("year_dx", "parasit", species_codes or cb.species_by_year()).alias("sp"),
        F.col("umur_th").alias("age"),
        recode.bin_by("umur_th", cb.AGE_BREAKS, cb.AGE_BANDS).alias("age_cat"),
        recode.recode_by_year("year_dx", "jnskel", sex_codes or cb.sex_by_year()).alias("sex"),
        "health_unit",
        recode.classify("health_unit", cb.FACILITY_RULES, "Other").alias("hu_type"),
        recode.recode("derajat", cb.SEVERITY_CODES).alias("severe"),
        recode.classify("p_rawat", cb.ADMISSION_RULES).alias("adm_stat"),
        recode.recode("lab", cb.LAB_CODES).alias("lab"),
        recode.classify("kematian", cb.DEATH_RULES).alias("death"),
        recode.recode("pekerjaan", cb.OCCUPATION_CODES).alias("occupation"),
    )


def clean_line_list(
    raw: DataFrame,
    provinces: Sequence[str] = cb.PROVINCES,
    years: Sequence[int] = cb.STUDY_YEARS,
    species_codes: Mapping[tuple[int, str], str] | None = None,
    sex_codes: Mapping[tuple[int, str], str] | None = None,
    observed: Observation | None = None,
) -> DataFrame:
    """Rows of the study area and years with the columns of the analysis table.

    ``observed`` is filled by the first action on the result: the rows that were left out by reason
    (``rejected_rows``), and those that were kept, counted in the same pass.
    """
    rows = recoded(raw, species_codes, sex_codes)
    if observed is not None:
        reason = first_reason(reject_reasons(provinces, years))
        counts = [F.count_if(F.coalesce(reason == name, F.lit(False))).alias(name) for name in reject_reasons(provinces, years)]
        rows = rows.observe(observed, *counts, F.count_if(reason.isNull()).alias("kept"))
    rows = rows.filter(F.col("province").isin(list(provinces)) & F.col("year_dx").isin(list(years)))
    return rows.withColumn("province", rename_province("province"))


def rename_province(column: str):
    """Study name of a province; other names stay as they are."""
    return F.coalesce(recode.recode(column, cb.PROVINCE_RENAMES), F.col(column))


def reject_reasons(provinces: Sequence[str], years: Sequence[int]) -> dict[str, Column]:
    """Why a row is left out; the first reason that applies counts."""
    return {
        "other province": ~F.coalesce(F.col("province").isin(list(provinces)), F.lit(False)),
        "year missing": F.col("year_dx").isNull(),
        "other year": ~F.col("year_dx").isin(list(years)),
    }


def rejected_rows(raw: DataFrame, provinces: Sequence[str] = cb.PROVINCES, years: Sequence[int] = cb.STUDY_YEARS) -> DataFrame:
    """Rows that the cleaning leaves out, with the reason."""
    rows = recoded(raw).select("id", "province", "year_dx")
    return rejects(rows, reject_reasons(provinces, years))


def attach_population(line: DataFrame, population: DataFrame) -> DataFrame:
    """Cleaned line list with the population ``n`` of its (year, province, city), NULL if unknown.

    The population table is run once and counted: a small one goes to every task, so the
    line list is not shuffled on its few district keys. A larger one is joined by a shuffle, in which
    adaptive execution splits a district that holds much of the rows.
    """
    joined = lookup(line, broadcast_if_few(population), ["year_dx", "province", "city"])
    return joined.select("id", "province", "city", "n", *LINE_LIST_COLUMNS[3:])


def labelled(line: DataFrame) -> DataFrame:
    """Line list with its column labels as metadata."""
    return with_labels(line, cb.LINE_LIST_LABELS)
