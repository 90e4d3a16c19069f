"""Missing-value rules, recoding, text and dates on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseweave import codebooks as cb
from caseweave.functions import dates, missing, recode
from caseweave.operators import allocate, counting, units
from caseweave.operators.running import lookup


def values(df, column="out"):
    return [row[column] for row in df.collect()]


def test_strict_sum_is_null_when_one_row_is(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 2.0)], "k string, v double")
    out = df.groupBy("k").agg(missing.strict_sum("v").alias("out")).orderBy("k")
    assert values(out) == [None, 3.0]


def test_strict_greatest_and_plain_greatest(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0), (None, None)], "a double, b double")
    assert values(df.select(missing.strict_greatest("a", "b").alias("out"))) == [None, 2.0, None]
    assert values(df.select(F.greatest("a", "b").alias("out"))) == [1.0, 2.0, None]


def test_rate_has_no_division_by_zero(spark):
    df = spark.createDataFrame([(5, 1000.0), (5, 0.0), (5, None), (None, 10.0)], "c long, p double")
    assert values(df.select(missing.rate("c", "p").alias("out"))) == [5.0, None, None, None]


def test_share_counts_unknown_in_the_base(spark):
    df = spark.createDataFrame([("Male",), ("Female",), (None,), (None,)], "sex string")
    assert values(df.agg(missing.share_where(F.col("sex") == "Male").alias("out"))) == [0.25]
    assert values(df.agg(missing.share_where(F.col("sex") == "none").alias("out"))) == [0.0]


@pytest.mark.parametrize("text,expected", [
    ("1-2-2019", dt.date(2019, 2, 1)), ("01/02/2019", dt.date(2019, 2, 1)), ("01022019", dt.date(2019, 2, 1)),
    ("1 Feb 2019", dt.date(2019, 2, 1)), ("1-2-19", dt.date(2019, 2, 1)), (" 29.2.2020 ", dt.date(2020, 2, 29)),
    ("31-02-2020", None), ("13-13-2020", None), ("tidak ada", None), ("2019-02-01", None), ("", None), (None, None),
])
def test_parse_dmy(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert values(df.select(dates.parse_dmy("t").alias("out"))) == [expected]


def test_repair_date_falls_back_to_month(spark):
    rows = [("5-6-2020", 2019, 1.0), (None, 2020, 7.0), ("x", 2020, 13.0), (None, None, 7.0), (None, 2020, 2.5)]
    df = spark.createDataFrame(rows, "t string, y int, m double")
    expected = [dt.date(2020, 6, 5), dt.date(2020, 7, 1), None, None, None]
    assert values(df.select(dates.repair_date("t", "y", "m").alias("out"))) == expected


def test_iso_week_with_calendar_year(spark):
    df = spark.sql("SELECT date'2019-12-30' AS d UNION ALL SELECT date'2020-12-31'")
    assert sorted((r[0], r[1]) for r in df.select(F.year("d"), F.weekofyear("d")).collect()) == [(2019, 1), (2020, 53)]


def test_month_axis_positions(spark):
    axis = spark.range(1).select(F.inline(dates.month_axis())).orderBy("month").collect()
    assert len(axis) == 12 and axis[0].week_position == pytest.approx(1 / 365 * 52 + 1)


def test_recode_by_year_uses_the_codes_of_the_year(spark):
    rows = [(2019, "Pmix"), (2020, "Pmix"), (2019, "Mix"), (2020, "Mix"), (2020, "Suspek Pk"), (2021, "Pf"), (None, "Pf"), (2019, None)]
    df = spark.createDataFrame(rows, "y int, c string")
    out = values(df.select(recode.recode_by_year("y", "c", cb.species_by_year()).alias("out")))
    assert out == [cb.MIXED, None, None, cb.MIXED, cb.OTHER, None, None, None]


def test_lower_case_sex_only_in_the_second_year(spark):
    df = spark.createDataFrame([(2019, "l"), (2020, "l"), (2019, "P"), (2020, "p")], "y int, c string")
    out = values(df.select(recode.recode_by_year("y", "c", cb.sex_by_year()).alias("out")))
    assert out == [None, "Male", "Female", "Female"]


def test_recode_or_default(spark):
    df = spark.createDataFrame([("Pf",), ("Mix",), ("Pmix",), ("Pk",), ("",), (None,)], "c string")
    out = values(df.select(recode.recode_or("c", cb.COARSE_SPECIES_CODES, cb.OTHER).alias("out")))
    assert out == [cb.PF, "Mixed", "Mixed", cb.OTHER, None, None]


def test_facility_rules(spark):
    rows = [("Puskesmas Rs",), ("PKM X",), ("rsud",), ("Pos Bersama",), ("Balai Pengobatan",), ("Klinik",), ("Pos",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    out = values(df.select(recode.classify("t", cb.FACILITY_RULES, "Other").alias("out")))
    assert out == ["Health centre", "Health centre", "Hospital", "Hospital", "Clinic", "Clinic", "Other", "Other"]


def test_rules_without_default_keep_null(spark):
    df = spark.createDataFrame([("RJ ri",), ("rawat RI",), ("-",), (None,)], "t string")
    assert values(df.select(recode.classify("t", cb.ADMISSION_RULES).alias("out"))) == ["Outpatient", "Inpatient", None, None]
    df = spark.createDataFrame([("Ya",), ("tidak",), ("?",)], "t string")
    assert values(df.select(recode.classify("t", cb.DEATH_RULES).alias("out"))) == [True, False, None]


def test_age_bands(spark):
    df = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (74.9,), (75.0,), (120.0,), (None,)], "age double")
    out = values(df.select(recode.bin_by("age", cb.AGE_BREAKS, cb.AGE_BANDS).alias("out")))
    assert out == ["0-4", "0-4", "5-9", "70-74", "75+", "75+", None]
    coarse = values(df.select(recode.bin_by("age", cb.COARSE_AGE_BREAKS, cb.COARSE_AGE_BANDS).alias("out")))
    assert coarse == ["[0, 5)", "[0, 5)", "[5, 10)", "[65, ∞)", "[65, ∞)", "[65, ∞)", None]


def test_negative_gini_is_in_the_first_class(spark):
    df = spark.createDataFrame([(-0.1,), (0.2,), (1.0,)], "g double")
    out = values(df.select(recode.bin_by("g", cb.GINI_BREAKS, cb.GINI_CLASSES).alias("out")))
    assert out == ["[0-20)", "[20-40)", "[80-100]"]


def test_title_case(spark):
    rows = [("TELUK-BINTUNI",), ("kab. biak numfor",), ("O'NEIL",), ("A - b",), ("KOTA (BARU)/lama",), ("10 x",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    out = values(df.select(recode.title_case("t").alias("out")))
    assert out == ["Teluk-Bintuni", "Kab. Biak Numfor", "O'neil", "A - B", "Kota (Baru)/Lama", "10 X", None]


def test_drop_suffix(spark):
    df = spark.createDataFrame([("12345.00",), ("ab",), (None,)], "t string")
    assert values(df.select(recode.drop_suffix("t", 3).alias("out"))) == ["12345", "", None]


def test_coarse_bands_cover_all_fine_bands():
    assert [cb.coarse_band_of(b) for b in ("0-4", "5-9", "10-14", "15-19", "60-64", "65-69", "75+")] == [
        "[0, 5)", "[5, 10)", "[10, 15)", "[15, 65)", "[15, 65)", "[65, ∞)", "[65, ∞)"]


def test_published_tables_have_their_sizes():
    assert len(cb.province_population_rows()) == 22
    assert len(cb.province_sex_rows()) == 8
    assert len(cb.province_age_rows()) == 64
    assert len(cb.district_sex_rows()) == 6
    assert len(cb.district_age_rows()) == 96


def cells(spark):
    rows = [("all", "f", 3), ("all", "v", 5), ("all", "m", 1), ("no mix", "f", 2), ("no mix", "v", 2),
            ("no f", "v", 4), ("no f", "m", 2), ("only other", "o", 7)]
    return spark.createDataFrame(rows, "k string, sp string, n int")


@pytest.mark.parametrize("rule,weight,expected", [
    ("strict", 0.5, {("all", "f"): 3.5, ("all", "v"): 5.5, ("no mix", "f"): None, ("no mix", "v"): None,
                     ("no f", "f"): None, ("no f", "v"): 5.0}),
    ("lenient", 0.5, {("all", "f"): 3.5, ("all", "v"): 5.5, ("no mix", "f"): 2.0, ("no mix", "v"): 2.0,
                      ("no f", "f"): None, ("no f", "v"): 5.0}),
    ("zero", 0.5, {("all", "f"): 3.5, ("all", "v"): 5.5, ("no mix", "f"): 2.0, ("no mix", "v"): 2.0,
                   ("no f", "f"): 1.0, ("no f", "v"): 5.0}),
    ("zero", 1.0, {("all", "f"): 4.0, ("all", "v"): 6.0, ("no mix", "f"): 2.0, ("no mix", "v"): 2.0,
                   ("no f", "f"): 2.0, ("no f", "v"): 6.0}),
])
def test_allocation_variants(spark, rule, weight, expected):
    out = allocate.allocate_mixed(cells(spark), ["k"], "sp", ["f", "v"], "m", weight, rule, count="n")
    assert {(r.k, r.sp): r.case for r in out.collect()} == expected


def test_allocation_counts_single_rows_the_same(spark):
    single = cells(spark).withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    out = allocate.allocate_mixed(single, ["k"], "sp", ["f", "v"], "m", missing="zero")
    assert {(r.k, r.sp): r.case for r in out.collect()}[("no f", "v")] == 5.0


def test_group_constant_fans_out(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, n int")
    out = counting.count_with_constant(df, ["k"], {"pop": "n"})
    assert sorted((r.k, r.case, r["pop"]) for r in out.collect()) == [("a", 2, 1), ("b", 2, 1), ("b", 2, 2)]


def test_lookup_matches_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    assert {(r.k, r.v, r.w) for r in lookup(left, right, ["k"]).collect()} == {("a", 1, 10), (None, 2, 20), ("z", 3, None)}
    full = units.full_lookup(left, right.union(spark.createDataFrame([("q", 5)], "k string, w int")), ["k"])
    assert {(r.k, r.v, r.w) for r in full.collect()} == {("a", 1, 10), (None, 2, 20), ("z", 3, None), ("q", None, 5)}


def test_distinct_units_count_the_unnamed_one(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("a", None), ("b", None)], "k string, u string")
    out = units.distinct_units(df, ["k"], "u", "n")
    assert {(r.k, r.n) for r in out.collect()} == {("a", 2), ("b", 1)}


def test_estimate_ignores_missing_counts(spark):
    seen = spark.createDataFrame([("a", "x", 2020), ("a", "y", 2020), ("a", "x", 2019), ("b", "x", 2019)], "k string, u string, y int")
    observed = units.distinct_units_of(seen, ["k"], "u", "y", {2020: "n20", 2019: "n19"})
    official = spark.createDataFrame([("a", 1.0), ("c", 4.0)], "k string, web double")
    out = units.estimate_units(observed, official, ["k"], ["n20", "web", "n19"])
    assert {(r.k, r.n20, r.web, r.n19, r.n_hu) for r in out.collect()} == {
        ("a", 2, 1.0, 1, 2.0), ("b", None, None, 1, 1.0), ("c", None, 4.0, None, 4.0)}


def test_padding_adds_the_missing_rows_only(spark, monkeypatch):
    monkeypatch.setattr(units, "ROWS_PER_CHUNK", 3)
    rows = [("a", "x", 2.0, 9.0, 90.0), ("a", "y", 0.0, 9.0, 90.0), ("b", "x", 1.0, 1.0, 10.0), ("c", "x", 1.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, u string, cases double, n double, pop double")
    out = units.pad_units(df, ["k"], "u", "n", "cases", ["pop"]).collect()
    added = [r for r in out if r["pad"] > 0]
    assert sorted(r["pad"] for r in added) == [1, 2, 3, 4, 5, 6, 7]
    assert {(r.k, r.u, r.cases, r.n, r["pop"]) for r in added} == {("a", None, 0.0, 9.0, 90.0)}
    assert len(out) == 4 + 7 and sum(r.cases for r in out) == 4.0


def test_orders_by_mean_and_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 9.0, 3), ("b", 4.0, 1), (None, 0.0, 1)], "c string, v double, n int")
    by_mean = {r.c: (r.score, r.ord) for r in counting.order_by_mean(df, "c", F.col("v"), "n").collect()}
    assert by_mean == {"a": (7.0, 2), "b": (4.0, 1)}
    by_median = {r.c: (r.score, r.ord) for r in counting.order_by_median(df, "c", "v", "n").collect()}
    assert by_median == {"a": (9.0, 2), "b": (4.0, 1)}


def test_null_is_a_slice_of_a_composition(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 3)], "k string, c string, case int")
    assert {(r.c, r.share) for r in counting.composition(df, ["k"], "c").collect()} == {("x", 0.25), (None, 0.75)}
