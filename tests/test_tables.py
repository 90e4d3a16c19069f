"""Sources, sinks, cleaning, series, regions and checks."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from caseweave import codebooks as cb
from caseweave.operators import checks, regions, series, units
from caseweave.plans import cleaning, harmonise, heterogeneity, incidence
from caseweave.session import new_table_path, pin, scratch
from caseweave.sources import schemas, tables


def raw_rows(spark):
    rows = [
        ("1", "3-1-2019", 2019, 1.0, "Pmix", 4.0, "L", "PAPUA", "TELUK-X", "PKM A", 1, "rj", "RDT", "ya", "TNI"),
        ("2", None, 2020, 5.0, "Mix", 20.0, "p", "PAPUA BARAT", "SORONG", "RSUD", 2, "RI", "PCR", "Tidak", "Guru"),
        ("3", "x", 2020, 14.0, "Pf", None, "l", "PAPUA", "KEEROM", None, None, None, None, None, None),
        ("4", "1/1/2021", 2021, 1.0, "Pf", 1.0, "L", "PAPUA", "KEEROM", "BP", 1, "-", "-", "-", "-"),
        ("5", "1/1/2020", 2020, 1.0, "Pf", 1.0, "L", "BALI", "BALI", "BP", 1, "-", "-", "-", "-"),
    ]
    return spark.createDataFrame(rows, schemas.RAW_LINE_LIST)


def test_cleaning_and_population(spark):
    line = cleaning.clean_line_list(raw_rows(spark))
    people = spark.createDataFrame([(2019, "Papua", "Teluk-X", 100.0)], "year_dx int, province string, city string, n double")
    out = cleaning.labelled(cleaning.attach_population(line, people))
    assert list(out.columns) == ["id", "province", "city", "n", *cleaning.LINE_LIST_COLUMNS[3:]]
    first, second = out.orderBy("id").collect()
    assert (first.sp, first.sex, first.age_cat, first.hu_type, first.adm_stat, first.death, first.n) == (
        cb.MIXED, "Male", "0-4", "Health centre", "Outpatient", True, 100.0)
    assert (second.province, second.date_dx, second.sp, second.severe, second.n, second.occupation) == (
        "West Papua", dt.date(2020, 5, 1), cb.MIXED, "Severe malaria", None, "Teacher")
    assert tables.labels_of(out.filter("age > 1")) == cb.LINE_LIST_LABELS


def test_rejects_have_a_reason(spark):
    out = {r.id: r.reason for r in cleaning.rejected_rows(raw_rows(spark)).collect()}
    assert out == {"3": "year missing", "4": "other year", "5": "other province"}


def test_partitioned_table_prunes_years(spark):
    path = new_table_path(spark, "test")
    tables.write_table(cleaning.clean_line_list(raw_rows(spark)), path, ["year_dx"])
    back = tables.read_table(spark, path, [2019])
    assert [r.id for r in back.collect()] == ["1"]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_dx" in plan


def test_units_of_a_bucketed_table_are_counted_without_an_exchange(spark):
    rows = cleaning.clean_line_list(raw_rows(spark))
    before = {t.name for t in spark.catalog.listTables()}
    keys = ["province", "city", "health_unit"]
    with tables.bucketed_table(rows, new_table_path(spark, "test"), keys, 3, ["year_dx"]) as line:
        counts = heterogeneity.count_units(line)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount: 3 out of 3" in plan
        same = heterogeneity.count_units(rows)
        assert counts.exceptAll(same).count() == same.exceptAll(counts).count() == 0 and counts.count() == 2
        pruned = line.filter("year_dx = 2019")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year_dx" in pruned
    assert {t.name for t in spark.catalog.listTables()} == before


def test_month_parts_are_tagged_by_file(spark, tmp_path):
    for name, place in (("JAN", "BIAK"), ("DES", "SORONG")):
        (tmp_path / f"{name}.csv").write_text(f"Provinsi,Kabupaten/Kota,Positif\nPapua,{place},\nBali,X,3\n")
    paths = [str(tmp_path / f"{n}.csv") for n in ("JAN", "DES")]
    parts = tables.read_month_parts(spark, paths, schemas.MONTH_PART)
    out = {(r.month, r.date, r.city, r.case) for r in harmonise.part_series(parts).collect()}
    assert out == {(1, dt.date(2018, 1, 1), "Biak", 0.0), (12, dt.date(2018, 12, 1), "Sorong", 0.0)}


def test_population_tables_lose_headings_and_totals(spark):
    known = spark.createDataFrame([("Biak",), ("Sorong",)], "city string")
    papua = spark.createDataFrame([(None, "2018", "2019", "2020"), ("Biak", "1", "2", "3"), ("Total", "9", "9", "9")], schemas.POPULATION_PAPUA)
    west = spark.createDataFrame([("Kabupaten", "x", "y"), ("Sorong", "40.00", "50.00")], schemas.POPULATION_WEST_PAPUA)
    body = tables.rows_of_known(papua, "city", known, ["year_19", "year_20"])
    assert [(r.city, r.year_19) for r in body.collect()] == [("Biak", 2.0)]
    out = tables.population_by_year(papua, west, known)
    assert {(r.year_dx, r.province, r.city, r.n) for r in out.collect()} == {
        (2019, "Papua", "Biak", 2.0), (2020, "Papua", "Biak", 3.0),
        (2019, "West Papua", "Sorong", 40.0), (2020, "West Papua", "Sorong", 50.0)}


def test_csv_with_fixed_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("YEAR,MONTH,ADMIN1,ADMIN2,POS_GENDER_TOTAL,POS_SPECIES_TOTAL\n2011,2,PAPUA,BIAK,5,7\n2011,3,PAPUA BARAT,SORONG,,7\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), schemas.AGGREGATE_SERIES)
    out = {(r.date, r.province, r.city, r.case) for r in harmonise.reported_series(df).collect()}
    assert out == {(dt.date(2011, 2, 1), "Papua", "Biak", 7.0), (dt.date(2011, 3, 1), "West Papua", "Sorong", None)}


def test_years_come_from_one_source(spark):
    schema = "year int, v int"
    a = spark.createDataFrame([(2017, 1), (2018, 1), (2019, 1)], schema)
    b = spark.createDataFrame([(2018, 2), (2019, 2)], schema)
    c = spark.createDataFrame([(2017, 3), (2019, 3), (2020, 3)], schema)
    out = series.replace_years({"a": a, "b": b, "c": c}, {2018: "b", 2019: "c", 2020: "c"}, "a")
    assert {(r.year, r.v) for r in out.collect()} == {(2017, 1), (2018, 2), (2019, 3), (2020, 3)}


def test_grid_has_every_year_and_province(spark):
    reported = spark.createDataFrame([(2010, "PAPUA", 2857.0, 1.0), (2010, "PAPUA", None, 1.0), (2011, "PAPUA BARAT", 786.0, 1.0)],
                                     "YEAR int, ADMIN1 string, POS_GENDER_TOTAL double, POS_SPECIES_TOTAL double")
    out = harmonise.annual_series(reported, harmonise.province_population(spark)).collect()
    assert len(out) == 22
    found = {(r.year, r.province): r.api for r in out}
    assert found[(2010, "Papua")] is None and found[(2011, "West Papua")] == 1.0


def test_outlines_keep_both_sides(spark):
    values = spark.createDataFrame([("A", 5.0), ("Gone", 7.0)], "NAME_2 string, api double")
    places = spark.createDataFrame([("P", "A", "1"), ("P", "Silent", "2"), ("P", "Undrawn", "3")], schemas.REGIONS)
    vertices = spark.createDataFrame([(0.0, 0.0, "1.1", "1"), (1.0, 1.0, "2.1", "2"), (2.0, 2.0, "9.1", "9")], schemas.VERTICES)
    attributes = regions.attach_to_regions(values, places, "NAME_2")
    out = {(r.id, r.NAME_2, r.api, r.long) for r in regions.attach_to_outlines(vertices, attributes, "id").collect()}
    assert out == {("1", "A", 5.0, 0.0), ("2", "Silent", None, 1.0), ("9", None, None, 2.0),
                   ("3", "Undrawn", None, None), (None, "Gone", 7.0, None)}
    sides = {(r.NAME_2, r.side) for r in regions.unmatched(values, places, "NAME_2").collect()}
    assert sides == {("Gone", "values"), ("Silent", "regions"), ("Undrawn", "regions")}


def test_checks(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, None), ("b", 1, 5.0)], "k string, m int, n double")
    cells = checks.missing_cells(df, df.select("k"), {"m": [1, 2]})
    assert [(r.k, r.m) for r in cells.collect()] == [("b", 2)]
    assert [r.k for r in checks.varying_attributes(df, ["k"], "n").collect()] == ["b"]
    assert [(r.k, r.rows) for r in checks.missing_population(df, ["k"], "n").collect()] == [("b", 1)]


def test_missing_cells_of_a_grid_of_several_words(spark):
    rng = np.random.default_rng(2)
    levels = {"m": list(range(1, 13)), "s": ["f", "m"], "q": [7, 8, 9]}
    rows = [(k, int(m), str(s), int(q)) for k in "ab" for m, s, q in zip(rng.integers(0, 14, 150), rng.choice(["f", "m", "x"], 150), rng.integers(7, 11, 150))]
    rows += [("a", None, "f", 7), (None, 1, "f", 7)]
    df = spark.createDataFrame(rows, "k string, m int, s string, q int")
    base = spark.createDataFrame([("a",), ("b",), ("b",), ("empty",)], "k string")
    cells = checks.missing_cells(df, base, levels)
    assert cells.columns == ["k", "m", "s", "q"]
    want = {(k, m, s, q) for k in ("a", "b", "empty") for m in levels["m"] for s in levels["s"] for q in levels["q"]} - set(rows)
    got = [tuple(r) for r in cells.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "BroadcastNestedLoopJoin" not in cells._jdf.queryExecution().executedPlan().toString()


def test_rejects_are_counted_by_the_write_of_the_cleaned_table(spark):
    counted = Observation()
    cleaning.clean_line_list(raw_rows(spark), observed=counted).write.parquet(new_table_path(spark, "test"))
    rejected = cleaning.rejected_rows(raw_rows(spark)).groupBy("reason").count().collect()
    assert counted.get == {"other province": 0, "year missing": 0, "other year": 0, "kept": 2} | {r.reason: r["count"] for r in rejected}


@pytest.mark.parametrize("chunk", [10_000, 3])
def test_silent_units_come_from_one_pass(spark, monkeypatch, chunk):
    monkeypatch.setattr(units, "ROWS_PER_CHUNK", chunk)
    rows = [("a", "u1", 3.0, 9.0, 10.0, "x"), ("a", None, 1.0, 9.0, 10.0, "y"), ("b", "u1", 2.0, 1.0, 5.0, "x"), (None, "u3", 4.0, 2.5, 2.0, "z"), ("d", "u", 1.0, None, None, "w")]
    df = spark.createDataFrame(rows, "k string, u string, c double, n double, p double, other string")
    padded = units.pad_units(df, ["k"], "u", "n", "c", ["p"])
    assert padded.columns == [*df.columns, "pad"]
    want = {(*r, 0) for r in rows} | {("a", None, 0.0, 9.0, 10.0, None, i) for i in range(1, 8)} | {(None, None, 0.0, 2.5, 2.0, None, i) for i in (1, 2)}
    got = [tuple(r) for r in padded.collect()]
    assert set(got) == want and len(got) == len(want)
    weighed = units.weigh_missing_units(df, ["k"], "u", "n", "c", "p")
    got = [tuple(r) for r in weighed.collect()]
    assert set(got) == {(r[0], r[1], r[2], r[4]) for r in rows} | {("a", None, 0.0, 70.0), (None, None, 0.0, 4.0)} and len(got) == 7
    plan = units.pad_units(df, ["k"], "u", "n", "c", ["p"])._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Join" not in plan and plan.count("Exchange") == 1
    assert units.pad_units(df.limit(0), ["k"], "u", "n", "c", ["p"]).count() == 0


def test_zero_cells_are_kept_on_request(spark):
    raw = raw_rows(spark).withColumn("nama_kabupaten", F.lit("KEEROM"))
    people = spark.createDataFrame(
        [("Papua", "Keerom", 2019, "[0, 5)", 1000.0), ("Papua", "Keerom", 2019, "[5, 10)", 500.0)],
        "province string, district string, year int, age_cat string, pop double")
    plain = incidence.age_structured_api(raw, people).filter("year = 2019")
    everything = incidence.age_structured_api(raw, people, keep_zero=True).filter("year = 2019")
    assert {(r.age_cat, r.sp, r.cases, r.api) for r in plain.collect()} == {("[0, 5)", cb.PF, 1.0, 1.0), ("[0, 5)", cb.PV, 1.0, 1.0)}
    assert everything.count() == 4


def test_pinned_rows_do_not_change(spark):
    df = pin(spark.range(50).withColumn("r", F.rand()))
    assert df.agg(F.sum("r")).first() == df.agg(F.sum("r")).first()


def test_known_district_with_a_blank_year_keeps_the_other(spark):
    known = spark.createDataFrame([("Biak",)], "city string")
    papua = spark.createDataFrame([("Biak", "1", "2", " "), ("Total", "1", "2", "3")], schemas.POPULATION_PAPUA)
    body = tables.rows_of_known(papua, "city", known, ["year_19", "year_20"])
    assert [(r.city, r.year_19, r.year_20) for r in body.collect()] == [("Biak", 2.0, None)]


def test_scratch_is_removed(spark, tmp_path):
    with scratch(spark) as folder:
        pinned = pin(spark.range(20))
        tables.write_table(spark.range(5), new_table_path(spark, "t"))
        assert pinned.count() == 20 and len(os.listdir(folder)) == 2
    assert not os.path.exists(folder)
    assert pin(spark.range(3)).count() == 3
