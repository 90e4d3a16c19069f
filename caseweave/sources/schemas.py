"""Schemas of the raw inputs; nothing is inferred at read time."""

from __future__ import annotations

# Column names of the raw inputs.
RAW_LINE_LIST = """
    id STRING, tglkun STRING, tahun INT, bulankun DOUBLE, parasit STRING, umur_th DOUBLE,
    jnskel STRING, nama_propinsi STRING, nama_kabupaten STRING, nama_fasyankes STRING,
    derajat INT, p_rawat STRING, lab STRING, kematian STRING, pekerjaan STRING
"""
AGGREGATE_SERIES = """
    YEAR INT, MONTH INT, ADMIN1 STRING, ADMIN2 STRING,
    POS_GENDER_TOTAL DOUBLE, POS_SPECIES_TOTAL DOUBLE
"""
MONTH_PART = "`Provinsi` STRING, `Kabupaten/Kota` STRING, `Positif` DOUBLE"
POPULATION_PAPUA = "city STRING, year_18 STRING, year_19 STRING, year_20 STRING"
POPULATION_WEST_PAPUA = "city STRING, year_19 STRING, year_20 STRING"
UNIT_TABLE = "`Nama Kab/Kota` STRING, `Jumlah Unit` DOUBLE"
ADMIN_LIST = "IDADMIN1 STRING, IDADMIN2 STRING, ADMIN1 STRING, ADMIN2 STRING, REGION STRING"
AGE_POPULATION = "IDADMIN2 STRING, `AGE.GROUP` STRING, YEAR INT, POP DOUBLE"
VERTICES = "long DOUBLE, lat DOUBLE, `group` STRING, id STRING"
REGIONS = "NAME_1 STRING, NAME_2 STRING, id STRING"

# Names of the twelve month parts, January first.
MONTH_PARTS = ["JAN", "FEB", "MAR", "APR", "MEI", "JUN", "JUL", "AGS", "SEPT", "OKT", "NOV", "DES"]
