"""Raw study inputs derived from the benchmark tables, whole tables at a time.

Each order line becomes a patient visit, each supplier a health unit, each nation
a district and each region part of a province. Irregular values (missing or
impossible dates, codes of the wrong year, blanks) follow fixed rules on the keys,
so that every cleaning rule meets data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave import codebooks as cb
from caseweave.functions.recode import recode, title_case
from caseweave.plans.cleaning import clean_line_list, rename_province
from caseweave.sources.schemas import MONTH_PARTS
from caseweave.sources.sizing import broadcast_if_small

# Raw names of the regions by key; the last one lies outside the main study area.
PROVINCE_OF_REGION = {0: "PAPUA", 1: "PAPUA", 2: "PAPUA", 3: "PAPUA BARAT", 4: "NUSA TENGGARA TIMUR"}
# Raw names of some districts by nation key; the others are called after the nation.
DISTRICT_OF_NATION = {
    0: "KEEROM", 1: "NABIRE", 2: "JAYAWIJAYA",
    4: "SUMBA BARAT", 9: "SUMBA BARAT DAYA", 14: "SUMBA TENGAH", 19: "SUMBA TIMUR",
}
FACILITY_PREFIXES = ["PUSKESMAS ", "PKM ", "RUMAH SAKIT ", "RSUD ", "KLINIK ", "BP ", "POS BERSAMA ", "POS KESEHATAN "]
OCCUPATIONS = [*cb.OCCUPATION_CODES, "LAINNYA"]


SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, raw province, raw district); 25 nations at every scale."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    named = F.coalesce(recode("n_nationkey", DISTRICT_OF_NATION), F.expr("concat('TELUK-', n_name)"))
    return joined.select(
        "n_nationkey", recode("r_regionkey", PROVINCE_OF_REGION).alias("raw_province"), named.alias("raw_district")
    )


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{value}'" for value in values) + ")"


def raw_line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw row per order line, with the column names and codes of the original line list."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    places = supplier.join(F.broadcast(districts(spark, sf_dir)), supplier.s_nationkey == F.col("n_nationkey"))
    places = broadcast_if_small(places, supplier)
    rows = line.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    year = "CASE WHEN l_orderkey % 997 = 0 THEN 2021 WHEN year(l_shipdate) % 2 = 1 THEN 2019 ELSE 2020 END"
    rows = rows.selectExpr(
        "*", f"{year} AS tahun", "array('-', '/', ' ')[l_linenumber % 3] AS separator",
        "CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'L' END AS sex_code",
    )
    mixed = " ".join(f"WHEN {y} THEN '{code}'" for y, code in cb.MIXED_CODE_OF_YEAR.items())
    return rows.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) AS id",
        """CASE WHEN l_orderkey % 31 = 0 THEN 'tidak ada'
                WHEN l_orderkey % 23 <> 0
                THEN concat(day(l_shipdate), separator, month(l_shipdate), separator, tahun) END AS tglkun""",
        "tahun",
        "CAST(CASE WHEN l_orderkey % 29 = 0 THEN 13 ELSE month(l_shipdate) END AS DOUBLE) AS bulankun",
        f"""CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 37 = 0 THEN 'Pm' WHEN l_partkey % 41 = 0 THEN 'Mix'
                WHEN l_returnflag = 'A' THEN 'Pf' WHEN l_returnflag = 'N' THEN 'Pv'
                ELSE CASE tahun {mixed} END END AS parasit""",
        "CASE WHEN l_partkey % 19 <> 0 THEN l_quantity * 2 - 1 END AS umur_th",
        """CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN tahun = 2020 OR l_partkey % 43 = 0 THEN lower(sex_code)
                ELSE sex_code END AS jnskel""",
        "raw_province AS nama_propinsi",
        "raw_district AS nama_kabupaten",
        f"CASE WHEN s_suppkey % 97 <> 50 THEN concat({_array(FACILITY_PREFIXES)}[s_suppkey % 8], s_suppkey) END AS nama_fasyankes",
        "CASE l_linenumber WHEN 5 THEN NULL WHEN 4 THEN 2 ELSE 1 END AS derajat",
        "array('RJ (rawat jalan)', 'Ri', '-')[l_suppkey % 3] AS p_rawat",
        "array('Mikroskop', 'RDT', 'PCR', 'Lain')[l_partkey % 4] AS lab",
        "CASE WHEN l_orderkey % 50 = 0 THEN 'Ya' WHEN l_orderkey % 3 <> 0 THEN 'Tidak' END AS kematian",
        f"{_array(OCCUPATIONS)}[l_partkey % {len(OCCUPATIONS)}] AS pekerjaan",
    )


def line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned line list of the study area and years."""
    return clean_line_list(raw_line_list(spark, sf_dir))


def _study_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = districts(spark, sf_dir).select(
        "n_nationkey",
        title_case("raw_province").alias("province"),
        title_case("raw_district").alias("city"),
    )
    return places.filter(F.col("province").isin(cb.PROVINCES)).withColumn("province", rename_province("province"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population ``n`` by (year_dx, province, city): 1000 per customer, 2 % more in the second year."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    joined = customers.join(F.broadcast(_study_places(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    by_year = F.array(*[
        F.struct(F.lit(year).alias("year_dx"), (F.col("customers") * factor).cast("double").alias("n"))
        for year, factor in ((2019, 1000), (2020, 1020))
    ])
    return joined.select("province", "city", F.inline(by_year)).select("year_dx", "province", "city", "n")


def population_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two wide population tables as text, each with a heading row and a total row among its districts.

    Numbers of the second table end in a fixed suffix.
    """
    wide = population(spark, sf_dir).groupBy("province", "city").agg(
        F.max(F.when(F.col("year_dx") == 2019, F.col("n"))).cast("long").alias("n19"),
        F.max(F.when(F.col("year_dx") == 2020, F.col("n"))).cast("long").alias("n20"),
    )
    sheets = []
    for province, suffix in (("Papua", ""), ("West Papua", ".00")):
        body = wide.filter(F.col("province") == province)
        total = body.agg(F.lit("Jumlah").alias("city"), F.sum("n19").alias("n19"), F.sum("n20").alias("n20"))
        rows = body.select("city", "n19", "n20").unionByName(total).select(
            "city", F.col("n19").cast("string").alias("year_18"),
            F.concat(F.col("n19").cast("string"), F.lit(suffix)).alias("year_19"),
            F.concat(F.col("n20").cast("string"), F.lit(suffix)).alias("year_20"),
        )
        heading = spark.range(1).select(
            F.lit(None).cast("string").alias("city"), *[F.lit(f"20{y}").alias(f"year_{y}") for y in (18, 19, 20)]
        )
        sheets.append(heading.unionByName(rows))
    return sheets[0], sheets[1].drop("year_18")


def study_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the districts of the study area."""
    return _study_places(spark, sf_dir).select("city")


def official_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official number of units ``n_hu_web`` by (province, city), above the suppliers of some districts."""
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    joined = suppliers.join(F.broadcast(_study_places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
    extra = (F.col("n_nationkey") % 3) * F.lit(3)
    return joined.select("province", "city", (F.col("suppliers") + extra).cast("double").alias("n_hu_web"))


def _orders_by_month(spark: SparkSession, sf_dir: str, part_2010: bool = True) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    year = F.year("o_orderdate") + 18
    if part_2010:
        # The first quarter of 1995 stands for 2010.
        early = (F.year("o_orderdate") == 1995) & (F.quarter("o_orderdate") == 1)
        year = F.when(early, 2010).otherwise(year)
    # Orders are counted per customer and month before they meet the customer's district.
    monthly = orders.groupBy("o_custkey", year.alias("YEAR"), F.month("o_orderdate").alias("MONTH")).agg(
        F.count_if(F.col("o_orderstatus") != "P").alias("by_sex"),
        F.count_if(F.col("o_orderpriority") != "5-LOW").alias("by_species"),
    )
    owners = broadcast_if_small(customer.select("c_custkey", "c_nationkey"), customer)
    joined = monthly.join(owners, F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.groupBy("c_nationkey", "YEAR", "MONTH").agg(
        F.sum("by_sex").cast("double").alias("by_sex"), F.sum("by_species").cast("double").alias("by_species")
    )
    return counts.join(F.broadcast(districts(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))


def aggregate_series(spark: SparkSession, sf_dir: str, part_2010: bool = True) -> DataFrame:
    """Reported monthly totals for 2010 and 2013 to 2019 without 2018; some totals by sex are missing.

    Without ``part_2010`` the months that stand for 2010 are those of 2013.
    """
    rows = _orders_by_month(spark, sf_dir, part_2010)
    # As in the source, the reported series covers the two study provinces only.
    rows = rows.filter((F.col("YEAR") != 2018) & F.col("raw_province").isin(cb.SURVEY_PROVINCES))
    missing = (F.col("MONTH") == 7) & (F.col("n_nationkey") % 11 == 3)
    return rows.select(
        "YEAR",
        "MONTH",
        F.col("raw_province").alias("ADMIN1"),
        F.col("raw_district").alias("ADMIN2"),
        F.when(~missing, F.col("by_sex")).alias("POS_GENDER_TOTAL"),
        F.col("by_species").alias("POS_SPECIES_TOTAL"),
    )


def month_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2018 month tables, tagged with their month; some counts are blank."""
    rows = _orders_by_month(spark, sf_dir).filter(F.col("YEAR") == 2018)
    blank = (F.col("MONTH") + F.col("n_nationkey")) % 13 == 0
    return rows.select(
        title_case("raw_province").alias("Provinsi"),
        F.col("raw_district").alias("Kabupaten/Kota"),
        F.when(~blank, F.col("by_species")).alias("Positif"),
        F.col("MONTH").alias("month"),
        F.expr(f"{_array(MONTH_PARTS)}[MONTH - 1]").alias("part"),
    )


def admin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Administrative list in raw upper case."""
    return districts(spark, sf_dir).select(
        F.col("raw_province").alias("ADMIN1"),
        F.concat(F.lit("D"), F.col("n_nationkey").cast("string")).alias("IDADMIN2"),
        F.col("raw_district").alias("ADMIN2"),
    )


def age_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population by (district, five-year band, year) for 2018 to 2020, from customers by key."""
    customers = table(spark, sf_dir, "customer").groupBy(
        "c_nationkey", (F.col("c_custkey") % len(cb.AGE_BANDS)).alias("band")
    ).agg(F.count(F.lit(1)).alias("customers"))
    return customers.select(
        F.concat(F.lit("D"), F.col("c_nationkey").cast("string")).alias("IDADMIN2"),
        F.expr(f"{_array(cb.AGE_BANDS)}[band]").alias("AGE.GROUP"),
        F.explode(F.array(F.lit(2018), F.lit(2019), F.lit(2020))).alias("YEAR"),
        (F.col("customers") * 1000.0).alias("POP"),
    )


def map_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map regions (NAME_1, NAME_2, id); one has an old name, and those of another province are there too."""
    old_name = F.when(F.col("n_nationkey") == 5, "Teluk Lama").otherwise(title_case("raw_district"))
    return districts(spark, sf_dir).select(
        title_case("raw_province").alias("NAME_1"),
        old_name.alias("NAME_2"),
        F.col("n_nationkey").cast("string").alias("id"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline vertices, one per supplier, of the regions on the map."""
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") % 360).cast("double").alias("long"),
        (F.col("s_suppkey") % 90).cast("double").alias("lat"),
        F.concat(F.col("s_nationkey").cast("string"), F.lit(".1")).alias("group"),
        F.col("s_nationkey").cast("string").alias("id"),
    )
