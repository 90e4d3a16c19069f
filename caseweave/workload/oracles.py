"""The registered queries once more, as SQL over the benchmark tables.

The SQL is written on its own terms (plain windows, no blocks, no allocation
helper), so that it checks the operators and does not repeat them.
"""

from __future__ import annotations

from caseweave import codebooks as cb
from caseweave.operators.smoothing import t_quantile
from caseweave.workload.inputs import DISTRICT_OF_NATION, FACILITY_PREFIXES, OCCUPATIONS, PROVINCE_OF_REGION
from caseweave.workload.queries import CHECK_REPLICATES, CHECK_SEED


def _case(column: str, pairs: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in pairs.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def _lit(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _list(values) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _title(column: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({column}, '[^ -]+|[ -]+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def _bands(column: str, breaks, labels) -> str:
    arms = " ".join(f"WHEN {column} < {b} THEN {_lit(label)}" for b, label in zip(breaks, labels))
    return f"CASE WHEN {column} IS NULL THEN NULL {arms} ELSE {_lit(labels[-1])} END"


def _fine_age(column: str) -> str:
    return (
        f"CASE WHEN {column} >= 75 THEN '75+' WHEN {column} IS NOT NULL THEN "
        f"((floor({column} / 5) * 5)::INT)::VARCHAR || '-' || ((floor({column} / 5) * 5 + 4)::INT)::VARCHAR END"
    )


def _values(rows: list[tuple], name: str, columns: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


PF, PV, MIXED, OTHER = (_lit(v) for v in (cb.PF, cb.PV, cb.MIXED, cb.OTHER))
SEX_SPECIES = "CASE " + " ".join(
    f"WHEN sex = {_lit(sex)} AND sp = {_lit(sp)} THEN {_lit(label)}" for (sex, sp), label in cb.SEX_SPECIES.items()
) + " END"

YEAR_WITH_2010 = "CASE WHEN o_orderdate >= '1995-01-01' AND o_orderdate < '1995-04-01' THEN 2010 ELSE year(o_orderdate) + 18 END"
INPUTS = f"""
place AS (
  SELECT n_nationkey,
         {_case("r_regionkey", PROVINCE_OF_REGION)} AS raw_province,
         {_case("n_nationkey", DISTRICT_OF_NATION, "'TELUK-' || n_name")} AS raw_district
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
raw0 AS (
  SELECT *, CASE WHEN l_orderkey % 997 = 0 THEN 2021 WHEN year(l_shipdate) % 2 = 1 THEN 2019 ELSE 2020 END AS tahun,
         (['-', '/', ' '])[l_linenumber % 3 + 1] AS sepa,
         CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'L' END AS sex_code
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey
),
raw AS (
  SELECT l_orderkey || '-' || l_linenumber AS id,
         CASE WHEN l_orderkey % 31 = 0 THEN 'tidak ada' WHEN l_orderkey % 23 <> 0
              THEN day(l_shipdate) || sepa || month(l_shipdate) || sepa || tahun END AS tglkun,
         tahun,
         CASE WHEN l_orderkey % 29 = 0 THEN 13 ELSE month(l_shipdate) END AS bulankun,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 37 = 0 THEN 'Pm' WHEN l_partkey % 41 = 0 THEN 'Mix'
              WHEN l_returnflag = 'A' THEN 'Pf' WHEN l_returnflag = 'N' THEN 'Pv'
              WHEN tahun = 2019 THEN 'Pmix' WHEN tahun = 2020 THEN 'Mix' END AS parasit,
         CASE WHEN l_partkey % 19 <> 0 THEN l_quantity * 2 - 1 END AS umur_th,
         CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN tahun = 2020 OR l_partkey % 43 = 0 THEN lower(sex_code)
              ELSE sex_code END AS jnskel,
         raw_province AS nama_propinsi, raw_district AS nama_kabupaten,
         CASE WHEN s_suppkey % 97 <> 50 THEN ({_list(FACILITY_PREFIXES)})[s_suppkey % 8 + 1] || s_suppkey END AS nama_fasyankes,
         CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber = 4 THEN 2 ELSE 1 END AS derajat,
         (['RJ (rawat jalan)', 'Ri', '-'])[l_suppkey % 3 + 1] AS p_rawat,
         (['Mikroskop', 'RDT', 'PCR', 'Lain'])[l_partkey % 4 + 1] AS lab,
         CASE WHEN l_orderkey % 50 = 0 THEN 'Ya' WHEN l_orderkey % 3 <> 0 THEN 'Tidak' END AS kematian,
         ({_list(OCCUPATIONS)})[l_partkey % {len(OCCUPATIONS)} + 1] AS pekerjaan
  FROM raw0
),
dated AS (
  SELECT *, try_strptime(tglkun, ['%d-%m-%Y', '%d/%m/%Y', '%d %m %Y'])::DATE AS parsed,
         coalesce(try_strptime(tglkun, ['%d-%m-%Y', '%d/%m/%Y', '%d %m %Y'])::DATE,
                  CASE WHEN bulankun <= 12 THEN make_date(tahun::BIGINT, bulankun::BIGINT, 1) END) AS date_dx
  FROM raw
),
recoded AS (
  SELECT id, date_dx, week(date_dx) AS week_dx, month(date_dx) AS month_dx, year(date_dx) AS year_dx,
         {_title("nama_propinsi")} AS province, {_title("nama_kabupaten")} AS city,
         CASE WHEN date_dx IS NULL OR year(date_dx) NOT IN (2019, 2020) THEN NULL WHEN parasit = 'Pf' THEN {PF} WHEN parasit = 'Pv' THEN {PV}
              WHEN parasit = 'Pm' THEN 'Other'
              WHEN parasit = 'Pmix' AND year(date_dx) = 2019 THEN {MIXED}
              WHEN parasit = 'Mix' AND year(date_dx) = 2020 THEN {MIXED} END AS sp,
         umur_th AS age, {_fine_age("umur_th")} AS age_cat,
         CASE WHEN jnskel = 'L' AND year(date_dx) IN (2019, 2020) OR jnskel = 'l' AND year(date_dx) = 2020 THEN 'Male'
              WHEN jnskel = 'P' AND year(date_dx) IN (2019, 2020) OR jnskel = 'p' AND year(date_dx) = 2020 THEN 'Female' END AS sex,
         {_title("nama_fasyankes")} AS health_unit,
         CASE WHEN contains(lower(nama_fasyankes), 'puskesmas') OR contains(lower(nama_fasyankes), 'pkm') THEN 'Health centre'
              WHEN contains(lower(nama_fasyankes), 'rumah sakit') OR contains(lower(nama_fasyankes), 'rs') THEN 'Hospital'
              WHEN contains(lower(nama_fasyankes), 'klinik') OR contains(lower(nama_fasyankes), 'bp') THEN 'Clinic'
              ELSE 'Other' END AS hu_type,
         {_case("derajat", cb.SEVERITY_CODES)} AS severe,
         CASE WHEN p_rawat ILIKE '%rj%' THEN 'Outpatient' WHEN p_rawat ILIKE '%ri%' THEN 'Inpatient' END AS adm_stat,
         {_case("lab", cb.LAB_CODES)} AS lab,
         CASE WHEN kematian ILIKE '%ya%' THEN TRUE WHEN kematian ILIKE '%tidak%' THEN FALSE END AS death,
         {_case("pekerjaan", cb.OCCUPATION_CODES)} AS occupation
  FROM dated
),
line AS (
  SELECT * REPLACE (CASE province WHEN 'Papua Barat' THEN 'West Papua' ELSE province END AS province)
  FROM recoded WHERE province IN ('Papua', 'Papua Barat') AND year_dx IN (2019, 2020)
),
study AS (
  SELECT n_nationkey, CASE raw_province WHEN 'PAPUA' THEN 'Papua' ELSE 'West Papua' END AS province,
         {_title("raw_district")} AS city
  FROM place WHERE raw_province IN ('PAPUA', 'PAPUA BARAT')
),
population AS (
  SELECT y.year_dx, province, city, (count(*) * y.factor)::DOUBLE AS n
  FROM customer JOIN study ON c_nationkey = n_nationkey CROSS JOIN (VALUES (2019, 1000), (2020, 1020)) y(year_dx, factor)
  GROUP BY y.year_dx, y.factor, province, city
),
official AS (
  SELECT province, city, (count(*) + 3 * (n_nationkey % 3))::DOUBLE AS n_hu_web
  FROM supplier JOIN study ON s_nationkey = n_nationkey GROUP BY province, city, n_nationkey
),
monthly_orders AS (
  SELECT n_nationkey, raw_province, raw_district, {YEAR_WITH_2010} AS yr, month(o_orderdate) AS mon,
         (count(*) FILTER (o_orderstatus <> 'P'))::DOUBLE AS by_sex,
         (count(*) FILTER (o_orderpriority <> '5-LOW'))::DOUBLE AS by_species
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey GROUP BY ALL
),
reported AS (
  SELECT yr, mon, raw_province, raw_district,
         CASE WHEN NOT (mon = 7 AND n_nationkey % 11 = 3) THEN by_sex END AS by_sex, by_species
  FROM monthly_orders WHERE yr <> 2018 AND raw_province IN ('PAPUA', 'PAPUA BARAT')
),
reported_series AS (
  SELECT yr AS year, mon AS month, make_date(yr, mon, 1) AS date,
         CASE raw_province WHEN 'PAPUA' THEN 'Papua' ELSE 'West Papua' END AS province, {_title("raw_district")} AS city,
         CASE WHEN by_sex IS NOT NULL THEN greatest(by_sex, by_species) END AS "case"
  FROM reported
),
month_tables AS (
  SELECT mon AS month, {_title("raw_province")} AS prov, raw_district AS city,
         CASE WHEN (mon + n_nationkey) % 13 <> 0 THEN by_species END AS "case"
  FROM monthly_orders WHERE yr = 2018
),
merged AS (
  SELECT year, month, date, province, city, "case", 'reported' AS source FROM reported_series WHERE year < 2018
  UNION ALL
  SELECT 2018, month, make_date(2018, month, 1), CASE prov WHEN 'Papua' THEN prov ELSE 'West Papua' END,
         {_title("city")}, coalesce("case", 0.0), 'parts'
  FROM month_tables WHERE prov IN ('Papua', 'Papua Barat')
  UNION ALL
  SELECT year_dx, month_dx, make_date(year_dx, month_dx, 1), province, city, count(*)::DOUBLE, 'line'
  FROM line GROUP BY 1, 2, 3, 4, 5
)
"""


# A table without 2010 takes the series that has no such part, so that no order is lost to it.
INPUTS_WITHOUT_2010 = INPUTS.replace(YEAR_WITH_2010, "year(o_orderdate) + 18")


def _sql(body: str, *ctes: str, inputs: str = INPUTS) -> str:
    return "WITH " + ", ".join([inputs, *ctes]) + body


PROVINCE_POPULATION = _values(cb.province_population_rows(), "province_pop", "year, province, pop")
SEX_POPULATION = _values(cb.province_sex_rows(), "sex_pop", "province, year_dx, sex, pop")
AGE_POPULATION = _values(cb.province_age_rows(), "age_pop", "province, sex, age_cat, pop")
CITY_SEX_POPULATION = _values(cb.district_sex_rows(), "city_sex_pop", "city, sex, pop")
CITY_AGE_POPULATION = _values(cb.district_age_rows(), "city_age_pop", "city, sex, age_cat, pop")


def _wide(keys: str, rows: str = "line", where: str = "TRUE") -> str:
    """Species counts per key, NULL where there is no row."""
    count = "nullif(count(*) FILTER (sp = {}), 0)::DOUBLE AS {}"
    cells = ", ".join(count.format(value, name) for value, name in ((PF, "pf"), (PV, "pv"), (MIXED, "mixed"), (OTHER, "other")))
    return f"SELECT {keys}, {cells} FROM {rows} WHERE {where} GROUP BY {keys}"


def _alloc(keys: str, rule: str, weight: float = 0.5, where: str = "TRUE", value: str = '"case"') -> str:
    """Two rows per key with the mixed count spread over both species."""
    listed = f"sp IN ({PF}, {PV}, {MIXED}) AND ({where})"
    mixed = "mixed" if rule == "strict" else "coalesce(mixed, 0)"
    own = "coalesce({0}, 0)" if rule == "zero" else "{0}"
    halves = [
        f"SELECT {keys}, {label} AS sp, {own.format(column)} + {weight} * {mixed} AS {value} FROM ({_wide(keys, where=listed)})"
        for label, column in ((PF, "pf"), (PV, "pv"))
    ]
    return " UNION ALL ".join(halves)


DISTRICT = "year_dx, province, city"
RATES = f"""rates AS (
  SELECT a.*, n AS pop, "case" / n * 1000 AS api
  FROM ({_alloc(DISTRICT, "zero")}) a LEFT JOIN population USING ({DISTRICT}))"""
API = f"""api AS (
  SELECT {DISTRICT}, count(*) AS "case", any_value(n) AS pop, count(*) / any_value(n) * 1000 AS api
  FROM line LEFT JOIN population USING ({DISTRICT}) GROUP BY {DISTRICT})"""
OBSERVED = """observed AS (
  SELECT year_dx, province, city, count(*) AS k FROM (SELECT DISTINCT year_dx, province, city, health_unit FROM line)
  GROUP BY ALL),
estimate AS (
  SELECT province, city, a.k AS n_hu_obs20, n_hu_web, b.k AS n_hu_obs19,
         greatest(a.k::DOUBLE, n_hu_web, b.k::DOUBLE) AS n_hu
  FROM (SELECT * FROM observed WHERE year_dx = 2020) a FULL JOIN official USING (province, city)
  FULL JOIN (SELECT * FROM observed WHERE year_dx = 2019) b USING (province, city))"""
UNIT_KEYS = f"{DISTRICT}, health_unit"
UNITS = f"""{OBSERVED},
unit_rates AS (
  SELECT {DISTRICT}, health_unit, sp, case_hu, n AS pop_city, n_hu, n / n_hu AS pop_hu, case_hu / (n / n_hu) * 1000 AS api_hu
  FROM ({_alloc(UNIT_KEYS, "zero", value="case_hu")}) LEFT JOIN population USING ({DISTRICT})
  LEFT JOIN estimate USING (province, city)),
padded AS (
  SELECT *, 0 AS pad FROM unit_rates
  UNION ALL
  SELECT {DISTRICT}, NULL, sp, 0.0, pop_city, n_hu, pop_hu, 0.0, unnest(range(1, (n_hu - k + 1)::BIGINT))
  FROM (SELECT {DISTRICT}, sp, any_value(pop_city) AS pop_city, any_value(n_hu) AS n_hu, any_value(pop_hu) AS pop_hu,
               count(*) AS k FROM unit_rates GROUP BY {DISTRICT}, sp)
  WHERE n_hu > k)"""
STRATA = "year_dx, province, sp"


def _curve(source: str, cases: str, pop: str, tie: str, strata: str = STRATA) -> str:
    window = f"PARTITION BY {strata} ORDER BY {cases} / {pop} DESC NULLS LAST, {tie}"
    return f"""curve AS (
      SELECT *, sum({cases}) OVER w AS case_cumsum, sum({pop}) OVER w AS pop_cumsum,
             sum({cases}) OVER w / nullif(sum({cases}) OVER t, 0) AS c_i,
             sum({pop}) OVER w / nullif(sum({pop}) OVER t, 0) AS p_i,
             row_number() OVER w AS pos
      FROM {source} WINDOW w AS ({window} ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY {strata}))"""


def _gini(strata: str = STRATA, origin: bool = True) -> str:
    start = "0" if origin else "NULL"
    return f"""gini AS (
      SELECT {strata}, 2 * sum(0.5 * (p_i - p0) * (c_i + c0)) - 1 AS g
      FROM (SELECT *, lag(p_i, 1, {start}) OVER (PARTITION BY {strata} ORDER BY pos) AS p0,
                   lag(c_i, 1, {start}) OVER (PARTITION BY {strata} ORDER BY pos) AS c0 FROM curve)
      GROUP BY {strata})"""


DISTRICT_CURVE = _curve("rates", '"case"', "pop", "city")
UNIT_CURVE = _curve("padded", "case_hu", "pop_hu", "city, health_unit NULLS LAST, pad")
PER_DISTRICT = f"""{OBSERVED},
shared AS (
  SELECT {DISTRICT}, health_unit, count(*)::DOUBLE AS "case", any_value(n) / any_value(n_hu) AS pop, any_value(n_hu) AS n_hu
  FROM line LEFT JOIN population USING ({DISTRICT}) LEFT JOIN estimate USING (province, city)
  GROUP BY {DISTRICT}, health_unit),
all_units AS (
  SELECT {DISTRICT}, health_unit, "case", pop, 0 AS pad FROM shared
  UNION ALL
  SELECT {DISTRICT}, NULL, 0.0, pop, unnest(range(1, (n_hu - k + 1)::BIGINT))
  FROM (SELECT {DISTRICT}, any_value(pop) AS pop, any_value(n_hu) AS n_hu, count(*) AS k FROM shared GROUP BY {DISTRICT})
  WHERE n_hu > k),
{_curve("all_units", '"case"', "pop", "health_unit NULLS LAST, pad", DISTRICT)}"""


# The five primes of XXH64.
XX_PRIMES = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]


def _xxh64(source: str, value: str, seed: str) -> str:
    """Subquery that adds ``_x``: XXH64 of an 8-byte number with a seed, in unsigned steps that do not overflow."""
    def times(factor: int) -> str:
        low, high = factor % 2**32, factor // 2**32
        return f"""((((_x % 4294967296) * {high} % 4294967296) + ((_x // 4294967296) * {low} % 4294967296) + ((_x % 4294967296) * {low} // 4294967296))
                   % 4294967296 * 4294967296 + (_x % 4294967296) * {low} % 4294967296)"""

    def turned(by: int) -> str:
        return f"((_x % {2 ** (64 - by)}) * {2**by} + (_x >> {64 - by}))"

    def plus(x: str, more: int) -> str:
        return f"(CASE WHEN {x} >= {2**64 - more} THEN {x} - {2**64 - more} ELSE {x} + {more} END)"

    steps = [
        times(XX_PRIMES[1]), turned(31), times(XX_PRIMES[0]), f"xor(_x, {plus(f'({seed})::UBIGINT', XX_PRIMES[4] + 8)})",
        turned(27), times(XX_PRIMES[0]), plus("_x", XX_PRIMES[3]), "xor(_x, _x >> 33)", times(XX_PRIMES[1]),
        "xor(_x, _x >> 29)", times(XX_PRIMES[2]), "xor(_x, _x >> 32)",
    ]
    sql = f"(SELECT *, ({value})::UBIGINT AS _x FROM {source})"
    for step in steps:
        sql = f"(SELECT * REPLACE (({step})::UBIGINT AS _x) FROM {sql})"
    return sql


def _bootstrap(source: str, cases: str, pop: str, tie: str, origin: bool, hashed: bool = False) -> str:
    key = f"concat_ws('|', '{CHECK_SEED}', year_dx, province, sp, rep, d)"
    picked = f"SELECT {STRATA}, rep, d, ('0x' || substr(md5({key}), 1, 8))::BIGINT % n AS pick FROM draws"
    if hashed:
        key = f"('0x' || substr(md5(concat_ws('|', '{CHECK_SEED}', year_dx, province, sp, rep)), 1, 15))::BIGINT"
        seeded = _xxh64("reps", key, "42")
        drawn = _xxh64(f"(SELECT * EXCLUDE (_x), _x AS _seed, unnest(range(n)) AS d FROM {seeded})", "d", "_seed")
        picked = f"SELECT {STRATA}, rep, d, ((_x >> 1)::BIGINT % n)::BIGINT AS pick FROM {drawn}"
    start = "0" if origin else "NULL"
    return f"""numbered AS (
      SELECT {STRATA}, {cases} AS c, {pop} AS p,
             row_number() OVER (PARTITION BY {STRATA} ORDER BY {cases} / {pop} DESC NULLS LAST, {tie}) - 1 AS pick
      FROM {source}),
    sizes AS (SELECT {STRATA}, count(*) AS n FROM numbered GROUP BY {STRATA}),
    reps AS (SELECT *, unnest(range({CHECK_REPLICATES})) AS rep FROM sizes),
    draws AS (SELECT *, unnest(range(n)) AS d FROM reps),
    picked AS ({picked}),
    drawn AS (
      SELECT {STRATA}, rep, pick, d,
             sum(c) OVER w / nullif(sum(c) OVER t, 0) AS c_i, sum(p) OVER w / nullif(sum(p) OVER t, 0) AS p_i
      FROM picked JOIN numbered USING ({STRATA}, pick)
      WINDOW w AS (PARTITION BY {STRATA}, rep ORDER BY pick, d ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY {STRATA}, rep)),
    replicates AS (
      SELECT {STRATA}, rep, 2 * sum(0.5 * (p_i - p0) * (c_i + c0)) - 1 AS g
      FROM (SELECT *, lag(p_i, 1, {start}) OVER v AS p0, lag(c_i, 1, {start}) OVER v AS c0 FROM drawn
            WINDOW v AS (PARTITION BY {STRATA}, rep ORDER BY pick, d))
      GROUP BY {STRATA}, rep)"""


INTERVAL = f"""
SELECT {STRATA}, round(100 * quantile_cont(g, 0.025), 6) AS lci, round(100 * quantile_cont(g, 0.975), 6) AS uci
FROM replicates GROUP BY {STRATA}"""
DISTRICT_BOOT = _bootstrap("rates", '"case"', "pop", "city", True)
DISTRICT_BOOT_PARITY = _bootstrap("rates", '"case"', "pop", "city", False)
UNIT_TIE = "city, health_unit NULLS LAST, pad"
UNIT_BOOT = _bootstrap("padded", "case_hu", "pop_hu", UNIT_TIE, True)
DISTRICT_BOOT_HASHED = _bootstrap("rates", '"case"', "pop", "city", True, True)
UNIT_BOOT_HASHED = _bootstrap("padded", "case_hu", "pop_hu", UNIT_TIE, True, True)
UNIT_BOOT_PARITY_HASHED = _bootstrap("padded", "case_hu", "pop_hu", UNIT_TIE, False, True)
UNIT_BOOT_PARITY = _bootstrap("padded", "case_hu", "pop_hu", UNIT_TIE, False)

PEOPLE = f"""admin AS (
  SELECT n_nationkey, {_title("raw_province")} AS province, {_title("raw_district")} AS district FROM place
  WHERE raw_province IN ('PAPUA', 'PAPUA BARAT')
     OR raw_province = '{cb.SURVEY_EXTRA_PROVINCE}' AND raw_district IN ({", ".join(_lit(d) for d in cb.SURVEY_EXTRA_DISTRICTS)})),
people AS (
  SELECT province, district, y.year, {_bands("(c_custkey % 16) * 5", cb.COARSE_AGE_BREAKS, cb.COARSE_AGE_BANDS)} AS age_cat,
         count(*) * 1000.0::DOUBLE AS pop
  FROM customer JOIN admin ON c_nationkey = n_nationkey CROSS JOIN (VALUES (2019), (2020)) y(year) GROUP BY ALL),
survey AS (
  SELECT {_title("nama_propinsi")} AS province, {_title("nama_kabupaten")} AS district, tahun AS year,
         {_bands("umur_th", cb.COARSE_AGE_BREAKS, cb.COARSE_AGE_BANDS)} AS age_cat, parasit
  FROM raw WHERE tahun IN (2019, 2020) AND (nama_propinsi IN ('PAPUA', 'PAPUA BARAT') OR
       nama_propinsi = '{cb.SURVEY_EXTRA_PROVINCE}' AND nama_kabupaten IN ({", ".join(_lit(d) for d in cb.SURVEY_EXTRA_DISTRICTS)}))),
survey_wide AS (
  SELECT province, district, year, age_cat, count(*) FILTER (parasit = 'Pf')::DOUBLE AS pf,
         count(*) FILTER (parasit = 'Pv')::DOUBLE AS pv, count(*) FILTER (parasit IN ('Mix', 'Pmix'))::DOUBLE AS mixed
  FROM survey GROUP BY ALL)"""


def _survey_rates(join: str) -> str:
    halves = [
        f"""SELECT province, district, year, age_cat, round(pop, 6) AS pop, {label} AS sp,
                   coalesce({column}, 0) + coalesce(mixed, 0) AS cases,
                   round((coalesce({column}, 0) + coalesce(mixed, 0)) / pop * 1000, 6) AS api
            FROM survey_wide {join} people USING (province, district, year, age_cat)"""
        for label, column in ((PF, "pf"), (PV, "pv"))
    ]
    return " UNION ALL ".join(halves)


def _pareto(where: str, strata: str = "") -> str:
    partition = f"PARTITION BY {strata}" if strata else ""
    prefix = f"{strata}, " if strata else ""
    return f"""
    SELECT {prefix}health_unit, n, (sum(n) OVER w)::BIGINT AS cumsum,
           round(100.0 * sum(n) OVER w / sum(n) OVER t, 6) AS cumprop
    FROM (SELECT {prefix}health_unit, count(*) AS n FROM line WHERE {where} GROUP BY ALL)
    WINDOW w AS ({partition} ORDER BY n DESC, health_unit NULLS LAST ROWS UNBOUNDED PRECEDING), t AS ({partition})"""


REGIONS = f"""map_region AS (
  SELECT {_title("raw_province")} AS NAME_1,
         CASE WHEN n_nationkey = 5 THEN 'Teluk Lama' ELSE {_title("raw_district")} END AS NAME_2,
         n_nationkey::VARCHAR AS id FROM place),
vertex AS (
  SELECT (s_suppkey % 360)::DOUBLE AS long, (s_suppkey % 90)::DOUBLE AS lat,
         s_nationkey::VARCHAR || '.1' AS "group", s_nationkey::VARCHAR AS id FROM supplier)"""


def _region(values: str, column: str, breaks, labels, name: str, highest_first: bool = True) -> str:
    places = range(len(labels), 0, -1) if highest_first else range(1, len(labels) + 1)
    return f"""
    SELECT id, long, lat, "group", NAME_2, round({column}, 6) AS {column}, NAME_1, {_bands(column, breaks, labels)} AS {name},
           {_bands(column, breaks, places)} AS {name.removesuffix("_cat")}_ord
    FROM vertex FULL JOIN (SELECT * FROM ({values}) FULL JOIN map_region USING (NAME_2)) USING (id)"""


def _grid_points(points: int) -> str:
    return f"(SELECT unnest(range({points})) AS i)"


LOESS_SUMS = ", ".join(f"sum(w * u ** {k}) AS s{k}" for k in range(5)) + ", " + ", ".join(
    f"sum(w * y * u ** {k}) AS t{k}" for k in range(3)
)


def _loess(measure: str) -> str:
    return f"""
    SELECT '{measure}' AS measure, year_dx, round(x0, 4) AS log10_x,
           round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2))
               / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)), 4) AS fit
    FROM (SELECT year_dx, i, x0, {LOESS_SUMS}
          FROM (SELECT *, CASE WHEN abs(u) < h THEN (1 - (abs(u) / h) ** 3) ** 3 ELSE 0 END AS w
                FROM (SELECT *, x - x0 AS u, greatest(x0 - lo, hi - x0) AS h
                      FROM (SELECT p.*, i, lo + (hi - lo) * i / 79 AS x0
                            FROM (SELECT year_dx, log10(api) AS x, {measure} AS y,
                                         min(log10(api)) OVER (PARTITION BY year_dx) AS lo,
                                         max(log10(api)) OVER (PARTITION BY year_dx) AS hi
                                  FROM profile WHERE api BETWEEN 0.1 AND 1000 AND {measure} BETWEEN 0 AND 1) p, {_grid_points(80)})))
          GROUP BY year_dx, i, x0)"""


PROFILE = f"""profile AS (
  SELECT {DISTRICT}, count(*) AS "case",
         count(*) FILTER (sex = 'Male') / count(*) AS male_prop,
         count(*) FILTER (age >= 18) / count(*) AS adult_prop,
         count(*) FILTER (sp IN ({PV}, {MIXED})) / count(*) AS vivax_prop,
         any_value(n) AS pop, count(*) / any_value(n) * 1000 AS api
  FROM line LEFT JOIN population USING ({DISTRICT}) GROUP BY {DISTRICT})"""
T_TABLE = _values([(d, t_quantile(d)) for d in range(1, 61)], "t_table", "df, t")

GINI_SELECT = f"SELECT {STRATA}, round(g, 6) AS g, round(round(g, 3) * 100, 6) AS g_percent FROM gini"
LORENZ_TAIL = "round(case_cumsum, 6) AS case_cumsum, round(pop_cumsum, 6) AS pop_cumsum, round(c_i, 6) AS c_i, round(p_i, 6) AS p_i"
MONTH_KEYS = f"{DISTRICT}, month_dx, sex"
ALLOC_KEYS = f"{MONTH_KEYS}, age_cat"


def _rounded_alloc(rule: str, weight: float = 0.5) -> str:
    return _sql(f'SELECT {ALLOC_KEYS}, sp, round("case", 6) AS "case" FROM ({_alloc(ALLOC_KEYS, rule, weight)})')


def _age_sex(place: str, where: str, population: str, api: str, tail: str = "TRUE") -> str:
    keys = f"{place}, age_cat, sex"
    rate = "annual_case / pop * 1000"
    return f"""
    SELECT {keys}, sp, annual_case, pop, round({api.format(rate)}, 6) AS api, {SEX_SPECIES} AS cat
    FROM ({_alloc(keys, "lenient", where=where, value="annual_case")}) LEFT JOIN {population} USING ({keys}) WHERE {tail}"""


FOCUS = ", ".join(_lit(d) for d in cb.FOCUS_DISTRICTS)
UNIT_SCORE = _case("hu_type", {t: i for i, t in enumerate(cb.UNIT_TYPES, 1)})
UNIT_ORDER = _case("hu_type", {t: i for i, t in enumerate(cb.UNIT_TYPES_DISPLAY, 1)})
OTHER_ROWS = f"other AS (SELECT * FROM line WHERE sp = {OTHER})"

ORACLES: dict[str, str] = {
    "cleaned_line_list": _sql(f"""
        SELECT id, province, city, n, date_dx, week_dx, month_dx, year_dx, sp, age, age_cat, sex, health_unit, hu_type,
               severe, adm_stat, lab, death, occupation FROM line LEFT JOIN population USING ({DISTRICT})"""),
    "labelled_columns": _sql(" UNION ALL ".join(
        f"SELECT {_lit(column)} AS \"column\", {_lit(label)} AS label, count({column}) AS known FROM line LEFT JOIN population USING ({DISTRICT})"
        for column, label in cb.LINE_LIST_LABELS.items())),
    "rejects_by_reason": _sql("""
        SELECT reason, year_dx, count(*) AS rows FROM (
          SELECT year_dx, CASE WHEN province NOT IN ('Papua', 'Papua Barat') THEN 'other province'
                               WHEN year_dx IS NULL THEN 'year missing'
                               WHEN year_dx NOT IN (2019, 2020) THEN 'other year' END AS reason FROM recoded)
        WHERE reason IS NOT NULL GROUP BY ALL"""),
    "rejects_observed": _sql("""
        SELECT reason, count(n)::BIGINT AS rows
        FROM (VALUES ('other province'), ('year missing'), ('other year'), ('kept')) AS r(reason) LEFT JOIN (
          SELECT 1 AS n, coalesce(CASE WHEN province NOT IN ('Papua', 'Papua Barat') THEN 'other province'
                               WHEN year_dx IS NULL THEN 'year missing'
                               WHEN year_dx NOT IN (2019, 2020) THEN 'other year' END, 'kept') AS reason FROM recoded) USING (reason)
        GROUP BY reason"""),
    "date_repair": _sql("""
        SELECT id, date_dx, week(date_dx) AS week, strftime(date_dx, '%b') AS month_label, parsed IS NULL AS repaired FROM dated"""),
    "recode_by_vintage": _sql("SELECT year_dx, sp, sex, count(*) AS \"case\" FROM recoded GROUP BY ALL"),
    "recode_dictionaries": _sql(f"""
        SELECT {_case("derajat", cb.SEVERITY_CODES)} AS severe, {_case("lab", cb.LAB_CODES)} AS lab,
               {_case("pekerjaan", cb.OCCUPATION_CODES)} AS occupation,
               CASE WHEN parasit IS NULL OR parasit = '' THEN NULL WHEN parasit = 'Pf' THEN {PF} WHEN parasit = 'Pv' THEN {PV}
                    WHEN parasit IN ('Mix', 'Pmix') THEN 'Mixed' ELSE 'Other' END AS coarse_sp,
               count(*) AS "case" FROM raw GROUP BY ALL"""),
    "classify_text": _sql('SELECT health_unit, hu_type, adm_stat, death, count(*) AS "case" FROM recoded GROUP BY ALL'),
    "bin_ages": _sql(f"""
        SELECT {_fine_age("umur_th")} AS age_cat, CASE WHEN umur_th < 75 THEN floor(umur_th / 5) + 1 WHEN umur_th >= 75 THEN 16 END::BIGINT AS ord,
               {_bands("umur_th", cb.COARSE_AGE_BREAKS, cb.COARSE_AGE_BANDS)} AS coarse_age_cat, count(*) AS "case"
        FROM raw GROUP BY ALL"""),
    "title_case_places": f"""
        SELECT c_custkey, {_title("c_mktsegment || '-' || c_name")} AS title, left(c_name, length(c_name) - 3) AS stem FROM customer""",
    "stored_line_list_by_year": _sql(
        'SELECT year_dx, province, sp, count(*) AS "case" FROM line WHERE year_dx = 2020 GROUP BY ALL'),
    "month_parts_by_file": _sql('SELECT month, prov AS province, city, "case" FROM month_tables'),
    "population_from_sheets": _sql("SELECT year_dx, province, city, n FROM population"),
    "population_from_files": _sql("SELECT year_dx, province, city, n FROM population"),
    "official_units_from_file": _sql("SELECT province, city, n_hu_web FROM official"),
    "strict_sum_by_year": _sql("""
        SELECT yr AS YEAR, raw_district AS ADMIN2, CASE WHEN bool_and(by_sex IS NOT NULL) THEN sum(by_sex) END AS strict_total,
               sum(by_sex) AS known_total FROM reported GROUP BY 1, 2"""),
    "strict_greatest_rows": _sql("""
        SELECT yr AS YEAR, mon AS MONTH, raw_province AS ADMIN1, raw_district AS ADMIN2,
               CASE WHEN by_sex IS NULL OR by_species IS NULL THEN NULL WHEN by_sex > by_species THEN by_sex ELSE by_species END AS "case",
               coalesce(greatest(by_sex, by_species), by_sex, by_species) AS known_case FROM reported"""),
    "pivot_species": _sql(_wide(MONTH_KEYS)),
    "unpivot_species": _sql(" UNION ALL ".join(
        f'SELECT {MONTH_KEYS}, {label} AS sp, {column} AS "case" FROM wide'
        for label, column in ((PF, "pf"), (PV, "pv"), (MIXED, "mixed"), (OTHER, "other"))), f"wide AS ({_wide(MONTH_KEYS)})"),
    "allocate_strict": _rounded_alloc("strict"),
    "allocate_lenient": _rounded_alloc("lenient"),
    "allocate_zero": _rounded_alloc("zero"),
    "allocate_full": _rounded_alloc("zero", 1.0),
    "union_by_name": _sql("""
        SELECT province, city, n_hu_web, 'official' AS part, NULL::BIGINT AS n_hu_obs FROM official
        UNION ALL
        SELECT province, city, NULL, 'observed', count(*) FROM (SELECT DISTINCT province, city, health_unit FROM line) GROUP BY 1, 2"""),
    "api_monthly": _sql("""
        SELECT date, province, round("case", 6) AS "case", year, pop, round("case" / pop * 1000, 6) AS api
        FROM (SELECT date, province, year, CASE WHEN bool_and("case" IS NOT NULL) THEN sum("case") END AS "case" FROM merged
              WHERE year <> 2010 GROUP BY ALL) LEFT JOIN province_pop USING (year, province)""", PROVINCE_POPULATION,
        inputs=INPUTS_WITHOUT_2010),
    "weekly_vivax_share": _sql("""
        SELECT year_dx, province, week_dx,
               round((pv + coalesce(mixed, 0) / 2) / (pf + pv + coalesce(mixed, 0) + coalesce(other, 0)), 6) AS prop_pv
        FROM wide""", f"wide AS ({_wide('year_dx, province, week_dx')})"),
    "weekly_vivax_share_axis": _sql("""
        SELECT year_dx, province, week_dx,
               round((pv + coalesce(mixed, 0) / 2) / (pf + pv + coalesce(mixed, 0) + coalesce(other, 0)), 6) AS prop_pv,
               month_label, round(place, 6) AS week_position
        FROM wide LEFT JOIN (
          SELECT strftime(d, '%b') AS month_label, 1 + 52 * dayofyear(d)::DOUBLE / 365 AS place
          FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2020-12-01', INTERVAL 1 MONTH)) AS d)
        ) ON week_dx = floor(place)""", f"wide AS ({_wide('year_dx, province, week_dx')})"),
    "species_levels": _sql(f"""
        SELECT sp, sex, count(*) AS "case", {SEX_SPECIES} AS cat,
               CASE sp WHEN {PF} THEN 1 WHEN {PV} THEN 2 WHEN {MIXED} THEN 3 WHEN {OTHER} THEN 4 END AS sp_ord,
               CASE WHEN sp = {PV} AND sex = 'Male' THEN 1 WHEN sp = {PV} AND sex = 'Female' THEN 2
                    WHEN sp = {PF} AND sex = 'Male' THEN 3 WHEN sp = {PF} AND sex = 'Female' THEN 4 END AS cat_ord
        FROM line GROUP BY sp, sex"""),
    "incidence_month_sex": _sql(f"""
        SELECT province, year_dx, make_date(year_dx, month_dx, 1) AS date, sex, sp, n_case, {SEX_SPECIES} AS cat,
               round(n_case / pop * 1000, 6) AS monthly_perk
        FROM ({_alloc("province, year_dx, month_dx, sex", "strict", where="sex IS NOT NULL", value="n_case")})
        LEFT JOIN sex_pop USING (province, year_dx, sex)""", SEX_POPULATION),
    "api_age_sex": _sql(_age_sex("province", "year_dx = 2020", "age_pop", "{}"), AGE_POPULATION),
    "incidence_focus_districts": _sql(f"""
        SELECT city, month_dx, sex, sp, {SEX_SPECIES} AS cat, n_case, round(n_case / pop * 1000, 6) AS monthly_perk,
               round(coalesce(n_case / pop * 1000, 0), 6) AS api
        FROM ({_alloc("city, month_dx, sex", "lenient",
                      where=f"year_dx = 2020 AND city IN ({FOCUS}) AND sex IS NOT NULL", value="n_case")})
        LEFT JOIN city_sex_pop USING (city, sex)""", CITY_SEX_POPULATION),
    "api_age_sex_district": _sql(
        _age_sex("city", f"year_dx = 2020 AND city IN ({FOCUS})", "city_age_pop", "coalesce({}, 0)",
                 "sex IS NOT NULL AND age_cat IS NOT NULL"), CITY_AGE_POPULATION),
    "api_district_class": _sql(f"""
        SELECT {DISTRICT}, "case", pop, round(api, 6) AS api, {_bands("api", cb.RATE_CLASS_BREAKS, cb.RATE_CLASSES)} AS api_cat
        FROM api""", API),
    "district_profile": _sql(f"""
        SELECT {DISTRICT}, "case", round(male_prop, 6) AS male_prop, round(adult_prop, 6) AS adult_prop,
               round(vivax_prop, 6) AS vivax_prop, pop, round(api, 6) AS api FROM profile""", PROFILE),
    "count_with_group_constant": _sql(f'SELECT {DISTRICT}, "case", pop, round(api, 6) AS api FROM api', API),
    "age_band_fold": _sql("SELECT province, district, year, age_cat, pop FROM people", PEOPLE),
    "api_age_coarse": _sql(_survey_rates("LEFT JOIN"), PEOPLE),
    "api_age_coarse_all_cells": _sql(_survey_rates("FULL JOIN"), PEOPLE),
    "series_replace_slice": _sql("SELECT * FROM merged"),
    "series_best_of_two": _sql("SELECT * FROM reported_series"),
    "series_grid_fill": _sql("""
        SELECT year, province, pop, total_case, round(total_case / pop * 1000, 6) AS api FROM province_pop LEFT JOIN (
          SELECT year, province, CASE WHEN bool_and("case" IS NOT NULL) THEN sum("case") END AS total_case
          FROM reported_series GROUP BY ALL) USING (year, province)""", PROVINCE_POPULATION),
    "distinct_units_with_unnamed": _sql(f"SELECT {DISTRICT}, k AS n_units FROM observed", OBSERVED),
    "unit_count_estimate": _sql("SELECT * FROM estimate", OBSERVED),
    "unit_counts_bucketed": _sql(f"SELECT {DISTRICT}, health_unit, sp, count(*) AS n_case FROM line GROUP BY ALL"),
    "unit_rates": _sql(f"""
        SELECT {DISTRICT}, health_unit, sp, case_hu, pop_city, n_hu, round(pop_hu, 6) AS pop_hu, round(api_hu, 6) AS api_hu
        FROM unit_rates""", UNITS),
    "unit_zero_padding": _sql(f"""
        SELECT {DISTRICT}, health_unit, sp, case_hu, pop_city, n_hu, round(pop_hu, 6) AS pop_hu, round(api_hu, 6) AS api_hu, pad
        FROM padded""", UNITS),
    "rates_district": _sql(f'SELECT {DISTRICT}, sp, "case", pop, round(api, 6) AS api FROM rates', RATES),
    "lorenz_district": _sql(f"""
        SELECT {DISTRICT}, sp, "case", pop, round(api, 6) AS api, {LORENZ_TAIL} FROM curve
        UNION ALL SELECT DISTINCT year_dx, province, NULL, sp, NULL, NULL, NULL, NULL, NULL, 0.0, 0.0 FROM curve""",
        RATES, DISTRICT_CURVE),
    "lorenz_unit": _sql(f"""
        SELECT {DISTRICT}, health_unit, sp, case_hu, pop_city, n_hu, round(pop_hu, 6) AS pop_hu, round(api_hu, 6) AS api_hu, pad,
               {LORENZ_TAIL} FROM curve
        UNION ALL SELECT DISTINCT year_dx, province, NULL, NULL, sp, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.0, 0.0
        FROM curve""", UNITS, UNIT_CURVE),
    "lorenz_unit_blocked": _sql(f"""
        SELECT {DISTRICT}, health_unit, sp, case_hu, pop_city, n_hu, round(pop_hu, 6) AS pop_hu, round(api_hu, 6) AS api_hu, pad,
               {LORENZ_TAIL} FROM curve
        UNION ALL SELECT DISTINCT year_dx, province, NULL, NULL, sp, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.0, 0.0
        FROM curve""", UNITS, UNIT_CURVE),
    "gini_district": _sql(GINI_SELECT, RATES, DISTRICT_CURVE, _gini()),
    "gini_unit": _sql(GINI_SELECT, UNITS, UNIT_CURVE, _gini()),
    "gini_per_district": _sql(
        f'SELECT {DISTRICT}, round(g, 6) AS g, "case", round(api, 6) AS api FROM api LEFT JOIN gini USING ({DISTRICT})',
        PER_DISTRICT, _gini(DISTRICT), API),
    "gini_per_district_no_origin": _sql(
        f'SELECT {DISTRICT}, round(g, 6) AS g, "case", round(api, 6) AS api FROM api LEFT JOIN gini USING ({DISTRICT})',
        PER_DISTRICT, _gini(DISTRICT, origin=False), API),
    "pareto_units_falciparum": _sql(_pareto(f"sp IN ({PF}, {MIXED})", "year_dx")),
    "pareto_units_vivax": _sql(_pareto(f"sp IN ({PV}, {MIXED})", "year_dx")),
    "pareto_units_both_years": _sql(_pareto(f"sp IN ({PF}, {MIXED})")),
    "pareto_units_vivax_published": _sql(_pareto(f"year_dx = 2019 AND sp = {PV} OR sp = {MIXED}")),
    "pareto_units_vivax_published_2020": _sql(_pareto(f"year_dx = 2020 AND sp = {PV} OR sp = {MIXED}")),
    "top_units": _sql("""
        SELECT health_unit, count(*) AS n FROM line GROUP BY 1 ORDER BY n DESC, health_unit NULLS LAST LIMIT 10"""),
    "bootstrap_replicates_district": _sql(f"SELECT {STRATA}, rep, round(g, 6) AS g FROM replicates", RATES, DISTRICT_BOOT),
    "bootstrap_ci_district": _sql(INTERVAL, RATES, DISTRICT_BOOT),
    "bootstrap_ci_district_no_origin": _sql(INTERVAL, RATES, DISTRICT_BOOT_PARITY),
    "bootstrap_ci_unit": _sql(INTERVAL, UNITS, UNIT_BOOT),
    "bootstrap_ci_unit_no_origin": _sql(INTERVAL, UNITS, UNIT_BOOT_PARITY),
    "bootstrap_replicates_district_hashed": _sql(f"SELECT {STRATA}, rep, round(g, 6) AS g FROM replicates", RATES, DISTRICT_BOOT_HASHED),
    "bootstrap_replicates_unit_hashed": _sql(f"SELECT {STRATA}, rep, round(g, 6) AS g FROM replicates", UNITS, UNIT_BOOT_PARITY_HASHED),
    "bootstrap_ci_unit_hashed": _sql(INTERVAL, UNITS, UNIT_BOOT_HASHED),
    "unit_type_mix": _sql(f"""
        SELECT year_dx, province, city, hu_type, "case", round("case" / sum("case") OVER (PARTITION BY {DISTRICT}), 6) AS share, ord
        FROM (SELECT {DISTRICT}, hu_type, count(*) AS "case" FROM line GROUP BY ALL) LEFT JOIN (
          SELECT city, row_number() OVER (ORDER BY avg({UNIT_SCORE}), city) AS ord FROM line GROUP BY city) USING (city)"""),
    "severity_mix": _sql(f"""
        SELECT year_dx, province, hu_type, severe, count(*) AS "case",
               round(count(*) / sum(count(*)) OVER (PARTITION BY year_dx, province, hu_type), 6) AS share, {UNIT_ORDER} AS ord
        FROM line GROUP BY year_dx, province, hu_type, severe"""),
    "occupation_mix": _sql(f"""
        SELECT province, city, occupation, "case", round("case" / sum("case") OVER (PARTITION BY province, city), 6) AS share, ord
        FROM (SELECT province, city, occupation, count(*) AS "case" FROM line WHERE year_dx = 2020 AND age >= 18 GROUP BY ALL)
        LEFT JOIN (SELECT city, row_number() OVER (ORDER BY quantile_cont(api, 0.5), city) AS ord
                   FROM line JOIN api USING ({DISTRICT}) WHERE year_dx = 2020 AND age >= 18 GROUP BY city) USING (city)""", API),
    "category_order_by_mean": _sql("""
        SELECT city, round(avg(api), 6) AS score, row_number() OVER (ORDER BY avg(api), city) AS ord FROM api GROUP BY city""", API),
    "category_order_by_median": _sql(f"""
        SELECT city, round(quantile_cont(api, 0.5), 6) AS score, row_number() OVER (ORDER BY quantile_cont(api, 0.5), city) AS ord
        FROM line JOIN api USING ({DISTRICT}) GROUP BY city""", API),
    "density_of_replicates": _sql(f"""
        SELECT {STRATA}, round(x, 6) AS x, round(sum(w * exp(-0.5 * ((x - v) / bw) ** 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) AS density
        FROM (SELECT *, i / 511 AS x FROM binned JOIN width USING ({STRATA}), {_grid_points(512)}) GROUP BY {STRATA}, x""",
        RATES, DISTRICT_BOOT,
        f"kept AS (SELECT {STRATA}, g AS v FROM replicates WHERE g BETWEEN 0 AND 1)",
        f"""width AS (SELECT {STRATA}, count(*) AS n, 0.9 * least(stddev_samp(v),
              (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * count(*) ** (-0.2) AS bw FROM kept GROUP BY {STRATA})""",
        f"""binned AS (SELECT {STRATA}, b / 2047 AS v, sum(w) AS w FROM (
              SELECT {STRATA}, floor(v * 2047) AS b, 1 - (v * 2047 - floor(v * 2047)) AS w FROM kept
              UNION ALL SELECT {STRATA}, floor(v * 2047) + 1, v * 2047 - floor(v * 2047) FROM kept) GROUP BY ALL)"""),
    "local_fit_of_profile": _sql(
        " UNION ALL ".join(_loess(m) for m in ("male_prop", "adult_prop", "vivax_prop")), PROFILE),
    "line_fit_of_gini": _sql(f"""
        SELECT year_dx, round(x, 5) AS log10_x, round(slope, 5) AS slope, round(intercept, 5) AS intercept,
               round(intercept + slope * x, 5) AS fit,
               round(intercept + slope * x - t * sigma * sqrt(1 / n + (x - mx) ** 2 / sxx), 5) AS lower,
               round(intercept + slope * x + t * sigma * sqrt(1 / n + (x - mx) ** 2 / sxx), 5) AS upper
        FROM (SELECT *, lo + (hi - lo) * i / 79 AS x, sqrt((syy - slope * slope * sxx) / (n - 2)) AS sigma FROM fitted, {_grid_points(80)})
        JOIN t_table ON df = n - 2""",
        PER_DISTRICT, _gini(DISTRICT), API, T_TABLE,
        f"""fitted AS (SELECT year_dx, count(*) AS n, regr_slope(g, lx) AS slope, regr_intercept(g, lx) AS intercept,
              regr_sxx(g, lx) AS sxx, regr_syy(g, lx) AS syy, avg(lx) AS mx, min(lx) AS lo, max(lx) AS hi
              FROM (SELECT year_dx, g, log10(api) AS lx FROM api JOIN gini USING ({DISTRICT})
                    WHERE api BETWEEN 0.1 AND 1000 AND g BETWEEN 0 AND 1) GROUP BY year_dx)"""),
    "region_rate_class": _sql(
        _region("SELECT city AS NAME_2, api FROM api WHERE year_dx = 2020", "api", cb.MAP_RATE_BREAKS, cb.MAP_RATE_CLASSES, "api_cat", False),
        API, REGIONS),
    "region_rate_class_2019": _sql(
        _region("SELECT city AS NAME_2, api FROM api WHERE year_dx = 2019", "api", cb.MAP_RATE_BREAKS, cb.MAP_RATE_CLASSES, "api_cat"),
        API, REGIONS),
    "region_gini_class_2020": _sql(
        _region(f"SELECT city AS NAME_2, g FROM api LEFT JOIN gini USING ({DISTRICT}) WHERE year_dx = 2020",
                "g", cb.GINI_BREAKS, cb.GINI_CLASSES, "gini_cat"),
        PER_DISTRICT, _gini(DISTRICT, origin=False), API, REGIONS),
    "region_gini_class": _sql(
        _region(f"SELECT city AS NAME_2, g FROM api LEFT JOIN gini USING ({DISTRICT}) WHERE year_dx = 2019",
                "g", cb.GINI_BREAKS, cb.GINI_CLASSES, "gini_cat"),
        PER_DISTRICT, _gini(DISTRICT, origin=False), API, REGIONS),
    "region_names_unmatched": _sql("""
        SELECT DISTINCT city AS NAME_2, 'values' AS side FROM line WHERE city NOT IN (SELECT NAME_2 FROM map_region)
        UNION ALL SELECT NAME_2, 'regions' FROM map_region WHERE NAME_2 NOT IN (SELECT city FROM line)""", REGIONS),
    "grid_check": _sql("""
        SELECT year_dx, province, city, month_dx, sex, sp FROM (
          SELECT year_dx, province, city, unnest(range(1, 13)) AS month_dx FROM (SELECT DISTINCT year_dx, province, city FROM population))
        CROSS JOIN (VALUES ('Male'), ('Female')) s(sex)
        CROSS JOIN (SELECT unnest(%s) AS sp)
        EXCEPT SELECT year_dx, province, city, month_dx, sex, sp FROM line""" % [cb.PF, cb.PV, cb.OTHER]),
    "group_constant_check": _sql("""
        SELECT year_dx, province, city, count(*) AS rows, min(m) AS smallest, max(m) AS largest
        FROM (SELECT year_dx, province, city, n + (city LIKE 'T%' AND id LIKE '%1-2')::INT AS m
              FROM line LEFT JOIN population USING (year_dx, province, city))
        GROUP BY ALL HAVING min(m) <> max(m)"""),
    "population_known_check": _sql("""
        SELECT year AS year_dx, province, city, 1::BIGINT AS rows FROM (SELECT DISTINCT year, province, city FROM reported_series)
        WHERE year < 2019"""),
}


def _row_count(part: str, table: str, key: str, rows: list[tuple]) -> str:
    return f"""SELECT '{part}' AS part, key, coalesce(rows, 0) AS rows, expected, coalesce(rows, 0) = expected AS complete
        FROM (VALUES {", ".join(f"({_lit(k)}, {n}::BIGINT)" for k, n in rows)}) e(key, expected)
        LEFT JOIN (SELECT {key} AS key, count(*) AS rows FROM ({table}) GROUP BY 1) USING (key)"""


ORACLES["row_count_check"] = " UNION ALL ".join([
    _row_count("district months", ORACLES["incidence_focus_districts"], "city", [(d, 48) for d in cb.FOCUS_DISTRICTS]),
    _row_count("official districts", _sql("SELECT province FROM official"), "province", [("Papua", 29), ("West Papua", 13)]),
    _row_count("years", ORACLES["series_grid_fill"], "province", [("Papua", 11), ("West Papua", 11)]),
])


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
