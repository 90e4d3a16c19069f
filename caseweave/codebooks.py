"""Code lists, class limits and published denominators.

Everything marked *fixed values* must be equal to the values the analysis was
published with; nothing here is derived from data.
"""

from __future__ import annotations

PF = "P. falciparum"
PV = "P. vivax"
MIXED = "P. falciparum/vivax"
OTHER = "Other"
SPECIES = [PF, PV, MIXED, OTHER]
CURVE_SPECIES = [PF, PV, MIXED]

MALE = "Male"
FEMALE = "Female"
SEXES = [MALE, FEMALE]

# Parasite codes. The code of a mixed infection depends on the year.
SPECIES_CODES = {
    "Pf": PF,
    "Pv": PV,
    "Pm": OTHER,
    "Po": OTHER,
    "Pk": OTHER,
    "Suspek Pk": OTHER,
}
MIXED_CODE_OF_YEAR = {2019: "Pmix", 2020: "Mix"}

# Sex codes. Lower case is accepted in 2020 only.
SEX_CODES_OF_YEAR = {
    2019: {"L": MALE, "P": FEMALE},
    2020: {"L": MALE, "l": MALE, "P": FEMALE, "p": FEMALE},
}

# Parasite codes where the year does not matter.
COARSE_SPECIES_CODES = {"Pf": PF, "Pv": PV, "Mix": "Mixed", "Pmix": "Mixed"}

# Ordered rules, first hit wins, case is ignored.
FACILITY_RULES = [
    ("Health centre", ["puskesmas", "pkm"]),
    ("Hospital", ["rumah sakit", "rumkit", "rs"]),
    ("Clinic", ["klinik", "balai pengobatan", "bp"]),
]
ADMISSION_RULES = [("Outpatient", ["rj"]), ("Inpatient", ["ri"])]
DEATH_RULES = [(True, ["ya"]), (False, ["tidak"])]

# Severity, laboratory and occupation codes.
SEVERITY_CODES = {1: "Uncomplicated malaria", 2: "Severe malaria"}
LAB_CODES = {"Mikroskop": "Microscopy", "PCR": "PCR", "RDT": "RDT"}
OCCUPATION_CODES = {
    "Berkebun": "Farmer",
    "BERkebun": "Farmer",
    "Buruh": "Other",
    "Buruh Tambang": "Mining worker",
    "Guru": "Teacher",
    "Ibu Rumah Tangga": "Housewife",
    "Jaga Kapal": "Fisherman",
    "Nelayan": "Fisherman",
    "Pedagang": "Merchant",
    "Pegawai": "Employee",
    "Pelajar": "Student",
    "Perambah Hutan": "Forest worker",
    "Petambak": "Pond worker",
    "Petani": "Farmer",
    "PNS": "Civil servant",
    "POLRI": "Police/Army",
    "Tak Bekerja": "Unemployed",
    "Belum Bekerja": "Unemployed",
    "TNI": "Police/Army",
    "Wiraswasta": "Other",
}

# Level orders. Health-unit types are scored alphabetically when districts are reordered.
UNIT_TYPES = ["Clinic", "Health centre", "Hospital", "Other"]
UNIT_TYPES_DISPLAY = ["Hospital", "Health centre", "Clinic", "Other"]
SPECIES_LEVELS = [PF, PV, MIXED, OTHER]
SEX_SPECIES = {
    (MALE, PV): "P. vivax in males",
    (FEMALE, PV): "P. vivax in females",
    (MALE, PF): "P. falciparum in males",
    (FEMALE, PF): "P. falciparum in females",
}

# Five-year age bands up to an open top, and the coarse bands they fold into.
AGE_BREAKS = list(range(5, 80, 5))
AGE_BANDS = [f"{low}-{low + 4}" for low in range(0, 75, 5)] + ["75+"]
COARSE_AGE_BREAKS = [5, 10, 15, 65]
COARSE_AGE_BANDS = ["[0, 5)", "[5, 10)", "[10, 15)", "[15, 65)", "[65, ∞)"]


def coarse_band_of(band: str) -> str:
    """Coarse age band that a five-year band belongs to."""
    low = int(band.rstrip("+").split("-")[0])
    return COARSE_AGE_BANDS[sum(low >= b for b in COARSE_AGE_BREAKS)]


ADULT_AGE = 18

# Class limits of the rate and Gini classes.
RATE_CLASS_BREAKS = [1, 5]
RATE_CLASSES = ["[0, 1)", "[1, 5)", "[5, ∞)"]
MAP_RATE_BREAKS = [10, 100, 1000]
MAP_RATE_CLASSES = ["[0-10)", "[10-100)", "[100-1000)", "[1000-∞)"]
GINI_BREAKS = [0.2, 0.4, 0.6, 0.8]
GINI_CLASSES = ["[0-20)", "[20-40)", "[40-60)", "[60-80)", "[80-100]"]

# Rows that published tables have (months × sexes × species; districts; years × provinces).
DISTRICT_MONTH_ROWS = 48
OFFICIAL_DISTRICTS = {"Papua": 29, "West Papua": 13}
YEAR_PROVINCE_ROWS = {"Papua": 11, "West Papua": 11}

# Study area and years.
PROVINCES = ["Papua", "Papua Barat"]
PROVINCE_RENAMES = {"Papua Barat": "West Papua"}
STUDY_YEARS = [2019, 2020]
SURVEY_PROVINCES = ["PAPUA BARAT", "PAPUA"]
SURVEY_EXTRA_PROVINCE = "NUSA TENGGARA TIMUR"
SURVEY_EXTRA_DISTRICTS = ["SUMBA BARAT", "SUMBA BARAT DAYA", "SUMBA TENGAH", "SUMBA TIMUR"]
FOCUS_DISTRICTS = ["Keerom", "Nabire", "Jayawijaya"]

# Projected population in thousands, 2010 to 2020.
PROVINCE_POPULATION = {
    "Papua": [2857.0, 2915.3, 2973.8, 3032.5, 3091.0, 3149.4, 3207.4, 3265.2, 3322.5, 3379.3, 3435.4],
    "West Papua": [765.3, 786.0, 807.0, 828.3, 849.8, 871.5, 893.4, 915.4, 937.5, 959.6, 981.8],
}
PROVINCE_POPULATION_YEARS = list(range(2010, 2021))

# Population by sex in thousands, 2019 and 2020.
PROVINCE_SEX_POPULATION = {
    ("Papua", MALE): [1774.7, 1802.2],
    ("Papua", FEMALE): [1604.6, 1633.2],
    ("West Papua", MALE): [504.8, 516.2],
    ("West Papua", FEMALE): [454.8, 465.6],
}

# Population by sex and five-year age band in thousands, 2020.
PROVINCE_AGE_POPULATION = {
    ("Papua", MALE): [170.1, 164.2, 163.3, 166.4, 168.5, 165.4, 152.5, 141.3,
                      136.1, 124.9, 100.8, 70.7, 41.0, 20.7, 9.6, 6.7],
    ("Papua", FEMALE): [166.0, 161.0, 156.0, 148.6, 146.8, 148.0, 142.3, 133.2,
                        128.2, 112.1, 81.3, 52.1, 29.6, 15.2, 7.3, 5.5],
    ("West Papua", MALE): [51.6, 48.5, 47.0, 45.5, 43.6, 45.3, 47.4, 45.7,
                           39.5, 31.6, 25.3, 18.7, 12.5, 7.6, 4.0, 2.4],
    ("West Papua", FEMALE): [43.4, 41.2, 37.9, 37.2, 37.4, 37.2, 32.5, 26.0,
                             21.1, 16.4, 11.8, 7.8, 4.8, 2.7, 1.8, 1.8],
}

# Population of three districts by sex in thousands, 2020.
DISTRICT_SEX_POPULATION = {
    "Keerom": {MALE: 31.114, FEMALE: 26.789},
    "Nabire": {MALE: 79.909, FEMALE: 72.912},
    "Jayawijaya": {MALE: 111.811, FEMALE: 108.301},
}

# The same three districts by five-year age band in thousands, 2020.
# The last value of the last row looks ten times too high next to its neighbour; kept as published.
DISTRICT_AGE_POPULATION = {
    ("Keerom", MALE): [2.928, 2.323, 2.179, 2.513, 3.156, 3.315, 2.389, 2.057,
                       2.073, 2.259, 1.930, 1.751, 0.925, 0.733, 0.329, 0.254],
    ("Keerom", FEMALE): [2.946, 2.427, 2.322, 2.168, 2.254, 2.029, 1.817, 1.770,
                         2.300, 2.207, 1.744, 1.187, 0.748, 0.447, 0.222, 0.201],
    ("Nabire", MALE): [7.384, 6.375, 5.654, 6.821, 7.954, 8.319, 7.232, 5.947,
                       5.425, 4.899, 4.862, 4.194, 2.504, 1.268, 0.584, 0.487],
    ("Nabire", FEMALE): [7.763, 6.777, 5.964, 6.326, 6.727, 6.915, 6.019, 5.068,
                         5.347, 5.132, 4.369, 2.922, 1.847, 0.917, 0.420, 0.399],
    ("Jayawijaya", MALE): [7.835, 9.085, 10.415, 11.885, 9.885, 8.927, 8.794, 10.709,
                           10.696, 9.909, 6.346, 4.090, 2.095, 0.756, 0.276, 0.108],
    ("Jayawijaya", FEMALE): [8.025, 9.241, 10.560, 10.792, 9.333, 10.166, 10.904, 11.850,
                             10.323, 8.162, 4.645, 2.438, 1.233, 0.468, 0.105, 0.56],
}

# Column labels of the cleaned line list.
LINE_LIST_LABELS = {
    "id": "Patient unique identifier",
    "province": "Province",
    "city": "Kota/Kabupaten",
    "n": "Projected population size for districts",
    "date_dx": "Date of visit",
    "week_dx": "Week number of visit",
    "month_dx": "Month of visit",
    "year_dx": "Year of visit",
    "sp": "Malaria species",
    "age": "Age (years)",
    "sex": "Biological sex",
    "health_unit": "Health unit",
    "hu_type": "Type of health unit",
    "severe": "Severe malaria",
    "age_cat": "Age interval (years)",
    "adm_stat": "Admission status",
    "lab": "Diagnostic means",
    "death": "Death",
    "occupation": "Occupation",
}


def species_by_year() -> dict[tuple[int, str], str]:
    """(year, code) -> species, with the mixed code of each year."""
    table = {}
    for year, mixed in MIXED_CODE_OF_YEAR.items():
        table.update({(year, code): label for code, label in SPECIES_CODES.items()})
        table[(year, mixed)] = MIXED
    return table


def sex_by_year() -> dict[tuple[int, str], str]:
    """(year, code) -> sex."""
    return {(year, code): sex for year, codes in SEX_CODES_OF_YEAR.items() for code, sex in codes.items()}


def province_population_rows() -> list[tuple]:
    """(year, province, persons)."""
    return [
        (year, province, thousand * 1000)
        for province, values in PROVINCE_POPULATION.items()
        for year, thousand in zip(PROVINCE_POPULATION_YEARS, values)
    ]


def province_sex_rows() -> list[tuple]:
    """(province, year, sex, persons)."""
    return [
        (province, year, sex, thousand * 1000)
        for (province, sex), values in PROVINCE_SEX_POPULATION.items()
        for year, thousand in zip(STUDY_YEARS, values)
    ]


def province_age_rows() -> list[tuple]:
    """(province, sex, age band, persons)."""
    return [
        (province, sex, band, thousand * 1000)
        for (province, sex), values in PROVINCE_AGE_POPULATION.items()
        for band, thousand in zip(AGE_BANDS, values)
    ]


def district_sex_rows() -> list[tuple]:
    """(district, sex, persons)."""
    return [
        (district, sex, thousand * 1000)
        for district, by_sex in DISTRICT_SEX_POPULATION.items()
        for sex, thousand in by_sex.items()
    ]


def district_age_rows() -> list[tuple]:
    """(district, sex, age band, persons)."""
    return [
        (district, sex, band, thousand * 1000)
        for (district, sex), values in DISTRICT_AGE_POPULATION.items()
        for band, thousand in zip(AGE_BANDS, values)
    ]
