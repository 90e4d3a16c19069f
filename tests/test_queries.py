"""Every registered query against its SQL, and the driver contract."""

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from caseweave.workload import oracles
from caseweave.workload import queries as registered

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_contract(spark):
    assert set(oracles.oracle_sql()) == set(registered.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name, keys", [
    ("pareto_units_falciparum", ("year_dx", "cumsum")), ("api_monthly", ("province", "date")),
    ("lorenz_district", ("year_dx", "province", "sp", "p_i")),
])
def test_result_tables_come_sorted(spark, name, keys):
    rows = [tuple(r[k] for k in keys) for r in registered.queries()[name](spark, FOLDER).collect()]
    assert len(rows) > 1 and rows == sorted(rows)


def test_monthly_rate_has_every_month_of_the_orders(spark, connection):
    """No month of the orders before 2018 is taken out of the table by its year."""
    months = connection.execute("SELECT DISTINCT year(o_orderdate) + 18, month(o_orderdate) FROM orders WHERE year(o_orderdate) < 2000").fetchall()
    found = registered.queries()["api_monthly"](spark, FOLDER).collect()
    assert {(r["date"].year, r["date"].month) for r in found if r["date"].year < 2018} == set(months)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_sql(spark, connection, name):
    df = contract.queries()[name](spark, FOLDER)
    assert differences(df, connection, contract.oracle_sql()[name]) == ""
