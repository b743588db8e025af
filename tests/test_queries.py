"""Every registered query against its SQL on the benchmark tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck
from workload.oracles import SQL
from workload.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def database():
    return duck(FOLDER)


def test_registry_is_complete():
    assert set(REGISTRY) == set(SQL)
    assert REGISTRY.items() <= entry.queries().items() and SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, database, name):
    assert difference(spark, database, name, FOLDER, REGISTRY[name], SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["cve_ent", "estado", "opportunityScore", "marketAttractiveness", "whitespaceScore"]


def test_year_reaches_the_scan(spark):
    plan = REGISTRY["direct_value"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = [part for part in plan.split("FileScan")[1:] if "o_orderdate" in part.split("\n")[0]]
    assert scans and all("GreaterThanOrEqual(o_orderdate" in part.split("\n")[0] for part in scans)
