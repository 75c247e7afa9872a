"""Every registered query of the library against its SQL."""

import pytest
from compare import connection, differences

from strandloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_sql(spark, con, name):
    assert differences(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""


def test_flagship(spark):
    rows = catalogue.flagship(spark, SF).collect()
    assert {r.chrom for r in rows} == {0, 1, 2} and all(r.n_nodes >= 2 and r.ps <= r.first_pos + 1 for r in rows)
