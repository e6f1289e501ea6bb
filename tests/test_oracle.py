"""Every catalogue query against its DuckDB oracle on the smallest fixture."""

import pytest

from funnelkit.plans.catalog import QUERIES
from funnelkit.plans.oracle import ORACLE
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, SF, QUERIES[name], ORACLE[name])
    assert res["status"] == "OK", res
    assert "types" not in res, res
