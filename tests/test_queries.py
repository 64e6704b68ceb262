"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from lectern.plans.queries import ORACLES, QUERIES
from tests.oracle import check, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    check(QUERIES[name](spark, sf), ORACLES[name], con)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
