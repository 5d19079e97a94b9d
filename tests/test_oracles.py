"""Every query of the core against its SQL, over whole tables."""

import pytest

from eventloom.plans.catalog import ORACLES, QUERIES
from tests.oracle import connect, differences

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


def test_all_have_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, ROOT), con, ORACLES[name]) == []
