"""The corpus queries that SQL can express, over whole tables."""

import pytest

from eventloom.llm.registry import ORACLES, QUERIES
from tests.oracle import connect, differences

ROOT = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, ROOT), connect(ROOT), ORACLES[name]) == []


def test_ten_queries_of_one_name_each():
    assert sorted(int(n.removeprefix("op").split("_")[0]) for n in QUERIES) == list(range(1, 11))
