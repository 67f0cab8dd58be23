"""Every named query against its SQL on the same tables."""

import pytest

from lakecheck.plans import ORACLES, QUERIES
from tests.oracle import difference, duck, type_difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, name, SF) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("src_", "sink_", "merge_"))))
def test_types(spark, con, name):
    assert type_difference(spark, con, name, SF) == {}
