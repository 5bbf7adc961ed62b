"""Every core query against its SQL twin on the smallest tables."""

import pytest

from compare import differs, duck
from tidewright.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    assert differs(spark, con, sf, QUERIES[name], ORACLES.get(name)) == ""


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).count() > 0


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)
