"""The queries run on the smallest tables, and the entry point offers them."""

import pytest

from tidewright.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 1


def test_entry_offers_them():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries())
