"""Every market query against its SQL."""

import oracle
import pytest
from conftest import SMALL

from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    want = oracle.by_sql(catalog.ORACLES[name], SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.normal(got) == oracle.normal(want)


def test_flagship_has_rows(spark):
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, SMALL).count() > 0
