"""Every registered query with an oracle gives the same multiset of rows as the oracle."""

import pytest

from gneiss.plans import catalogue
from gneiss.plans.compare import differences

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(name, spark, sf_dir, oracle):
    got = QUERIES[name](spark, sf_dir)
    want = oracle.sql(ORACLES[name])
    assert not differences(got.columns, got.collect(), want.columns, want.fetchall())
