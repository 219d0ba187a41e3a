"""The operators' queries that SQL can express against their SQL, on whole small tables."""

import pytest

from gneiss.llm import queries
from gneiss.plans.compare import differences


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(name, spark, sf_dir, oracle):
    got = queries.queries()[name](spark, sf_dir)
    want = oracle.sql(queries.oracle_sql()[name])
    assert not differences(got.columns, got.collect(), want.columns, want.fetchall())
