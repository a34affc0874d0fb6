"""Every query with an oracle, compared with DuckDB on whole tables."""

import pytest
from oracle_check import difference

from queryset import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_oracle(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns
    assert set(contract.oracle_sql()) <= set(contract.queries())
