"""Every registered query against its SQL twin; queries without one must at least give rows."""

import pytest

from oracle import compare
from penstock.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    verdict, _, rows = compare(spark, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert verdict in ("match", "rows"), verdict
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
