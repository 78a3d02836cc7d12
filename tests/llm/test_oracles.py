"""Queries of the subpackage against their SQL; the others must give rows."""

import pytest

from oracle import compare
from penstock.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    verdict, _, rows = compare(spark, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert verdict in ("match", "rows"), verdict
    assert rows > 0
