from __future__ import annotations

import pytest
from oracle import compare, tables

from tephra.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        compare(df, con, ORACLE_SQL[name])
    else:
        assert df.count() > 0
