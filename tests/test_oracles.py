"""Every query that has SQL equals DuckDB's answer; the others give rows."""

import pytest
from compare import assert_same

from varve import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert_same(df, ORACLES[name], sf)
    else:
        assert df.limit(1).count() == 1
