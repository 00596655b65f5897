"""Every registered query against its SQL."""

import pytest

from footgrid.plans import ORACLES, QUERIES
from oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        assert [p for p in compare(df, ORACLES[name], sf) if not p.startswith("~")] == []
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
