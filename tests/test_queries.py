"""Every registered query next to its SQL on the smallest scale factor."""

import pytest
from check import compare, duck

from millrace.plans import load_all

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) == ""
    else:
        assert rows


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
