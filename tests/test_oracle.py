"""Every core query against its SQL, on the smallest tables."""

import os

import pytest
from oracle_data import DATA, connect, rows

from newsmill.plans.registry import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    cols, got = rows(df.columns, df.collect())
    if name in ORACLE:
        r = connect().execute(ORACLE[name])
        names = [x[0] for x in r.description]
        assert (cols, got) == rows(names, r.fetchall())
    else:
        # Golden rows of these are in the tests of their operators; here they must give rows, the same ones again.
        assert got and (cols, got) == rows(df.columns, df.collect())
