"""The registered queries against their SQL."""

import pytest
from check import connect, rows_of

from quarrywork.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(name, sf, spark):
    df = QUERIES[name](spark, sf)
    cursor = connect(sf).execute(SQL[name])
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
