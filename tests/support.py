"""What tests of queries share."""

import os
from pathlib import Path

TESTDATA = Path(os.environ.get("TESSEL_TESTDATA", "/root/testdata"))


def agrees(spark, duck, query, sql):
    """The query's rows as multiset, and the SQL's."""
    df = query(spark, str(TESTDATA / "sf0.001"))
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
