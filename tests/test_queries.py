import decimal
import math
from pathlib import Path

import pytest

from talus.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() + 0)
    return str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert rows or name in ("stream_alerts", "triage_cash_abroad")
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(queries.ORACLE_SQL[name])
        at = [want.columns.index(x) for x in cols]
        assert sorted(want.columns) == cols
        assert sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall()) == rows


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
