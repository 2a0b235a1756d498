"""The driver's contract: every query runs on the small tables with a stable schema; SQL agrees where there is any."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from chronoloom.plans import all_oracles, all_queries  # noqa: E402
from verify import normal  # noqa: E402


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sf, con, name):
    df = all_queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    sql = all_oracles().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(rows, df.columns) == normal(cur.fetchall(), columns)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_search" in entry.queries()
