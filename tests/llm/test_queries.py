"""Every training-data query runs on the small tables; what SQL can say is compared."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
from chronoloom.llm import queries  # noqa: E402
from verify import normal  # noqa: E402

COLUMNS = {
    "p1_found": ["name_a", "name_b"], "p2_found": ["chunk_id", "boundary"], "p5_found": ["s2_paper_id", "paper_id"], "p6_found": ["chunk_id", "kind", "line_no"], "p7_found": ["item_a", "item_b"],
    "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "grade"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in queries.ORACLE:
        con = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
        cur = con.execute(queries.ORACLE[name])
        assert normal(rows, df.columns) == normal(cur.fetchall(), [d[0] for d in cur.description])
