"""Queries of the subpackage that SQL can express, against that SQL."""

import duckdb
import pytest

from tests.conftest import SF_CHECK
from tests.test_entry_oracle import _rows
from tillroll.llm import queries
from tillroll.sources.tables import TABLES, table_path


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_CHECK, t)}')")
    df = queries.QUERIES[name](spark, SF_CHECK)
    res = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, res.fetchall())
