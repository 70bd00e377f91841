"""The star join over bucketed inputs: no exchange below lineitem and orders, the same rows."""

import contextlib
import io
import re

import pytest

from tests.conftest import SF_SMOKE, have_data
from tillroll.sources.buckets import KEYS, bucketed_reader, store_buckets
from tillroll.sources.sales import build_sales, star_join


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def below(tree: str, join: str) -> list[str]:
    """The lines of the plan under the first node that matches ``join``."""
    lines = tree.split("\n")
    at = next(i for i, x in enumerate(lines) if re.search(join, x))
    depth = lines[at].index(re.search(join, lines[at]).group()[0])
    out = []
    for x in lines[at + 1:]:
        if len(x) - len(x.lstrip(" :+-")) <= depth:
            break
        out.append(x)
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    if not have_data(SF_SMOKE):
        pytest.skip("no smoke data")
    root = str(tmp_path_factory.mktemp("buckets"))
    store_buckets(spark, SF_SMOKE, root, 4)
    yield root
    for row in spark.sql("SHOW TABLES LIKE 'tillroll_*'").collect():
        spark.sql(f"DROP TABLE {row.tableName}")


def test_orders_and_lines_meet_without_an_exchange(spark, stored):
    read = bucketed_reader(spark, SF_SMOKE, stored)
    both = read("lineitem").join(read("orders"), read("lineitem").l_orderkey == read("orders").o_orderkey)
    tree = plan(both)
    assert "SortMergeJoin" in tree and "Exchange" not in tree
    plain, bucketed = plan(build_sales(spark, SF_SMOKE)), plan(star_join(read))
    join = r"SortMergeJoin \[l_orderkey"
    count = lambda t: sum("Exchange hashpartitioning(l_orderkey" in x for x in below(t, join))
    assert count(plain) == 1 and count(bucketed) == 0


def test_the_join_is_the_same(spark, stored):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(star_join(bucketed_reader(spark, SF_SMOKE, stored))) == rows(build_sales(spark, SF_SMOKE))


def test_another_application_defines_the_tables_again(spark, stored):
    before = star_join(bucketed_reader(spark, SF_SMOKE, stored)).count()
    for row in spark.sql("SHOW TABLES LIKE 'tillroll_*'").collect():
        spark.sql(f"DROP TABLE {row.tableName}")
    read = bucketed_reader(spark, SF_SMOKE, stored)
    assert star_join(read).count() == before
    for name in KEYS:
        assert read(name).count() > 0
    assert "Exchange" not in plan(read("lineitem").join(read("orders"), read("lineitem").l_orderkey == read("orders").o_orderkey))
