"""The driver contract: smoke entry, and every registered query against its
DuckDB oracle SQL on the sf0.01 tables (row count, names, values)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF_CHECK, SF_SMOKE, have_data
from tillroll.plans import ORACLE, REPORTS
from tillroll.sources.tables import TABLES, table_path


def test_entry_smoke(spark):
    if not have_data(SF_SMOKE):
        pytest.skip("no smoke data")
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["store_id", "store_location", "total_revenue", "total_transactions",
                          "avg_transaction_value"]


def test_every_query_has_oracle():
    assert set(REPORTS) <= set(entry_mod.queries())
    assert set(REPORTS) == set(ORACLE) & set(REPORTS)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _rows(columns, records):
    idx = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in idx) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    if not have_data(SF_CHECK):
        pytest.skip("no sf0.01 data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_CHECK, t)}')")
    return con


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_query_matches_oracle(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF_CHECK)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(entry_mod.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = _rows(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert got == want


# Reports whose statement has an ORDER BY without ties in it: rows in order.
ORDERED = ("store_summary", "category_summary", "store_mom_growth", "store_qoq_growth", "daily_price_units",
           "within_day_elasticity", "top_combos", "type_summary_in_categories", "basket_size_by_hour",
           "price_change_calendar", "store_mom_growth_yearless", "category_affinity")


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_reports_keep_their_order(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF_CHECK)
    got = [tuple(_norm(v) for v in r) for r in df.collect()]
    res = duck.execute(entry_mod.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = [tuple(_norm(r[cols.index(c)]) for c in df.columns) for r in res.fetchall()]
    assert got == want


WEEK = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
          "December"]


@pytest.mark.parametrize("name, keys", [("hourly_traffic", ("month", "day_of_week", "hour")),
                                        ("basket_size_by_time", ("day_of_week", "hour"))])
def test_reports_by_time_are_in_calendar_order(spark, name, keys):
    """Months, Monday-first weekdays and hours; other keys are not part of the order."""
    place = {"month": MONTHS.index, "day_of_week": WEEK.index, "hour": int}
    got = [tuple(place[k](r[k]) for k in keys) for r in entry_mod.queries()[name](spark, SF_CHECK).collect()]
    assert len(set(got)) > 100 and got == sorted(got)
