"""Guards on the physical plans: the properties the scale design relies on."""

import contextlib
import io
import re

import pytest

from tests.conftest import SF_SMOKE, have_data
from tillroll.plans import REPORTS
from tillroll.sources.sales import build_sales


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    if not have_data(SF_SMOKE):
        pytest.skip("no smoke data")
    return {name: _plan(fn(spark, SF_SMOKE)) for name, fn in REPORTS.items()}


def test_no_python_on_any_report_path(plans):
    for name, text in plans.items():
        assert not re.search(r"EvalPython|ArrowEval|InPandas|PythonUDF", text), name


def test_category_and_type_filters_reach_the_scan(plans):
    for name, column in [("type_summary_in_categories", "product_category"),
                         ("type_summary_by_category", "product_category"),
                         ("products_in_category", "product_category"),
                         ("products_in_categories", "product_category"),
                         ("products_of_top_types", "product_type"),
                         ("products_of_bottom_types", "product_type")]:
        pushed = " ".join(re.findall(r"PushedFilters: \[(.*)\]", plans[name]))
        assert re.search(rf"(In|EqualTo)\({column}", pushed), name


def test_reports_read_only_the_columns_they_use(plans):
    schema = re.search(r"ReadSchema: struct<(.*)>", plans["store_summary"]).group(1)
    assert sorted(re.findall(r"(\w+):", schema)) == \
        ["customer_id", "revenue", "store_id", "store_location", "transaction_date", "transaction_qty"]


def test_top_n_is_cut_before_the_shuffle(plans):
    text = plans["top_n_per_group"]
    assert text.count("WindowGroupLimit (") >= 2   # partial before the exchange, final after


def test_price_reports_need_no_join(plans):
    for name in ("within_day_elasticity", "within_day_elasticity_minmax", "price_hold_whatif",
                 "two_price_day_revenue", "daily_units_mode", "daily_units_mean"):
        assert "Join" not in plans[name].split("\n\n")[0], name


def test_full_rankings_are_range_sliced(plans):
    for name in ("product_rank_in_category", "product_rank_in_group"):
        assert "Scan ExistingRDD" in plans[name], name   # the checkpointed slices


def test_sales_build_broadcasts_only_fixed_lookups(spark):
    if not have_data(SF_SMOKE):
        pytest.skip("no smoke data")
    tree = _plan(build_sales(spark, SF_SMOKE)).split("\n\n")[0]
    assert tree.count("BroadcastExchange (") == 2          # nation and region
    assert tree.count("SortMergeJoin") == 3                  # orders, lineitem, part (AQE may do otherwise)


def test_event_reports_take_the_hour_from_the_timestamp(plans):
    for name in ("time_parts", "time_names", "hourly_traffic", "basket_size_by_time", "peak_hours"):
        assert "date_format" not in plans[name], name


def test_date_sorts_can_split_a_hot_date(plans):
    for name in ("daily_price_units", "within_day_elasticity", "within_day_elasticity_minmax"):
        key = re.search(r"rangepartitioning\((.*)\)", plans[name]).group(1)
        assert "transaction_date" in key and "product_detail" in key, name
