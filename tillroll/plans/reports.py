"""The study's statements as reports, with the study's column names.

Each report is a function of ``Inputs`` (where it reads from, plus literal
parameters) returning a lazy DataFrame. Two sets of inputs exist:

* ``proxy_inputs(spark, sf_dir)`` — the driver's tables (the wide sales
  table built from the star schema, ``events`` for time of day, the two-step
  price for the price study, documents ⟕ labels for NULL checks). The
  registered ``REPORTS`` (and ``__spark_entry__.queries()``) use these.
* ``study_inputs(df)`` — one sales table shaped like the study's; every
  report reads it, with the study's own literals (``params.STUDY``).
  ``study_reports(df)`` returns all reports for such a table.

Exact values stay DECIMAL inside; ``report_edge`` converts them to DOUBLE in
the last projection of the registered reports.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import affinity, basket, enrich, growth, pricing, quality, traffic
from tillroll.operators.joins import bounded_broadcast
from tillroll.operators.ranking import bottom_within, rank_within
from tillroll.operators.summary import metric, summarize
from tillroll.plans.edge import report_edge
from tillroll.plans.params import PROXY, STUDY, ReportParams
from tillroll.sources.sales import (BASKET_PARTS, EVENT_BASKET_PARTS, STUDY_BASKET_PARTS, event_sales, prepare_sales,
                                    sales)
from tillroll.sources.tables import read_table


@dataclass
class Inputs:
    """Zero-argument builders, evaluated lazily and at most once each."""
    build_sales: Callable[[], DataFrame]
    build_timed: Callable[[], DataFrame]
    build_priced: Callable[[], DataFrame]
    build_nullable: Callable[[], DataFrame]
    build_amounts: Callable[[], tuple[DataFrame, list[str]]]
    params: ReportParams
    time: str                        # time of day in ``timed``
    basket: Sequence[str]            # the basket key's parts in ``sales``
    timed_basket: Sequence[str]      # and in ``timed``

    @cached_property
    def sales(self) -> DataFrame:
        """Sales lines."""
        return self.build_sales()

    @cached_property
    def timed(self) -> DataFrame:
        """Sales lines with a time of day."""
        return self.build_timed()

    @cached_property
    def priced(self) -> DataFrame:
        """Lines for the price study: date, product_detail, unit_price, qty."""
        return self.build_priced()

    @property
    def price_focus(self) -> DataFrame:
        """``priced`` restricted to ``params.price_products`` (all when None)."""
        products = self.params.price_products
        return self.priced if products is None else self.priced.where(
            F.col("product_detail").isin(list(products)))

    @cached_property
    def nullable(self) -> DataFrame:
        """The table of the NULL checks."""
        return self.build_nullable()

    @cached_property
    def amounts(self) -> tuple[DataFrame, list[str]]:
        """The table and columns of the non-positive check."""
        return self.build_amounts()


def proxy_inputs(spark: SparkSession, sf_dir: str, params: ReportParams = PROXY) -> Inputs:
    def priced():
        # the price study's shape: product = brand, price = the line's two-step price
        return sales(spark, sf_dir).select(
            "transaction_date", "transaction_qty",
            F.col("product_type").alias("product_detail"), F.col("tier_price").alias("unit_price"))

    def nullable():
        docs = read_table(spark, sf_dir, "documents")
        # labels is narrow (three numbers): broadcast it while it has at most a
        # million rows, so document texts are never shuffled; beyond, sort-merge.
        labels = bounded_broadcast(read_table(spark, sf_dir, "labels"), 1_000_000)
        return docs.join(labels, on="doc_id", how="left")

    return Inputs(
        build_sales=lambda: sales(spark, sf_dir),
        build_timed=lambda: event_sales(spark, sf_dir),
        build_priced=priced,
        build_nullable=nullable,
        build_amounts=lambda: (read_table(spark, sf_dir, "customer"), ["c_acctbal"]),
        params=params, time="transaction_ts", basket=BASKET_PARTS, timed_basket=EVENT_BASKET_PARTS)


def study_inputs(df: DataFrame, params: ReportParams = STUDY) -> Inputs:
    lines = prepare_sales(df)
    # A table that brings its own basket key is grouped by that key.
    basket = ("transaction",) if "transaction" in df.columns else STUDY_BASKET_PARTS
    return Inputs(
        build_sales=lambda: lines,
        build_timed=lambda: lines,
        build_priced=lambda: lines,
        build_nullable=lambda: df,
        build_amounts=lambda: (df, ["transaction_qty", "unit_price"]),
        params=params, time="transaction_time", basket=basket, timed_basket=basket)


ReportFn = Callable[[Inputs], DataFrame]
STATEMENTS: dict[str, ReportFn] = {}


def report(name: str):
    def register(fn: ReportFn) -> ReportFn:
        STATEMENTS[name] = fn
        return fn
    return register


def desc_revenue():
    return F.col("total_revenue").desc_nulls_first()


PRODUCT_METRICS = {"total_transactions": "units", "total_revenue": "revenue",
                   "avg_transaction_value": "avg_unit_revenue"}


# ------------------------------------------------------------ data quality

@report("preview_rows")
def preview_rows(inp: Inputs) -> DataFrame:
    """Ten rows, in the order of all columns."""
    return quality.preview_rows(inp.sales, 10)


@report("row_count")
def row_count(inp: Inputs) -> DataFrame:
    """Number of sales lines."""
    return quality.row_count(inp.sales)


@report("duplicate_keys")
def duplicate_keys(inp: Inputs) -> DataFrame:
    """Transaction ids used by more than one line."""
    return quality.duplicate_keys(inp.sales, ["transaction_id"])


@report("null_rows")
def null_rows(inp: Inputs) -> DataFrame:
    """Rows with any NULL column."""
    return quality.null_rows(inp.nullable)


@report("null_profile")
def null_profile(inp: Inputs) -> DataFrame:
    """P4 as a profile: NULL count per column."""
    return quality.null_profile(inp.nullable)


@report("nonpositive_rows")
def nonpositive_rows(inp: Inputs) -> DataFrame:
    """P5: rows with a zero or negative amount."""
    table, cols = inp.amounts
    return quality.nonpositive_rows(table, cols)


@report("date_range")
def date_range(inp: Inputs) -> DataFrame:
    """First and last sales date."""
    return quality.date_range(inp.sales, "transaction_date")


@report("distinct_stores")
def distinct_stores(inp: Inputs) -> DataFrame:
    """Stores (id and name)."""
    return quality.distinct_values(inp.sales, ["store_id", "store_location"])


@report("basket_collisions")
def basket_collisions(inp: Inputs) -> DataFrame:
    """Lines sharing date, time and store."""
    return quality.basket_collisions(inp.sales, ["transaction_date", "transaction_time", "store_id"])


# -------------------------------------------------------------- enrichment

@report("time_parts")
def time_parts(inp: Inputs) -> DataFrame:
    """Month, weekday (Sunday = 0) and hour numbers."""
    return enrich.with_time_parts(inp.timed, time=inp.time).select("transaction_id", "month", "day_of_week", "hour")


@report("time_names")
def time_names(inp: Inputs) -> DataFrame:
    """Month and weekday names."""
    return enrich.with_time_names(inp.timed, time=inp.time).select("transaction_id", "month", "day_of_week", "hour")


@report("line_revenue")
def line_revenue(inp: Inputs) -> DataFrame:
    """Revenue of each line (qty × unit price)."""
    df = enrich.with_revenue(inp.sales.drop("revenue"))
    return df.select("transaction_id", "transaction_qty", "unit_price", "revenue")


@report("basket_key")
def basket_key(inp: Inputs) -> DataFrame:
    """Basket key of each line (the parts the sales table was keyed with)."""
    return inp.sales.select("transaction_id", "transaction")


@report("quarter_label")
def quarter_label(inp: Inputs) -> DataFrame:
    """Quarter of each line."""
    return enrich.with_quarter(inp.sales).select("transaction_id", "transaction_date", "quarter")


@report("category_group")
def category_group(inp: Inputs) -> DataFrame:
    """Category group of each line (CASE with ELSE)."""
    p = inp.params
    df = enrich.with_group(inp.sales, "product_category", p.groups, p.group_default)
    return df.select("transaction_id", "product_category", "category")


# ---------------------------------------------------------------- summaries

@report("store_summary")
def store_summary(inp: Inputs) -> DataFrame:
    """Revenue, units and revenue per basket by store."""
    return summarize(
        inp.sales, ["store_id", "store_location"],
        {"total_revenue": "revenue", "total_transactions": "units", "avg_transaction_value": "atv"},
        order=[desc_revenue()], basket=inp.basket)


@report("hourly_traffic")
def hourly_traffic(inp: Inputs) -> DataFrame:
    """Units and revenue by month, weekday, hour and store."""
    return traffic.hourly_traffic(inp.timed, time=inp.time)


@report("basket_size_by_store")
def basket_size_by_store(inp: Inputs) -> DataFrame:
    """Units per basket by store."""
    return summarize(inp.sales, ["store_id", "store_location"], {"avg_transaction_qty": "units_per_basket"},
                     basket=inp.basket)


@report("basket_size_by_time")
def basket_size_by_time(inp: Inputs) -> DataFrame:
    """Units per basket by store, month, weekday and hour."""
    return traffic.basket_size_by_time(inp.timed, time=inp.time, basket=inp.timed_basket)


@report("basket_size_by_dow_hour")
def basket_size_by_dow_hour(inp: Inputs) -> DataFrame:
    """E9′: units per basket by weekday and hour (the exported variant)."""
    return traffic.basket_size_by_time(inp.timed, ["day_of_week", "hour"], time=inp.time, basket=inp.timed_basket)


@report("basket_size_by_hour")
def basket_size_by_hour(inp: Inputs) -> DataFrame:
    """E9 over all stores and days: units per basket by hour."""
    return traffic.basket_size_by_time(inp.timed, ["hour"], time=inp.time, basket=inp.timed_basket)


@report("category_summary")
def category_summary(inp: Inputs) -> DataFrame:
    """Per category: types, products, units, revenue, revenue per unit."""
    return summarize(
        inp.sales, ["product_category"],
        {"total_product_types": ("distinct", "product_type"),
         "total_products": ("distinct", "product_detail"),
         "total_transactions": "units", "total_revenue": "revenue",
         "avg_transaction_value": "avg_unit_revenue"},
        order=[desc_revenue()])


@report("type_summary_in_categories")
def type_summary_in_categories(inp: Inputs) -> DataFrame:
    """Product types of the first category group."""
    return summarize(
        inp.sales, ["product_type"],
        {"total_products": ("distinct", "product_detail"), **PRODUCT_METRICS},
        where=F.col("product_category").isin(list(inp.params.group_categories)), order=[desc_revenue()])


@report("products_of_top_types")
def products_of_top_types(inp: Inputs) -> DataFrame:
    """Products of the named top types, revenue first."""
    return summarize(
        inp.sales, ["product_detail", "product_type"],
        {"total_transactions": "units", "total_revenue": "revenue"},
        where=F.col("product_type").isin(list(inp.params.top_types)), order=[desc_revenue()])


@report("products_of_bottom_types")
def products_of_bottom_types(inp: Inputs) -> DataFrame:
    """Products of the named bottom types, least revenue first."""
    return summarize(
        inp.sales, ["product_detail", "product_type"], PRODUCT_METRICS,
        where=F.col("product_type").isin(list(inp.params.bottom_types)),
        order=[F.col("total_revenue").asc_nulls_last()])


@report("type_summary_by_category")
def type_summary_by_category(inp: Inputs) -> DataFrame:
    """Category × type inside the second category group."""
    out = summarize(
        inp.sales, ["product_category", "product_type"],
        {"total_products": ("distinct", "product_detail"), **PRODUCT_METRICS},
        where=F.col("product_category").isin(list(inp.params.pair_categories)), order=[desc_revenue()])
    return out.select("product_type", "product_category", "total_products", "total_transactions",
                      "total_revenue", "avg_transaction_value")


def products_of_category(inp: Inputs, category: str) -> DataFrame:
    return summarize(
        inp.sales, ["product_detail", "product_type"], PRODUCT_METRICS,
        where=F.col("product_category") == F.lit(category), order=[desc_revenue()])


@report("products_in_category")
def products_in_category(inp: Inputs) -> DataFrame:
    """Products of one category (the first one named)."""
    return products_of_category(inp, inp.params.one_categories[0])


@report("products_in_categories")
def products_in_categories(inp: Inputs) -> DataFrame:
    """Products of a list of categories."""
    return summarize(
        inp.sales, ["product_detail", "product_type"], PRODUCT_METRICS,
        where=F.col("product_category").isin(list(inp.params.two_categories)), order=[desc_revenue()])


# ------------------------------------------------------------------ growth

@report("store_mom_growth")
def store_mom_growth(inp: Inputs) -> DataFrame:
    """Month revenue per store, previous month and growth."""
    return growth.period_growth(inp.sales, ["store_id", "store_location"], inp.params.month_period)


@report("store_qoq_growth")
def store_qoq_growth(inp: Inputs) -> DataFrame:
    """Quarter revenue per store, previous quarter and growth."""
    return growth.period_growth(inp.sales, ["store_id", "store_location"], inp.params.quarter_period)


# ----------------------------------------------------------------- ranking

@report("product_rank_in_category")
def product_rank_in_category(inp: Inputs) -> DataFrame:
    """Product rank inside its category by revenue, then line count."""
    per_product = inp.sales.groupBy("product_category", "product_detail").agg(
        F.countDistinct("transaction_id").alias("total_transactions"),
        F.sum("revenue").alias("total_revenue"),
        F.count("transaction_id").alias("_lines"))
    ranked = rank_within(per_product, ["product_category"],
                         [desc_revenue(), F.col("_lines").desc_nulls_first()],
                         name="rank_by_revenue", method=inp.params.full_rank_method)
    return ranked.select("rank_by_revenue", "product_detail", "product_category",
                         "total_transactions", "total_revenue")


def _group_products(inp: Inputs) -> DataFrame:
    p = inp.params
    df = enrich.with_group(inp.sales, "product_category", p.groups, p.group_default)
    return df.groupBy("category", "product_detail").agg(
        *[metric(kind).alias(name) for name, kind in PRODUCT_METRICS.items()])


GROUP_RANK_COLUMNS = ("rank_by_revenue", "category", "product_detail", "total_transactions",
                      "total_revenue", "avg_transaction_value")


@report("product_rank_in_group")
def product_rank_in_group(inp: Inputs) -> DataFrame:
    """Product rank inside its category group by revenue."""
    ranked = rank_within(_group_products(inp), ["category"], [desc_revenue()],
                         name="rank_by_revenue", method=inp.params.full_rank_method)
    return ranked.select(*GROUP_RANK_COLUMNS)


@report("top_n_per_group")
def top_n_per_group(inp: Inputs) -> DataFrame:
    """Top products of each category group (rank <= n, ties kept)."""
    ranked = rank_within(_group_products(inp), ["category"], [desc_revenue()],
                         name="rank_by_revenue", top=inp.params.top_n)
    return ranked.select(*GROUP_RANK_COLUMNS)


@report("bottom_n_per_category")
def bottom_n_per_category(inp: Inputs) -> DataFrame:
    """Tail sellers in the categories of a combo (rank from the bottom)."""
    df = inp.sales.where(F.col("product_category").isin(list(inp.params.combo_categories)))
    per_product = summarize(df, ["product_category", "product_detail"],
                            {"total_transactions": "units", "total_revenue": "revenue"})
    ranked = bottom_within(per_product, ["product_category"], ["total_revenue"], inp.params.top_n)
    return ranked.select("rank_from_bottom", "product_category", "product_detail",
                         "total_transactions", "total_revenue")


# ----------------------------------------------------------------- baskets

@report("basket_combos")
def basket_combos(inp: Inputs) -> DataFrame:
    """A1: content and revenue of each basket with two or more lines."""
    return basket.basket_combos(inp.sales, parts=inp.basket)


@report("combo_summary")
def combo_summary(inp: Inputs) -> DataFrame:
    """A2 without its limit: baskets, revenue and revenue per basket by combo."""
    return basket.combo_summary(inp.sales, parts=inp.basket)


@report("top_combos")
def top_combos(inp: Inputs) -> DataFrame:
    """A2: the combos with the most revenue (seven)."""
    return basket.top_combos(inp.sales, n=inp.params.top_combos, parts=inp.basket)


@report("products_in_combo")
def products_in_combo(inp: Inputs) -> DataFrame:
    """Best products inside the baskets of one combo, by category."""
    out = basket.products_in_combo(inp.sales, inp.params.combo, parts=inp.basket,
                                  method=inp.params.full_rank_method)
    return out.select("rank_by_revenue", "product_category", "product_detail", "total_transactions",
                      "total_revenue")


@report("category_affinity")
def category_affinity(inp: Inputs) -> DataFrame:
    """Pairs of categories bought together: support, confidence and lift."""
    return affinity.item_affinity(inp.sales, parts=inp.basket, with_item="with_category")


# ----------------------------------------------------------------- pricing

@report("multi_price_products")
def multi_price_products(inp: Inputs) -> DataFrame:
    """A3: products sold at more than one price."""
    return pricing.multi_price_products(inp.sales)


@report("price_list")
def price_list(inp: Inputs) -> DataFrame:
    """Price list text and revenue of multi-price products."""
    return pricing.price_list(inp.sales)


@report("daily_price_units")
def daily_price_units(inp: Inputs) -> DataFrame:
    """A4: daily units per price."""
    return pricing.daily_price_units(inp.price_focus)


@report("within_day_elasticity")
def within_day_elasticity(inp: Inputs) -> DataFrame:
    """A5: within-day arc elasticity between the base and raised price."""
    p = inp.params
    return pricing.within_day_elasticity(inp.price_focus, base_price=p.base_price, hike_price=p.hike_price)


@report("within_day_elasticity_minmax")
def within_day_elasticity_minmax(inp: Inputs) -> DataFrame:
    """A5 for any prices: each day's lowest against its highest price."""
    return pricing.within_day_elasticity(inp.price_focus)


@report("price_change_dates")
def price_change_dates(inp: Inputs) -> DataFrame:
    """Product days with two or more prices."""
    return pricing.price_change_dates(inp.price_focus)


@report("two_price_day_revenue")
def two_price_day_revenue(inp: Inputs) -> DataFrame:
    """A6d: units and revenue per price on price-change days."""
    return pricing.two_price_day_revenue(inp.price_focus)


@report("daily_units_mode")
def daily_units_mode(inp: Inputs) -> DataFrame:
    """Most frequent daily units at the base price."""
    return pricing.daily_units_mode(inp.price_focus, base_price=inp.params.base_price)


@report("daily_units_mean")
def daily_units_mean(inp: Inputs) -> DataFrame:
    """Mean daily units at the base price."""
    return pricing.daily_units_mean(inp.price_focus, base_price=inp.params.base_price)


@report("price_hold_whatif")
def price_hold_whatif(inp: Inputs) -> DataFrame:
    """Revenue on price-change days against holding the base price."""
    return pricing.price_hold_whatif(inp.price_focus, base_price=inp.params.base_price)


@report("price_hold_whatif_median")
def price_hold_whatif_median(inp: Inputs) -> DataFrame:
    """A6 with the median of the daily units."""
    return pricing.price_hold_whatif(inp.price_focus, base_price=inp.params.base_price, stats=("median",))


@report("price_change_calendar")
def price_change_calendar(inp: Inputs) -> DataFrame:
    """Price-change days by day of month, with month-end days (all products)."""
    return pricing.price_change_calendar(inp.priced)


# ------------------------------------------------------------ time of day

@report("peak_hours")
def peak_hours(inp: Inputs) -> DataFrame:
    """Hours ranked by units per store, with the peak hours flagged."""
    return traffic.peak_hours(inp.timed, time=inp.time, top=inp.params.peak_hours)


# ------------------------------------------------------------ registries

Report = Callable[[SparkSession, str], DataFrame]


def _registered(fn: ReportFn, params: ReportParams = PROXY) -> Report:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report_edge(fn(proxy_inputs(spark, sf_dir, params)))
    run.__doc__ = fn.__doc__
    run.__name__ = fn.__name__
    return run


# The driver contract: every report on the driver's tables, (spark, sf_dir) -> DataFrame.
REPORTS: dict[str, Report] = {name: _registered(fn) for name, fn in STATEMENTS.items()}

# The literal forms of some statements: the other single categories, growth
# without the year, and the price study of one product.
for _i, _category in enumerate(PROXY.one_categories[1:], start=2):
    REPORTS[f"products_in_category_{_i}"] = _registered(
        products_in_category, replace(PROXY, one_categories=(_category,)))
_YEARLESS = replace(PROXY, month_period="month_name", quarter_period="quarter_label")
REPORTS["store_mom_growth_yearless"] = _registered(store_mom_growth, _YEARLESS)
REPORTS["store_qoq_growth_yearless"] = _registered(store_qoq_growth, _YEARLESS)
_ONE = replace(PROXY, price_products=("Brand#13",))
for _fn in (daily_price_units, within_day_elasticity, price_hold_whatif):
    REPORTS[f"{_fn.__name__}_one"] = _registered(_fn, _ONE)


class LazyReports(Mapping):
    """Report name to DataFrame; a report is built when it is first looked up
    (full rankings run a job when they are built)."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name) -> bool:
        return name in self._builders

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def study_reports(df: DataFrame, params: ReportParams = STUDY) -> Mapping[str, DataFrame]:
    """Every report over one sales table shaped like the study's, with the
    study's literals; the single-category drill-down appears once per
    category in ``params.one_categories``. Reports are built on access."""
    inp = study_inputs(df, params)
    out = {name: partial(fn, inp) for name, fn in STATEMENTS.items() if name != "products_in_category"}
    for category in params.one_categories:
        out[f"products_in_category[{category}]"] = partial(products_of_category, inp, category)
    return LazyReports(out)
