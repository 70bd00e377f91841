"""Price reports: price lists, daily units per price, within-day arc
elasticity, price-change days and the hold-the-price what-if.

The study works on one product with literal prices; every operator here runs
for all products at once. The shared building block is the *daily* table
(product, date, price) → units, an aggregate that combines map-side, so a hot
product or day is reduced before the shuffle; everything after it works on
that much smaller table. No self-join: the base/raised price pair of a day
comes from one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.elasticity import arc_elasticity
from tillroll.functions.money import PRICE_TYPE, exact, ratio

DATE, QTY = "transaction_date", "transaction_qty"


def _in_date_order(df: DataFrame, *then: str) -> DataFrame:
    """Date order; the further keys let a sort split a date that holds many rows."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in (DATE, *then)))


def _price_lit(value) -> F.Column:
    return F.lit(Decimal(str(value))).cast(PRICE_TYPE)


def daily_units(df: DataFrame, product: str = "product_detail", price: str = "unit_price",
                date: str = DATE, qty: str = QTY, name: str = "total_qty") -> DataFrame:
    """(date, product, price) → units sold."""
    return df.groupBy(date, product, price).agg(F.sum(qty).alias(name))


def multi_price_products(df: DataFrame, product: str = "product_detail",
                         price: str = "unit_price") -> DataFrame:
    """A3: products sold at more than one price, with the number of prices."""
    return (df.groupBy(product).agg(F.countDistinct(price).alias("price_range"))
            .where(F.col("price_range") > 1))


def daily_price_units(df: DataFrame, products: Sequence[str] | None = None,
                      product: str = "product_detail", price: str = "unit_price",
                      ordered: bool = True) -> DataFrame:
    """A4: daily units per price, for the given products (all when None), in
    date order unless ``ordered=False``."""
    if products is not None:
        df = df.where(F.col(product).isin(list(products)))
    out = daily_units(df, product, price)
    return _in_date_order(out, product, price) if ordered else out


def price_list(df: DataFrame, by: Sequence[str] = ("product_category", "product_type", "product_detail"),
               price: str = "unit_price", revenue: str = "revenue", sep: str = ", ") -> DataFrame:
    """Products with two or more prices: their distinct prices in
    numeric order as text, and revenue; revenue first. The list holds a
    product's distinct prices, not its lines."""
    per_price = df.groupBy(*by, price).agg(F.sum(revenue).alias("_rev"))
    out = (per_price.groupBy(*by)
           .agg(F.count(price).alias("_prices"),
                F.sort_array(F.collect_list(price)).alias("_list"),
                F.sum("_rev").alias("total_revenue"))
           .where(F.col("_prices") > 1))
    return (out.select(*by, F.array_join(F.col("_list").cast("array<string>"), sep)
                       .alias("price_range"), "total_revenue")
            .orderBy(F.col("total_revenue").desc_nulls_first()))


def within_day_elasticity(df: DataFrame, product: str = "product_detail", price: str = "unit_price",
                          base_price=None, hike_price=None, digits: int = 4,
                          ordered: bool = True) -> DataFrame:
    """A5: arc elasticity between a day's base and raised price.

    With ``base_price``/``hike_price`` the two prices are those literals (the
    study's 3.50 → 4.38); otherwise each day's lowest and highest price
    (middle prices of a 3-price day are ignored). Days need units > 0 at both
    prices and two different prices. Date order unless ``ordered=False``."""
    if base_price is not None and hike_price is not None:
        pb, ph = _price_lit(base_price), _price_lit(hike_price)
        pairs = (df.groupBy(DATE, product)
                 .agg(F.sum(F.when(F.col(price) == pb, F.col(QTY))).alias("q_base"),
                      F.sum(F.when(F.col(price) == ph, F.col(QTY))).alias("q_hike"))
                 .withColumns({"p_base": pb, "p_hike": ph}))
    else:
        daily = daily_units(df, product, price, name="_q").where(F.col(price).isNotNull())
        pairs = (daily.groupBy(DATE, product)
                 .agg(F.min(price).alias("p_base"), F.min_by("_q", price).alias("q_base"),
                      F.max(price).alias("p_hike"), F.max_by("_q", price).alias("q_hike")))
    out = pairs.where((F.col("q_base") > 0) & (F.col("q_hike") > 0)
                      & (F.col("p_base") != F.col("p_hike")))
    out = out.select(
        DATE, product, F.lit("Price Hike").alias("change_type"),
        "p_base", F.col("q_base").cast("bigint").alias("q_base"),
        "p_hike", F.col("q_hike").cast("bigint").alias("q_hike"),
        arc_elasticity("q_base", "q_hike", "p_base", "p_hike", digits).alias("price_elasticity"))
    return _in_date_order(out, product) if ordered else out


def _per_day(df: DataFrame, product: str, price: str, base_price) -> DataFrame:
    """(product, date) → lowest and highest price, revenue at its prices,
    and units at the base price (``_has_base`` NULL when the day has no
    base-price line). One aggregate straight from the lines: a day has two
    or more prices exactly when its lowest price is below its highest, so no
    DISTINCT (and no Expand) is needed."""
    pb = _price_lit(base_price)
    at_base = F.col(price) == pb
    return (df.groupBy(product, DATE)
            .agg(F.min(price).alias("_pmin"), F.max(price).alias("_pmax"),
                 F.sum(F.col(price) * F.col(QTY)).alias("_rev"),
                 F.max(F.when(at_base, F.lit(1))).alias("_has_base"),
                 F.sum(F.when(at_base, F.col(QTY))).alias("_base_q")))


def _is_change_day() -> F.Column:
    return F.col("_pmin") < F.col("_pmax")


def price_change_dates(df: DataFrame, product: str = "product_detail",
                       price: str = "unit_price") -> DataFrame:
    """(product, date) pairs with two or more distinct prices."""
    return (df.groupBy(product, DATE).agg(F.min(price).alias("_pmin"), F.max(price).alias("_pmax"))
            .where(_is_change_day()).select(product, DATE))


def two_price_day_revenue(df: DataFrame, product: str = "product_detail",
                          price: str = "unit_price") -> DataFrame:
    """A6d: daily units and revenue per price on the price-change days.

    The study selects the days with an IN-subquery; here the daily table is
    aggregated first and a window over each (product, day) — a handful of
    rows, one per price — keeps the days with two prices, so the raw lines
    are shuffled once, combined, and never re-joined."""
    w = Window.partitionBy(product, DATE)
    daily = daily_units(df, product, price)
    return (daily.withColumn("_two", F.min(price).over(w) < F.max(price).over(w))
            .where(F.col("_two"))
            .select(DATE, product, price, "total_qty",
                    (F.col(price) * F.col("total_qty")).alias("revenue")))


def _base_days(days: DataFrame) -> DataFrame:
    return days.where(F.col("_has_base").isNotNull())


def daily_units_mode(df: DataFrame, product: str = "product_detail", price: str = "unit_price",
                     base_price="3.50") -> DataFrame:
    """Per product, the most frequent daily unit count on days with a
    base-price line (ties → the smaller count) and its frequency.

    Counts per (product, units) are a hash aggregate; the top one per product
    is a row_number ≤ 1 filter, which Spark plans as a WindowGroupLimit over
    at most one row per distinct unit count."""
    days = _base_days(_per_day(df, product, price, base_price))
    freq = (days.groupBy(product, "_base_q").agg(F.count("_base_q").alias("frequency"))
            .where(F.col("frequency") > 0))
    w = Window.partitionBy(product).orderBy(F.col("frequency").desc(), F.col("_base_q").asc())
    return (freq.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(product, F.col("_base_q").cast("bigint").alias("total_qty"), "frequency"))


def daily_units_mean(df: DataFrame, product: str = "product_detail", price: str = "unit_price",
                     base_price="3.50", digits: int = 4) -> DataFrame:
    """Per product, mean daily units on days with a base-price line
    (rounded to ``digits``)."""
    days = _base_days(_per_day(df, product, price, base_price))
    per = days.groupBy(product).agg(F.sum("_base_q").alias("_sq"), F.count(F.lit(1)).alias("_nb"))
    return per.select(product, ratio(exact(F.col("_sq")), exact(F.col("_nb")), digits).alias("avg_sales"))


def price_hold_whatif(df: DataFrame, product: str = "product_detail", price: str = "unit_price",
                      base_price="3.50", stats: Sequence[str] = ("mode", "avg")) -> DataFrame:
    """Per product with price-change days: the revenue actually taken on
    those days, against holding the base price with a statistic of the
    base-price daily units on each of those days: ``mode``, ``avg`` (the mean) or
    ``median`` (the exact middle, half-way between the two middle days of an
    even number), one column ``revenue_with_<stat>`` each.

    Two aggregates and no join: lines → (product, day), then per product the
    change-day revenue and count, the base-day sum and count, and the mode of
    the base-day units (Spark's ``mode`` with ``deterministic=True``: ties go
    to the smaller count). The first step combines map-side."""
    pb = _price_lit(base_price)
    days = _per_day(df, product, price, base_price)
    base, change = F.col("_has_base").isNotNull(), _is_change_day()
    units = F.when(base, F.col("_base_q"))
    of = {"mode": [F.mode(units, deterministic=True).alias("_mode_q")],
          "avg": [F.sum(units).alias("_sum_q"), F.count(F.when(base, F.lit(1))).alias("_base_days")],
          "median": [F.median(units).cast("decimal(19,1)").alias("_median_q")]}
    per = (days.groupBy(product)
           .agg(F.sum(F.when(change, F.col("_rev"))).alias("total_original_revenue"),
                F.count(F.when(change, F.lit(1))).alias("_change_days"),
                *(c for stat in stats for c in of[stat]))
           .where(F.col("_change_days") > 0))
    n_days = F.col("_change_days").cast("decimal(10,0)")

    def revenue(stat: str) -> F.Column:
        if stat == "avg":
            held = (F.col("_sum_q") * F.col("_change_days")).cast("decimal(20,0)") * pb
            return ratio(held, F.col("_base_days").cast("decimal(10,0)"), 2)
        held = F.col("_mode_q").cast("decimal(18,0)") if stat == "mode" else F.col("_median_q")
        return held * pb * n_days

    return per.select(product, "total_original_revenue", *(revenue(s).alias(f"revenue_with_{s}") for s in stats))


def price_change_calendar(df: DataFrame, product: str = "product_detail",
                          price: str = "unit_price") -> DataFrame:
    """Price-change days by day of month: how many (product, day) changes,
    how many products, and how many of those days were a month's last day."""
    dates = price_change_dates(df, product, price)
    return (dates.groupBy(F.dayofmonth(DATE).alias("day_of_month"))
            .agg(F.count(F.lit(1)).alias("change_days"),
                 F.countDistinct(product).alias("products"),
                 F.count(F.when(F.col(DATE) == F.last_day(DATE), F.lit(1))).alias("month_end_days"))
            .orderBy("day_of_month"))
