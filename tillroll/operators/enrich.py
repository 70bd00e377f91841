"""Derived columns (one narrow Project each; nothing shuffles).

The study adds these in place with ALTER + UPDATE; here each is a pure
``withColumns`` so re-running is harmless.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType

from tillroll.functions import calendar as cal
from tillroll.functions.groups import CAFE_DEFAULT, CAFE_GROUPS, group_of
from tillroll.functions.money import REVENUE_TYPE, line_revenue


def _hour_expr(df: DataFrame, time_col: str):
    dtype = df.schema[time_col].dataType
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return cal.hour_of(time_col)
    if isinstance(dtype, StringType):
        return cal.hour_of_text(time_col)
    raise TypeError(f"{time_col} must be a timestamp or an 'HH:mm:ss' string, not {dtype}")


def with_time_parts(df: DataFrame, date: str = "transaction_date",
                    time: str = "transaction_time") -> DataFrame:
    """month (1-12), day_of_week (Sunday = 0) and hour, as integers."""
    return df.withColumns({
        "month": cal.month_number(date),
        "day_of_week": cal.day_of_week(date),
        "hour": _hour_expr(df, time),
    })


def with_time_names(df: DataFrame, date: str = "transaction_date",
                    time: str = "transaction_time",
                    month_names: Sequence[str] = cal.MONTH_NAMES) -> DataFrame:
    """month and day_of_week as English names, hour as an integer.

    ``month_names`` shorter than 12 leaves later months NULL, like a CASE
    without ELSE."""
    return df.withColumns({
        "month": cal.month_name(date, month_names),
        "day_of_week": cal.day_name(date),
        "hour": _hour_expr(df, time),
    })


def with_revenue(df: DataFrame, qty: str = "transaction_qty", price: str = "unit_price",
                 dtype: str = REVENUE_TYPE, name: str = "revenue") -> DataFrame:
    return df.withColumn(name, line_revenue(qty, price, dtype))


def with_basket_key(df: DataFrame, parts: Sequence[str], sep: str = " ",
                    name: str = "transaction") -> DataFrame:
    """Concatenate the parts as text; a NULL part gives a NULL key (``||``)."""
    pieces = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(F.col(p).cast("string"))
    return df.withColumn(name, F.concat(*pieces))


def with_quarter(df: DataFrame, date: str = "transaction_date", name: str = "quarter",
                 with_year: bool = False) -> DataFrame:
    expr = cal.year_quarter(date) if with_year else cal.quarter_label(date)
    return df.withColumn(name, expr)


def with_group(df: DataFrame, col: str = "product_category",
               mapping: Mapping[str, Sequence[str]] = CAFE_GROUPS,
               default: str | None = CAFE_DEFAULT, name: str = "category") -> DataFrame:
    return df.withColumn(name, group_of(col, mapping, default))
