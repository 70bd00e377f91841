"""Time-of-day reports: traffic by month × weekday × hour × store, basket size
by time, and peak hours per store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.calendar import month_from_name, weekday_sort_key
from tillroll.operators.enrich import with_time_names
from tillroll.operators.ranking import rank_within
from tillroll.operators.summary import summarize


def _time_order(cols: Sequence[str], with_month: bool = True):
    order = []
    if with_month and "month" in cols:
        order.append(month_from_name(F.col("month")).asc_nulls_last())
    if "day_of_week" in cols:
        order.append(weekday_sort_key(F.col("day_of_week")).asc())
    if "hour" in cols:
        order.append(F.col("hour").asc_nulls_last())
    return order


def hourly_traffic(df: DataFrame, by: Sequence[str] = ("month", "day_of_week", "hour", "store_location"),
                   time: str = "transaction_time") -> DataFrame:
    """Units and revenue per month, weekday, hour and store; in month,
    Monday-first weekday and hour order."""
    named = with_time_names(df, time=time)
    return summarize(named, list(by), {"total_transactions": "units", "total_revenue": "revenue"},
                     order=_time_order(by))


def basket_size_by_time(df: DataFrame,
                        by: Sequence[str] = ("store_location", "month", "day_of_week", "hour"),
                        time: str = "transaction_time", digits: int = 3,
                        basket: Sequence[str] = ("transaction",)) -> DataFrame:
    """E9 / E9′: units per basket by the given time keys, in Monday-first
    weekday and hour order (as the study orders it; month is not a sort key)."""
    named = with_time_names(df, time=time)
    return summarize(named, list(by), {"avg_transaction_qty": "units_per_basket"},
                     order=_time_order(by, with_month=False), digits=digits, basket=basket)


def peak_hours(df: DataFrame, store: str = "store_location", time: str = "transaction_time",
               top: int = 4) -> DataFrame:
    """Hours ranked by units per store; ``is_peak`` marks the ``top`` hours."""
    named = with_time_names(df, time=time)
    hourly = summarize(named, [store, "hour"], {"total_transactions": "units"})
    ranked = rank_within(hourly, [store], [F.col("total_transactions").desc_nulls_first()],
                         name="hour_rank", method="window")  # 24 hours a store
    return (ranked.withColumn("is_peak", F.col("hour_rank") <= top)
            .orderBy(F.col(store).asc_nulls_last(), F.col("hour_rank"), F.col("hour")))
