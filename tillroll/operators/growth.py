"""Period-over-period growth (month over month, quarter over quarter).

Plan: one aggregate to (group, period) — partial aggregation map-side, a
shuffle of at most groups × periods rows — then a window per group ordered
by period. A window partition holds one row per period of one group, so its
size is bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.calendar import period_key, period_label
from tillroll.functions.money import ratio


def period_growth(df: DataFrame, by: Sequence[str], period: str = "month",
                  measure: str = "revenue", date: str = "transaction_date",
                  partition: Sequence[str] | None = None, digits: int = 3,
                  period_name: str | None = None, total: str = "total_revenue",
                  previous: str | None = None, growth: str | None = None) -> DataFrame:
    """Total of ``measure`` per ``by`` × period, the previous period's total
    (previous *row*: a missing period is skipped, as LAG does) and the growth
    (total - previous) / previous rounded to ``digits``. A zero previous
    total gives NULL instead of a division error.

    ``period``: 'month' / 'quarter' (year-aware, labelled 'yyyy-MM' /
    'yyyy-Qn'), or 'month_name' / 'quarter_label' (year-less, for data inside
    one year)."""
    base = "month" if period.startswith("month") else "quarter"
    period_name = period_name or base
    short = "month" if base == "month" else "quarter"
    previous = previous or f"prev_{short}_revenue"
    growth = growth or ("mom_revenue_growth" if base == "month" else "qtr_revenue_growth")
    partition = list(partition) if partition is not None else [by[0]] if by else []

    agg = (df.groupBy(*by, period_key(period, date).alias("_period"))
             .agg(F.sum(measure).alias(total)))
    w = Window.partitionBy(*partition).orderBy(F.col("_period").asc_nulls_last())
    prev = F.col(previous)
    out = (agg.withColumn(previous, F.lag(total).over(w))
              .withColumn(growth, ratio(F.col(total) - prev, prev, digits))
              .withColumn(period_name, period_label(period, F.col("_period"))))
    return (out.orderBy(*[F.col(c).asc_nulls_last() for c in partition], F.col("_period").asc_nulls_last())
               .select(*by, period_name, total, previous, growth))
