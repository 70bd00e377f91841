"""One grouped-summary operator with a small metric vocabulary.

The study uses ``total_transactions`` and ``avg_transaction_value`` for
several different measures; here each measure has its own name and reports
alias them at the edge:

================  =================================================
units             SUM(transaction_qty)
revenue           SUM(revenue)                (DECIMAL)
lines             COUNT(DISTINCT transaction_id)
line_count        COUNT(transaction_id)
baskets           COUNT(DISTINCT transaction)
atv               revenue / baskets, rounded   (per basket)
units_per_basket  units / baskets, rounded
avg_unit_revenue  revenue / units, rounded     (per unit)
("distinct", c)   COUNT(DISTINCT c)
================  =================================================

All are exact (COUNT DISTINCT is never approximated). Spark plans sums with
a map-side partial aggregate, so a hot group is combined before the shuffle;
DISTINCT counts become a two-level aggregate keyed by (group, value).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tillroll.functions.money import exact, ratio

QTY, REVENUE, LINE_ID = "transaction_qty", "revenue", "transaction_id"
BASKET = ("transaction",)


def basket_count(parts: Sequence[str], by: Sequence[str] = ()) -> Column:
    """Distinct baskets by the parts of their key; a NULL part is no basket.
    Parts that are grouped by anyway are only checked for NULL."""
    rest = [p for p in parts if p not in by]
    if not rest:
        return F.countDistinct(F.when(F.concat(*(F.col(p).cast("string") for p in parts)).isNotNull(), F.lit(1)))
    first = F.col(rest[0])
    for p in parts:
        if p in by:
            first = F.when(F.col(p).isNotNull(), first)
    return F.countDistinct(first, *rest[1:])


def metric(kind, digits: int = 3, basket: Sequence[str] = BASKET, by: Sequence[str] = ()) -> Column:
    if isinstance(kind, tuple):
        op, col = kind
        if op != "distinct":
            raise ValueError(f"unknown metric {kind!r}")
        return F.countDistinct(col)
    if kind == "units":
        return F.sum(QTY)
    if kind == "revenue":
        return F.sum(REVENUE)
    if kind == "lines":
        return F.countDistinct(LINE_ID)
    if kind == "line_count":
        return F.count(LINE_ID)
    if kind == "baskets":
        return basket_count(basket, by)
    if kind == "atv":
        return ratio(F.sum(REVENUE), exact(basket_count(basket, by)), digits)
    if kind == "units_per_basket":
        return ratio(exact(F.sum(QTY)), exact(basket_count(basket, by)), digits)
    if kind == "avg_unit_revenue":
        return ratio(F.sum(REVENUE), exact(F.sum(QTY)), digits)
    raise ValueError(f"unknown metric {kind!r}")


# Metrics that can be recomputed from partial sums per (group, distinct columns).
_ADDITIVE = {"units", "revenue", "line_count", "avg_unit_revenue"}


def summarize(df: DataFrame, by: Sequence[str], metrics: Mapping[str, object],
              where: Column | None = None, order: Sequence[Column] | None = None,
              digits: int = 3, basket: Sequence[str] = BASKET) -> DataFrame:
    """``basket`` names the columns that make a basket's key. ``where`` is applied before grouping (and reaches the parquet scan);
    ``order`` sorts the result (a range shuffle of the small aggregate).

    Several DISTINCT counts on different columns would make Spark expand every
    input row once per DISTINCT column before its map-side aggregate. When the
    other metrics are sums, the lines are first summed per (group, distinct
    columns) — catalog-sized, combined map-side — and the DISTINCT counts run
    on that small table instead."""
    if where is not None:
        df = df.where(where)
    distinct = list(dict.fromkeys(k[1] for k in metrics.values() if isinstance(k, tuple)))
    if len(distinct) >= 2 and all(isinstance(k, tuple) or k in _ADDITIVE for k in metrics.values()):
        out = _distinct_over_sums(df, by, metrics, distinct, digits)
    else:
        out = df.groupBy(*by).agg(*[metric(kind, digits, basket, by).alias(name) for name, kind in metrics.items()])
    if order:
        out = out.orderBy(*order)
    return out


def _sum_type(df: DataFrame, col: str) -> str | None:
    """The type Spark gives SUM(col) for a DECIMAL column, so the second
    level keeps the one-level precision."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, DecimalType):
        return f"decimal({min(38, dtype.precision + 10)},{dtype.scale})"
    return None


def _distinct_over_sums(df: DataFrame, by: Sequence[str], metrics: Mapping[str, object],
                        distinct: Sequence[str], digits: int) -> DataFrame:
    names = {k for k in metrics.values() if not isinstance(k, tuple)}
    parts = {}
    if names & {"units", "avg_unit_revenue"}:
        parts["_units"] = F.sum(QTY)
    if names & {"revenue", "avg_unit_revenue"}:
        parts["_rev"] = F.sum(REVENUE)
    if "line_count" in names:
        parts["_lines"] = F.count(LINE_ID)
    keys = list(by) + [c for c in distinct if c not in by]
    pre = df.groupBy(*keys).agg(*[e.alias(n) for n, e in parts.items()])
    rev_type = _sum_type(df, REVENUE) if "_rev" in parts else None
    revenue = F.sum("_rev").cast(rev_type) if rev_type else F.sum("_rev")

    def level2(kind):
        if isinstance(kind, tuple):
            return F.countDistinct(kind[1])
        if kind == "units":
            return F.sum("_units")
        if kind == "revenue":
            return revenue
        if kind == "line_count":
            return F.sum("_lines")
        return ratio(revenue, exact(F.sum("_units")), digits)      # avg_unit_revenue

    return pre.groupBy(*by).agg(*[level2(kind).alias(name) for name, kind in metrics.items()])
