"""Exact money arithmetic.

Sums run on DECIMAL and ratios divide DECIMALs before rounding, so results
are the same on any partitioning (no floating point order effects) and
round half away from zero like NUMERIC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_TYPE = "decimal(10,2)"
REVENUE_TYPE = "decimal(12,2)"
COUNT_TYPE = "decimal(20,0)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def line_revenue(qty="transaction_qty", price="unit_price", dtype: str = REVENUE_TYPE) -> Column:
    return (_c(qty) * _c(price)).cast(dtype)


def exact(col) -> Column:
    """An integer expression as DECIMAL(20,0), so ``/`` stays exact."""
    return _c(col).cast(COUNT_TYPE)


def ratio(num, den, digits: int) -> Column:
    """round(num / den, digits) for DECIMAL operands (wrap integers in
    ``exact``); NULL when den is 0 or NULL instead of a division error."""
    return F.round(F.try_divide(_c(num), F.nullif(_c(den), F.lit(0))), digits)


def as_double(col) -> Column:
    """Report-edge conversion of an exact value."""
    return _c(col).cast("double")
