"""Data-quality checks (read-only; each is one Spark job when evaluated)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preview_rows(df: DataFrame, n: int = 10, order: Sequence[Column] | None = None,
                 ordered: bool = True) -> DataFrame:
    """``n`` rows. Ordered (the default, all columns unless ``order`` is
    given) the preview is repeatable and planned as a distributed top-k
    (TakeOrderedAndProject: every task keeps only ``n`` rows). Unordered it
    is the study's plain LIMIT: Spark stops reading once it has ``n`` rows."""
    if not ordered:
        return df.limit(n)
    order = list(order) if order else [F.col(f"`{c}`").asc_nulls_last() for c in df.columns]
    return df.orderBy(*order).limit(n)


def row_count(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("transaction_id",),
                   name: str = "count") -> DataFrame:
    """Keys that occur more than once, with their row count. A hot key is
    combined map-side before the shuffle."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
            .where(F.col(name) > 1))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with a NULL in any of ``cols`` (default: every column)."""
    cols = list(cols) if cols else df.columns
    return df.where(any_of([F.col(f"`{c}`").isNull() for c in cols]))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: how many rows have it NULL (a single aggregate
    over all columns, then an unpivot of that one row)."""
    cols = list(cols) if cols else df.columns
    counts = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), F.lit(1))).alias(f"n{i}")
                      for i, c in enumerate(cols)])
    pairs = [x for i, c in enumerate(cols) for x in (F.lit(c), F.col(f"n{i}"))]
    return counts.select(F.stack(F.lit(len(cols)), *pairs).alias("column_name", "null_count"))


def nonpositive_rows(df: DataFrame, cols: Sequence[str] = ("transaction_qty", "unit_price")) -> DataFrame:
    """Rows where any of ``cols`` is zero or negative. NULL is not an
    outlier (three-valued logic, as in SQL)."""
    return df.where(any_of([F.col(c) <= 0 for c in cols]))


def date_range(df: DataFrame, col: str = "transaction_date") -> DataFrame:
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


def distinct_values(df: DataFrame, cols: Sequence[str] = ("store_id", "store_location")) -> DataFrame:
    return df.select(*cols).distinct()


def basket_collisions(df: DataFrame,
                      keys: Sequence[str] = ("transaction_date", "transaction_time", "store_id"),
                      name: str = "time_count", ordered: bool = True) -> DataFrame:
    """Key combinations shared by several lines: the evidence that lines
    must be grouped into baskets (in key order unless ``ordered=False``)."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)
    return out.orderBy(*[F.col(k).asc_nulls_last() for k in keys]) if ordered else out


def quality_measures(columns: Sequence[str], amounts: Sequence[str] = (), ranges: Sequence[str] = ()) -> dict[str, Column]:
    """P2, P4, P5 and P6 as aggregates that can ride on another job as observed
    metrics: rows, NULLs of each of ``columns``, values of ``amounts`` that are zero
    or less, least and greatest of ``ranges`` (dates, or text: they are compared as
    text). Each can be put together from the values of parts."""
    out = {"rows:": F.count(F.lit(1))}
    out |= {f"nulls:{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in columns}
    out |= {f"nonpositive:{c}": F.count(F.when(F.col(c) <= 0, 1)) for c in amounts}
    for c in ranges:
        out |= {f"least:{c}": F.min(c), f"greatest:{c}": F.max(c)}
    return out


def combined_measures(parts: Sequence[Mapping[str, str | None]]) -> list[tuple[str, str, str | None]]:
    """(measure, column, value) of the whole from the measures of its parts."""
    out = []
    for key in dict.fromkeys(k for p in parts for k in p):
        measure, column = key.split(":", 1)
        values = [v for p in parts if (v := p.get(key)) is not None]
        if measure in ("least", "greatest"):
            value = (min if measure == "least" else max)(values, default=None)
        else:
            value = str(sum(map(int, values)))
        out.append((measure, column, value))
    return out
