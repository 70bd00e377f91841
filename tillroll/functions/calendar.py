"""Calendar column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month and weekday names, as the reports print them.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December")
# Indexed by day-of-week number with Sunday = 0.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
# Report order of weekdays: Monday first, Sunday last, anything else after.
WEEKDAY_ORDER = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_number(date) -> Column:
    return F.month(_c(date))


def day_of_week(date) -> Column:
    """Day of week with Sunday = 0 (Spark's ``dayofweek`` has Sunday = 1)."""
    return F.dayofweek(_c(date)) - F.lit(1)


def hour_of(time) -> Column:
    """Hour from a timestamp column or an 'HH:mm:ss' string column."""
    return F.hour(_c(time))


def hour_of_text(time) -> Column:
    return F.substring_index(_c(time), ":", 1).cast("int")


def month_name(date, names=MONTH_NAMES) -> Column:
    """English month name; a month outside ``names`` gives NULL (a short list
    reproduces a CASE without ELSE)."""
    m = month_number(date)
    return F.when(m <= F.lit(len(names)), F.element_at(F.array(*[F.lit(n) for n in names]), m))


def day_name(date) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), day_of_week(date) + F.lit(1))


def weekday_sort_key(day_name_col) -> Column:
    """Monday = 1 … Sunday = 7, case-blind; unknown or NULL = 8."""
    low = F.lower(_c(day_name_col))
    key = F.lit(8)
    for i, name in reversed(list(enumerate(WEEKDAY_ORDER, start=1))):
        key = F.when(low == F.lit(name), F.lit(i)).otherwise(key)
    return key


def month_from_name(name_col) -> Column:
    """Month number from an English month name (NULL when unknown)."""
    low = F.lower(_c(name_col))
    key = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(MONTH_NAMES, start=1))):
        key = F.when(low == F.lit(name.lower()), F.lit(i)).otherwise(key)
    return key


def quarter_label(date) -> Column:
    """'Q1' … 'Q4' (year-less, as the single-year reports use)."""
    return F.concat(F.lit("Q"), F.quarter(_c(date)).cast("string"))


def year_month(date) -> Column:
    """Sortable year-month label 'yyyy-MM' for multi-year data."""
    return F.date_format(_c(date), "yyyy-MM")


def year_quarter(date) -> Column:
    """Sortable year-quarter label 'yyyy-Qn'."""
    d = _c(date)
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


PERIODS = ("month", "quarter", "month_name", "quarter_label")


def period_key(period: str, date) -> Column:
    """Sortable grouping key of a period: the first day of the month or
    quarter (multi-year safe), or the month / quarter number (year-less)."""
    d = _c(date)
    if period == "month":
        return F.trunc(d, "month")
    if period == "quarter":
        return F.trunc(d, "quarter")
    if period == "month_name":
        return F.month(d)
    if period == "quarter_label":
        return F.quarter(d)
    raise ValueError(f"unknown period {period!r}; one of {PERIODS}")


def period_label(period: str, key) -> Column:
    """Printable label of a ``period_key`` value."""
    k = _c(key)
    if period == "month":
        return year_month(k)
    if period == "quarter":
        return year_quarter(k)
    if period == "month_name":
        return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), k)
    if period == "quarter_label":
        return F.concat(F.lit("Q"), k.cast("string"))
    raise ValueError(f"unknown period {period!r}; one of {PERIODS}")
