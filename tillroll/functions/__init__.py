from tillroll.functions.calendar import (
    DAY_NAMES, MONTH_NAMES, day_name, day_of_week, hour_of, hour_of_text, month_name,
    month_number, period_key, period_label, quarter_label, weekday_sort_key, year_month, year_quarter,
)
from tillroll.functions.elasticity import arc_elasticity
from tillroll.functions.groups import CAFE_DEFAULT, CAFE_GROUPS, group_of
from tillroll.functions.money import as_double, exact, line_revenue, ratio

__all__ = [
    "DAY_NAMES", "MONTH_NAMES", "day_name", "day_of_week", "hour_of", "hour_of_text",
    "month_name", "month_number", "period_key", "period_label", "quarter_label", "weekday_sort_key",
    "year_month", "year_quarter", "arc_elasticity", "CAFE_DEFAULT",
    "CAFE_GROUPS", "group_of", "as_double", "exact", "line_revenue", "ratio",
]
