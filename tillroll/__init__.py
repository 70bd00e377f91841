"""tillroll: retail sales analytics as composable Spark DataFrame operators.

Every operator takes a DataFrame and returns a DataFrame lazily; nothing is
collected to the driver. Money stays DECIMAL until the report edge.

Main entry points (imported on first use):

    sales(spark, sf_dir)          the wide sales table built from the driver's tables
    read_sales(spark, path, fmt)  a user's own sales table, with revenue and basket key
    study_reports(df)             every report of the study over one sales table
    summarize, period_growth, rank_within, basket_combos, top_combos,
    within_day_elasticity, price_hold_whatif, ...   the operators themselves
"""

from __future__ import annotations

from importlib import import_module

from tillroll.session import build_session, shared_dir

_LAZY = {
    "sales": "tillroll.sources.sales",
    "read_sales": "tillroll.sources.sales",
    "event_sales": "tillroll.sources.sales",
    "write_report": "tillroll.sources.sinks",
    "export_report": "tillroll.sources.sinks",
    "sales_quality": "tillroll.sources.sales",
    "study_reports": "tillroll.plans.reports",
    "summarize": "tillroll.operators.summary",
    "period_growth": "tillroll.operators.growth",
    "rank_within": "tillroll.operators.ranking",
    "bottom_within": "tillroll.operators.ranking",
    "basket_combos": "tillroll.operators.basket",
    "basket_segments": "tillroll.operators.basket",
    "combo_summary": "tillroll.operators.basket",
    "item_affinity": "tillroll.operators.affinity",
    "top_combos": "tillroll.operators.basket",
    "products_in_combo": "tillroll.operators.basket",
    "price_list": "tillroll.operators.pricing",
    "within_day_elasticity": "tillroll.operators.pricing",
    "price_hold_whatif": "tillroll.operators.pricing",
}

__all__ = ["build_session", "shared_dir", *_LAZY]


def __getattr__(name: str):
    if name in _LAZY:
        return getattr(import_module(_LAZY[name]), name)
    raise AttributeError(f"module 'tillroll' has no attribute {name!r}")
