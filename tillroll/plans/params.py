"""Literal parameters of the reports.

The study hard-codes its own category and product names; ``STUDY`` holds
them (fixed values, for a sales table shaped like the study's), ``PROXY``
holds the values used on the driver's tables (p_type as category, p_brand
as type, p_name as product).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tillroll.functions.groups import CAFE_DEFAULT, CAFE_GROUPS
from tillroll.sources.sales import BASE_PRICE, HIKE_PRICE


@dataclass(frozen=True)
class ReportParams:
    groups: dict = field(default_factory=dict)           # E11-E13 category groups
    group_default: str | None = "Merchandise"
    group_categories: tuple = ()                         # E14: categories of the first group
    pair_categories: tuple = ()                          # E17: categories summarised by type
    top_types: tuple = ()                                # E15
    bottom_types: tuple = ()                             # E16
    one_categories: tuple = ()                           # E18, E19, E21, E22 (one report each)
    two_categories: tuple = ()                           # E20
    top_combos: int = 7                                  # A2
    combo: str = ""                                      # products inside one combo
    combo_categories: tuple = ()                         # tail sellers of that combo
    top_n: int = 3                                       # top / bottom products
    peak_hours: int = 4                                  # hours flagged as peak
    base_price: str = BASE_PRICE                         # A5, A6
    hike_price: str = HIKE_PRICE
    price_products: tuple | None = None                  # A4-A6 product filter (None: all)
    month_period: str = "month"                          # E3: 'month' (yyyy-MM) or 'month_name'
    quarter_period: str = "quarter"                      # E6: 'quarter' (yyyy-Qn) or 'quarter_label'
    full_rank_method: str = "range"                      # see tillroll.operators.ranking


# Values on the driver's tables.
PROXY = ReportParams(
    groups={"Beverages": ("ECONOMY", "STANDARD", "PROMO"), "Snacks": ("SMALL", "MEDIUM")},
    group_default="Merchandise",
    group_categories=("ECONOMY", "STANDARD", "PROMO"),
    pair_categories=("SMALL", "MEDIUM"),
    top_types=("Brand#1", "Brand#2", "Brand#3"),
    bottom_types=("Brand#22", "Brand#23", "Brand#24", "Brand#25"),
    one_categories=("LARGE", "SMALL", "MEDIUM", "PROMO"),
    two_categories=("LARGE", "SMALL"),
    combo="LARGE, STANDARD",
    combo_categories=("LARGE", "STANDARD"),
)

# The study's own literals, for a table shaped like its sales table
# (one half-year, so year-less month and quarter labels).
STUDY = ReportParams(
    groups=CAFE_GROUPS,
    group_default=CAFE_DEFAULT,
    group_categories=("Coffee", "Tea", "Loose Tea", "Drinking Chocolate", "Flavours"),
    pair_categories=("Bakery", "Packaged Chocolate"),
    top_types=("Barista Espresso", "Brewed Chai tea", "Hot chocolate", "Gourmet brewed coffee",
               "Brewed Black tea", "Brewed herbal tea"),
    bottom_types=("Chai tea", "Herbal tea", "Black tea", "Green tea"),
    one_categories=("Bakery", "Packaged Chocolate", "Coffee beans", "Branded"),
    two_categories=("Coffee beans", "Branded"),
    combo="Coffee, Flavours",
    combo_categories=("Coffee", "Bakery"),
    price_products=("Chocolate Chip Biscotti",),
    month_period="month_name",
    quarter_period="quarter_label",
)
