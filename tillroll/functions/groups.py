"""Category → group mapping as a CASE expression (no join, no shuffle)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cafe grouping of product categories into three groups.
CAFE_GROUPS: dict[str, tuple[str, ...]] = {
    "Beverages": ("Coffee", "Tea", "Loose Tea", "Drinking Chocolate", "Flavours"),
    "Snacks": ("Bakery", "Packaged Chocolate"),
}
CAFE_DEFAULT = "Merchandise"


def group_of(col, mapping: Mapping[str, Sequence[str]], default: str | None) -> Column:
    """First matching group wins; anything else, NULL included, is ``default``
    (a CASE with ELSE). Pass ``default=None`` for a CASE without ELSE."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for group, members in mapping.items():
        cond = c.isin(list(members))
        expr = F.when(cond, F.lit(group)) if expr is None else expr.when(cond, F.lit(group))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))
