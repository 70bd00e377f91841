"""Which items are bought together: support, confidence and lift of item pairs.

Plan, built to survive a basket with a large share of the lines and baskets that
hold the same items:
  1. baskets become sorted sets of items (``basket.basket_contents``: lines are
     combined to (basket, item) map-side, so a hot basket is its items, not its lines);
  2. equal sets are counted. There are at most as many sets as the catalogue
     has combinations, far fewer than baskets for a catalogue of categories;
  3. a set is written out as its pairs once, weighted by its count, and the
     pairs are combined map-side. An item paired with itself carries the item's
     own baskets, so one aggregate gives pairs and items.
Exact for any catalogue; a set of m items gives m x m rows, so for products
rather than categories the length of the longest basket sets the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.money import ratio
from tillroll.operators.basket import CONTENT, basket_contents

COUNT = "decimal(18,0)"  # products of two counts stay exact


def _n(col: str) -> Column:
    return F.col(col).cast(COUNT)


def item_affinity(df: DataFrame, parts: Sequence[str] = ("transaction",), item: str = "product_category",
                  with_item: str | None = None, revenue: str = "revenue", min_baskets: int = 1,
                  digits: int = 4, ordered: bool = True) -> DataFrame:
    """One row per ordered pair of different items that ``min_baskets`` baskets
    hold: baskets with both and with the first, support (both / all baskets),
    confidence (both / first) and lift (confidence / share of the second), by
    lift, then baskets, highest first. All baskets: those with at least one item.
    Lines without an item or a whole basket key take no part."""
    other = with_item or f"with_{item}"
    whole = df.where(F.concat(*(F.col(p).cast("string") for p in parts)).isNotNull() & F.col(item).isNotNull())
    baskets = basket_contents(whole, parts, item, (), revenue, min_lines=1, distinct=True)
    sets = baskets.groupBy(CONTENT).agg(F.count(F.lit(1)).alias("_n"))
    total = sets.agg(F.sum("_n").cast(COUNT)).scalar()
    first = sets.select("_n", CONTENT, F.explode(f"{CONTENT}.item").alias("_a"))
    pairs = (first.select("_n", "_a", F.explode(f"{CONTENT}.item").alias("_b"))
             .groupBy("_a", "_b").agg(F.sum("_n").alias("_both")))
    own = F.when(F.col("_a") == F.col("_b"), F.col("_both"))  # windows of at most a row per item of the catalogue
    out = (pairs.withColumn("_with_a", F.max(own).over(Window.partitionBy("_a")))
           .withColumn("_with_b", F.max(own).over(Window.partitionBy("_b")))
           .where(F.col("_a") != F.col("_b")).where(F.col("_both") >= min_baskets))
    out = out.select(
        F.col("_a").alias(item), F.col("_b").alias(other), F.col("_both").alias("baskets"),
        F.col("_with_a").alias("item_baskets"), ratio(_n("_both"), total, digits).alias("support"),
        ratio(_n("_both"), _n("_with_a"), digits).alias("confidence"),
        ratio(_n("_both") * total, _n("_with_a") * _n("_with_b"), digits).alias("lift"))
    if not ordered:
        return out
    return out.orderBy(F.col("lift").desc(), F.col("baskets").desc(), F.col(item), F.col(other))
