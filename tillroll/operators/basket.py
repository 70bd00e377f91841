"""Market-basket operators.

A basket's content lists its items sorted, duplicates kept ("Tea, Tea" is
possible: the study counts lines, not distinct items).

Plan, built to survive a basket or item that holds a large share of rows:
  1. aggregate to (basket, item): a line count and revenue per item. The
     partial aggregate combines a hot basket map-side, so what is shuffled is
     at most one row per (basket, item) per task. Baskets are grouped by the
     parts of their key, not by its text;
  2. aggregate to basket: a sorted list of (item, lines), at most one entry
     per distinct item. Combos are grouped and compared as these lists, so
     items that hold the separator stay apart.
The content's text, each item repeated once per line, is written in the last
projection only; for ``basket_combos`` that text is the statement's own
output, and a basket whose text passes 2 GB cannot be a row of it:
``basket_segments`` gives such a text in pieces of a fixed number of lines.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.money import exact, ratio
from tillroll.operators.joins import might_be_in
from tillroll.operators.ranking import rank_within

CONTENT = "_content"


def _key(parts: Sequence[str]) -> list[Column]:
    """The key's parts; all NULL as soon as one is (the key's text is NULL then)."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.col(p).isNotNull()
    return [F.when(whole, F.col(p)).alias(f"_key_{i}") for i, p in enumerate(parts)]


def basket_contents(df: DataFrame, parts: Sequence[str] = ("transaction",), item: str = "product_category",
                    keys: Sequence[str] = (), revenue: str = "revenue",
                    min_lines: int = 2, distinct: bool = False) -> DataFrame:
    """One row per basket with at least ``min_lines`` non-NULL items (or
    distinct items when ``distinct``): the key's parts as ``_key_0`` ..., keys,
    the sorted list of (item, lines) as ``_content``, and the revenue of all
    its lines."""
    key = [f"_key_{i}" for i in range(len(parts))]
    lines = df.select(*_key(parts), *keys, F.col(item).alias("_item"), F.col(revenue).alias("_revenue"))
    per_item = lines.groupBy(*key, *keys, "_item").agg(
        F.count("_item").alias("_n"), F.sum("_revenue").alias("_rev"))
    entry = F.when(F.col("_n") > 0, F.struct(
        F.col("_item").alias("item"), (F.lit(1).cast("bigint") if distinct else F.col("_n")).alias("n")))
    per_basket = (per_item.groupBy(*key, *keys)
                  .agg(F.sum("_n").alias("_lines"), F.count(entry).alias("_items"), F.sum("_rev").alias(revenue),
                       F.sort_array(F.collect_list(entry)).alias(CONTENT)))
    size = F.col("_items") if distinct else F.col("_lines")
    return per_basket.where(size >= min_lines).select(*key, *keys, CONTENT, revenue)


def _text(sep: str) -> Column:
    """A content as text, every item once per line."""
    return F.array_join(F.flatten(F.transform(
        CONTENT, lambda x: F.array_repeat(x["item"], x["n"].cast("int")))), sep)


def basket_combos(df: DataFrame, basket: str = "transaction", item: str = "product_category",
                  keys: Sequence[str] = ("store_id", "store_location"), ordered: bool = True,
                  parts: Sequence[str] | None = None, sep: str = ", ",
                  combo: str = "product_cate_combo", revenue: str = "revenue", **kw) -> DataFrame:
    """A1: content string and revenue of each multi-line basket, in basket
    order (``ordered=False`` skips that global sort of all baskets). ``parts``
    are the columns that make up the key ``basket`` (default: that column)."""
    parts = parts or (basket,)
    out = basket_contents(df, parts, item, keys, revenue, **kw)
    name = F.concat_ws(" ", *(F.col(f"_key_{i}").cast("string") for i in range(len(parts))))
    name = F.when(F.col("_key_0").isNotNull(), name) if len(parts) > 1 else F.col("_key_0")
    out = out.select(name.alias(basket), *keys, _text(sep).alias(combo), revenue)
    return out.orderBy(F.col(basket).asc_nulls_last()) if ordered else out


def basket_segments(df: DataFrame, parts: Sequence[str] = ("transaction",), item: str = "product_category",
                    lines: int = 1_000_000, sep: str = ", ", combo: str = "product_cate_combo",
                    min_lines: int = 2, ordered: bool = True) -> DataFrame:
    """The content strings of ``basket_combos`` in pieces: the key's parts,
    ``segment`` (from 0) and the text of that many ``lines`` of the content (the
    last piece has the rest), each but the first beginning with ``sep``, so that the
    pieces of a basket in order are its content string. The cut depends on the content alone.

    A basket is one row per distinct item, with where the item's lines begin in
    the content; a row goes to the segments its lines reach into and says how
    many of them lie there. So no row, task or group holds more than the
    distinct items of a basket or ``lines`` lines of text, whatever the basket's length."""
    key = list(parts)
    whole = df.where(F.col(item).isNotNull())
    for p in parts:
        whole = whole.where(F.col(p).isNotNull())
    per_item = whole.groupBy(*key, F.col(item).alias("_item")).agg(F.count(F.lit(1)).alias("_n"))
    basket = Window.partitionBy(*key)
    placed = (per_item.withColumn("_lines", F.sum("_n").over(basket)).where(F.col("_lines") >= min_lines)
              .withColumn("_end", F.sum("_n").over(basket.orderBy("_item").rowsBetween(Window.unboundedPreceding, 0))))
    start = F.col("_end") - F.col("_n")
    reached = placed.withColumn("segment", F.explode(F.sequence(
        F.floor(start / lines), F.floor((F.col("_end") - 1) / lines))))
    first, last = F.col("segment") * lines, (F.col("segment") + 1) * lines
    here = F.least("_end", last) - F.greatest(start, first)
    entry = F.struct(F.col("_item").alias("item"), here.alias("n"))
    out = reached.groupBy(*key, "segment").agg(F.sort_array(F.collect_list(entry)).alias(CONTENT))
    out = out.select(*key, "segment", F.concat(F.when(F.col("segment") > 0, sep).otherwise(""), _text(sep)).alias(combo))
    return out.orderBy(*(F.col(c).asc_nulls_last() for c in key), "segment") if ordered else out


def _combos(df: DataFrame, parts: Sequence[str], item: str, digits: int, **kw) -> DataFrame:
    baskets = basket_contents(df, parts, item, (), **kw)
    return (baskets.groupBy(CONTENT)
            .agg(F.count(F.lit(1)).alias("combo_transaction"),
                 F.sum("revenue").alias("total_revenue"),
                 ratio(F.sum("revenue"), exact(F.count(F.lit(1))), digits).alias("avg_transaction_value")))


def _named(combos: DataFrame, combo: str, sep: str) -> DataFrame:
    return combos.select(_text(sep).alias(combo), "combo_transaction", "total_revenue", "avg_transaction_value")


def combo_summary(df: DataFrame, item: str = "product_category", combo: str = "product_cate_combo",
                  digits: int = 2, parts: Sequence[str] = ("transaction",), sep: str = ", ", **kw) -> DataFrame:
    """A2 before its limit: per combo the number of baskets, their revenue
    and revenue per basket."""
    return _named(_combos(df, parts, item, digits, **kw), combo, sep)


def top_combos(df: DataFrame, n: int = 7, item: str = "product_category", combo: str = "product_cate_combo",
               digits: int = 2, parts: Sequence[str] = ("transaction",), sep: str = ", ", **kw) -> DataFrame:
    """A2: the ``n`` combos with the most revenue (ties broken by combo
    content). A distributed top-k: each task keeps ``n`` rows, and only those
    become text."""
    best = (_combos(df, parts, item, digits, **kw)
            .orderBy(F.col("total_revenue").desc_nulls_first(), F.col(CONTENT).asc()).limit(n))
    return _named(best, combo, sep).orderBy(F.col("total_revenue").desc_nulls_first(), F.col(combo).asc())


def _baskets_of(lines: DataFrame, key: Sequence[str], wanted: Counter, min_lines: int, distinct: bool) -> DataFrame:
    """Keys of the baskets that hold exactly the ``wanted`` items (each as often, or each at all when ``distinct``)."""
    n = [f"_n_{i}" for i in range(len(wanted))]
    counts = lines.groupBy(*key).agg(
        F.count(F.when(~F.col("_item").isin(*wanted), True)).alias("_others"),
        *(F.count(F.when(F.col("_item") == i, True)).alias(c) for i, c in zip(wanted, n, strict=True)))
    fits = F.col("_others") == 0
    for c, times in zip(n, wanted.values(), strict=True):
        fits = fits & (F.col(c) > 0 if distinct else F.col(c) == times)
    if (len(wanted) if distinct else wanted.total()) < min_lines:
        fits = F.lit(False)
    return counts.where(fits).select(*key)


def products_in_combo(df: DataFrame, combo_value: str | Sequence[str], parts: Sequence[str] = ("transaction",),
                      item: str = "product_category", product: str = "product_detail",
                      top: int | None = None, method: str | None = None, sep: str = ", ",
                      min_lines: int = 2, distinct: bool = False) -> DataFrame:
    """Best products inside the baskets of one combo (its items as a list, or
    as text that ``sep`` splits): the baskets whose content equals it (semi
    join back to their lines), then units and revenue per item × product
    ranked by revenue inside item.

    A content is compared without listing it: per basket, the lines of each
    wanted item and of all others are counted, which is one row of numbers a
    basket, combined map-side. Lines then pass a Bloom filter of the baskets found
    before the semi join shuffles what is left by basket; AQE splits the partition
    of a hot basket (left-semi joins are split on the left side)."""
    items = combo_value.split(sep) if isinstance(combo_value, str) else combo_value
    key = [f"_key_{i}" for i in range(len(parts))]
    baskets = _baskets_of(df.select(*_key(parts), F.col(item).alias("_item")).where(F.col(key[0]).isNotNull()),
                          key, Counter(items), min_lines, distinct)
    lines = might_be_in(df.select("*", *_key(parts)), baskets, key).join(baskets, key, "left_semi")
    per_product = (lines.groupBy(item, product)
                   .agg(F.sum("transaction_qty").alias("total_transactions"),
                        F.sum("revenue").alias("total_revenue")))
    return rank_within(per_product, [item], [F.col("total_revenue").desc_nulls_first()],
                       name="rank_by_revenue", top=top, method=method)
