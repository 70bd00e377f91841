import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import basket, pricing
from tests.conftest import line


def _baskets(make_sales):
    rows = [
        # basket 1: A + B
        line(1, "2023-01-02", "07:00:00", 1, 3, "2.00", "A"), line(2, "2023-01-02", "07:00:00", 1, 3, "3.00", "B"),
        # basket 2: B + A (other order)
        line(3, "2023-01-02", "08:00:00", 2, 3, "3.00", "B"), line(4, "2023-01-02", "08:00:00", 1, 3, "2.00", "A"),
        # basket 3: A + A (duplicates kept)
        line(5, "2023-01-02", "09:00:00", 1, 3, "2.00", "A"), line(6, "2023-01-02", "09:00:00", 1, 3, "2.00", "A"),
        # basket 4: A alone (dropped)
        line(7, "2023-01-02", "10:00:00", 1, 3, "2.00", "A"),
        # basket 5: A + NULL category: one counted line, dropped; NULL revenue still summed elsewhere
        line(8, "2023-01-02", "11:00:00", 1, 3, "2.00", "A"), line(9, "2023-01-02", "11:00:00", 1, 3, "1.00", None),
    ]
    return make_sales(rows)


def test_combos_sorted_duplicates_kept_singles_dropped(make_sales):
    df = _baskets(make_sales)
    got = sorted((r.transaction, r.product_cate_combo, r.revenue) for r in basket.basket_combos(df).collect())
    assert got == [("2023-01-02 07:00:00 3", "A, B", Decimal("5.00")),
                   ("2023-01-02 08:00:00 3", "A, B", Decimal("8.00")),
                   ("2023-01-02 09:00:00 3", "A, A", Decimal("4.00"))]
    summary = sorted(tuple(r) for r in basket.combo_summary(df).collect())
    assert summary == [("A, A", 1, Decimal("4.00"), Decimal("4.00")),
                       ("A, B", 2, Decimal("13.00"), Decimal("6.50"))]
    top = [r.product_cate_combo for r in basket.top_combos(df, n=1).collect()]
    assert top == ["A, B"]
    distinct = sorted(r.product_cate_combo for r in basket.basket_combos(df, distinct=True).collect())
    assert distinct == ["A, B", "A, B"]


def test_combos_independent_of_row_order_and_partitions(make_sales):
    df = _baskets(make_sales)
    base = sorted(tuple(r) for r in basket.basket_combos(df).collect())
    for n in (1, 3, 7):
        shuffled = df.repartition(n).orderBy("transaction_id", ascending=False)
        assert sorted(tuple(r) for r in basket.basket_combos(shuffled).collect()) == base


def test_items_that_hold_the_separator_stay_apart(make_sales):
    df = make_sales([line(1, "2023-01-02", "07:00:00", 1, 3, "2.00", "A, B"), line(2, "2023-01-02", "07:00:00", 1, 3, "1.00", "C"),
                     line(3, "2023-01-02", "08:00:00", 1, 3, "2.00", "A"), line(4, "2023-01-02", "08:00:00", 1, 3, "3.00", "B, C")])
    assert sorted(tuple(r)[:3] for r in basket.combo_summary(df).collect()) == [
        ("A, B, C", 1, Decimal("3.00")), ("A, B, C", 1, Decimal("5.00"))]
    found = {r.product_category for r in basket.products_in_combo(df, ["A, B", "C"]).collect()}
    assert found == {"A, B", "C"}


def test_key_parts_and_key_text_give_the_same_baskets(make_sales):
    df, parts = _baskets(make_sales), ("transaction_date", "transaction_time", "store_id")
    for fn in (basket.basket_combos, basket.combo_summary):
        assert sorted(map(tuple, fn(df, parts=parts).collect())) == sorted(map(tuple, fn(df).collect()))


def test_hot_basket(spark):
    df = spark.range(1_000_000).selectExpr(
        "'k' as transaction", "1 as store_id", "'s' as store_location", "cast(id % 3 as string) as product_category",
        "cast(1 as decimal(12,2)) as revenue")
    assert [r.combo_transaction for r in basket.combo_summary(df).collect()] == [1]
    assert len(basket.basket_combos(df).first().product_cate_combo) == 3 * 1_000_000 - 2


def test_products_in_combo_counts_each_item(make_sales):
    """A basket fits by how often it holds each item; with ``distinct`` by which items it holds; lines without an item do not count."""
    at = "2023-01-02"
    df = make_sales([line(1, at, "07:00:00", 1, 3, "2.00", "A", detail="x"), line(2, at, "07:00:00", 1, 3, "1.00", "B", detail="y"),
                     line(3, at, "08:00:00", 1, 3, "2.00", "A", detail="x"), line(4, at, "08:00:00", 1, 3, "2.00", "A", detail="z"),
                     line(5, at, "08:00:00", 1, 3, "1.00", "B", detail="y"),
                     line(6, at, "09:00:00", 1, 3, "1.00", "B", detail="w"), line(7, at, "09:00:00", 1, 3, "1.00", "A", detail="w"),
                     line(8, at, "09:00:00", 1, 3, "1.00", None, detail="w"),
                     line(9, at, "10:00:00", 1, 3, "1.00", "A", detail="v"), line(10, at, "10:00:00", 1, 3, "1.00", "B", detail="v"),
                     line(11, at, "10:00:00", 1, 3, "1.00", "C", detail="v")])

    def products(*combo, **kw):
        return {r.product_detail for r in basket.products_in_combo(df, list(combo), **kw).collect()}

    assert products("A", "B") == {"x", "y", "w"}
    assert products("B", "A", "A") == {"x", "y", "z"}
    assert products("A", "B", distinct=True) == {"x", "y", "z", "w"}
    assert products("A") == set()
    assert products("A", "C") == set()


def test_products_in_combo(make_sales):
    df = _baskets(make_sales)
    out = sorted((r.product_category, r.product_detail, r.total_transactions, r.rank_by_revenue)
                 for r in basket.products_in_combo(df, "A, B").collect())
    assert out == [("A", "P", 2, 1), ("B", "P", 3, 1)]


def _price_days(make_sales):
    rows, tid = [], 0

    def add(date, qty, price, product="Cookie"):
        nonlocal tid
        tid += 1
        rows.append(line(tid, date, "08:00:00", qty, 3, price, "Bakery", "Cookie", product))

    add("2023-01-09", 5, "3.50"); add("2023-01-09", 3, "4.38")     # -2.2386
    add("2023-02-09", 11, "3.50"); add("2023-02-09", 1, "4.38")    # -7.4621
    add("2023-03-01", 8, "3.50")                                    # one price: no pair
    add("2023-03-09", 4, "3.00"); add("2023-03-09", 2, "3.50"); add("2023-03-09", 1, "4.38")  # three prices
    return make_sales(rows)


def test_within_day_elasticity_literal_and_minmax(make_sales):
    df = _price_days(make_sales)
    lit = {str(r.transaction_date): r.price_elasticity
           for r in pricing.within_day_elasticity(df, base_price="3.50", hike_price="4.38").collect()}
    assert lit == {"2023-01-09": Decimal("-2.2386"), "2023-02-09": Decimal("-7.4621"),
                   "2023-03-09": (Decimal(-1) / 3 / (Decimal("0.88") / Decimal("7.88")))
                                 .quantize(Decimal("0.0001"), rounding="ROUND_HALF_UP")}
    mm = {str(r.transaction_date): (r.p_base, r.p_hike)
          for r in pricing.within_day_elasticity(df).collect()}
    assert mm["2023-03-09"] == (Decimal("3.00"), Decimal("4.38"))   # middle price ignored
    assert "2023-03-01" not in mm


def test_whatif_nine_two_price_days_gives_252(make_sales):
    rows, tid = [], 0
    for d in range(1, 10):  # 9 two-price days, 8 units at base each
        for qty, price in ((8, "3.50"), (2, "4.38")):
            tid += 1
            rows.append(line(tid, f"2023-01-{d:02d}", "08:00:00", qty, 3, price, "Bakery", "B", "Cookie"))
    for d, q in ((10, 8), (11, 5), (12, 5)):  # base-price-only days: mode tie 8 vs 5 at 2 each? 8 wins
        tid += 1
        rows.append(line(tid, f"2023-01-{d:02d}", "08:00:00", q, 3, "3.50", "Bakery", "B", "Cookie"))
    df = make_sales(rows)
    r = pricing.price_hold_whatif(df, base_price="3.50").first()
    assert r.revenue_with_mode == Decimal("252.00")            # 8 × 3.50 × 9
    assert r.total_original_revenue == Decimal("330.84")       # 9 × (28.00 + 8.76)
    mean = Decimal(8 * 10 + 5 + 5) / 12
    assert r.revenue_with_avg == (mean * Decimal("3.50") * 9).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
    mode = pricing.daily_units_mode(df, base_price="3.50").first()
    assert (mode.total_qty, mode.frequency) == (8, 10)


def test_mode_tie_takes_smaller_value(make_sales):
    rows = [line(i, f"2023-01-{i:02d}", "08:00:00", q, 3, "3.50", "Bakery", "B", "Cookie")
            for i, q in enumerate([7, 7, 4, 4, 9], start=1)]
    mode = pricing.daily_units_mode(make_sales(rows), base_price="3.50").first()
    assert (mode.total_qty, mode.frequency) == (4, 2)


def test_price_list_sorts_numerically(make_sales):
    rows = [line(1, "2023-01-01", "08:00:00", 1, 3, "10.00", "Bakery", "Scone", "Ginger Scone"),
            line(2, "2023-01-02", "08:00:00", 1, 3, "9.50", "Bakery", "Scone", "Ginger Scone"),
            line(3, "2023-01-03", "08:00:00", 2, 3, "9.50", "Bakery", "Scone", "Ginger Scone"),
            line(4, "2023-01-03", "08:00:00", 1, 3, "3.00", "Bakery", "Scone", "Plain Scone ")]
    out = [tuple(r) for r in pricing.price_list(make_sales(rows)).collect()]
    assert out == [("Bakery", "Scone", "Ginger Scone", "9.50, 10.00", Decimal("38.50"))]


def test_price_change_dates_calendar_and_revenue(make_sales):
    df = _price_days(make_sales)
    dates = sorted(str(r.transaction_date) for r in pricing.price_change_dates(df).collect())
    assert dates == ["2023-01-09", "2023-02-09", "2023-03-09"]
    cal = [tuple(r) for r in pricing.price_change_calendar(df).collect()]
    assert cal == [(9, 3, 1, 0)]
    rev = pricing.two_price_day_revenue(df).where("transaction_date = '2023-01-09'").collect()
    assert sorted((r.unit_price, r.total_qty, r.revenue) for r in rev) == [
        (Decimal("3.50"), 5, Decimal("17.50")), (Decimal("4.38"), 3, Decimal("13.14"))]
    multi = [tuple(r) for r in pricing.multi_price_products(df).collect()]
    assert multi == [("Cookie", 3)]   # 3.00, 3.50, 4.38


@pytest.mark.parametrize("lines", [1, 2, 3, 7, 1000])
def test_segments_in_order_are_the_content(make_sales, lines):
    rng = random.Random(lines)
    rows = [line(k, "2023-01-02", f"0{rng.randrange(1, 8)}:00:00", 1, 3, "2.00", rng.choice(["A, B", "C", "Tea", "", None]))
            for k in range(60)]
    df = make_sales(rows + [line(99, "2023-01-02", "09:00:00", 1, 3, "2.00", "C")])
    texts = {}
    for r in basket.basket_segments(df, lines=lines).collect():
        texts.setdefault(r.transaction, []).append((r.segment, r.product_cate_combo))
    assert all([s for s, _ in t] == list(range(len(t))) for t in texts.values())
    assert {k: "".join(x for _, x in t) for k, t in texts.items()} == {
        r.transaction: r.product_cate_combo for r in basket.basket_combos(df).collect()}


def test_a_basket_of_many_lines_is_cut_into_bounded_pieces(spark):
    """Three million lines of two items in one basket; no piece is longer than its lines."""
    df = spark.range(3_000_000).select(F.lit("b").alias("transaction"), F.lit(1).alias("revenue"),
                                       F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("product_category"))
    out = basket.basket_segments(df, lines=400_000).collect()
    assert [r.segment for r in out] == list(range(8))
    assert max(len(r.product_cate_combo) for r in out) <= 3 * 400_000
    assert "".join(r.product_cate_combo for r in out) == ", ".join("A" * 1_000_000 + "B" * 2_000_000)
