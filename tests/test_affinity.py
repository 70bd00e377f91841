"""Pairs of items bought together, against counting by hand."""

import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest

from tests.conftest import line
from tillroll.operators.affinity import item_affinity


def plain(baskets):
    single = Counter(i for b in baskets for i in b)
    both = Counter(p for b in baskets for p in permutations(b, 2))
    n = len(baskets)
    return {(a, b): (c, single[a], Fraction(c, n), Fraction(c, single[a]), Fraction(c * n, single[a] * single[b]))
            for (a, b), c in both.items()}


def check(rows, want):
    assert {(r.product_category, r.with_product_category) for r in rows} == set(want)
    for r in rows:
        both, first, *ratios = want[r.product_category, r.with_product_category]
        assert (r.baskets, r.item_baskets) == (both, first)
        for got, exact in zip((r.support, r.confidence, r.lift), ratios, strict=True):
            assert abs(Fraction(got) - exact) <= Fraction(1, 20000)


def test_affinity_equals_counting(make_sales):
    rng = random.Random(4)
    rows, baskets = [], {}
    for k in range(400):
        at, item = f"{7 + rng.randrange(12):02d}:{rng.randrange(6)}0:00", rng.choice(["Tea", "Coffee", "Beans", "Beans, dark", "", None])
        rows.append(line(k, "2023-01-02", at, 1, 3, "2.00", item))
        if item is not None:
            baskets.setdefault(at, set()).add(item)
    out = item_affinity(make_sales(rows)).collect()
    check(out, plain(list(baskets.values())))
    assert [(-r.lift, -r.baskets) for r in out] == sorted((-r.lift, -r.baskets) for r in out)


def test_affinity_keeps_pairs_of_enough_baskets(make_sales):
    rows = [line(1, "2023-01-02", "07:00:00", 1, 3, "2.00", "A"), line(2, "2023-01-02", "07:00:00", 1, 3, "2.00", "B"),
            line(3, "2023-01-02", "08:00:00", 1, 3, "2.00", "A"), line(4, "2023-01-02", "08:00:00", 1, 3, "2.00", "B"),
            line(5, "2023-01-02", "08:00:00", 1, 3, "2.00", "C")]
    out = item_affinity(make_sales(rows), min_baskets=2).collect()
    assert {(r.product_category, r.with_product_category) for r in out} == {("A", "B"), ("B", "A")}
    assert item_affinity(make_sales([])).collect() == []


def test_affinity_of_a_hot_basket_is_one_row_per_item(spark, make_sales):
    """A basket of 20,000 lines: its pairs are those of its items, not of its lines."""
    rows = [line(k, "2023-01-02", "07:00:00", 1, 3, "2.00", "ABC"[k % 3]) for k in range(20_000)]
    rows += [line(0, "2023-01-03", "07:00:00", 1, 3, "2.00", x) for x in "AD"]
    check(item_affinity(make_sales(rows)).collect(), plain([set("ABC"), set("AD")]))


@pytest.mark.parametrize("units, median", [([1, 5, 9], 5), ([1, 4], 2.5), ([2, 2, 7, 9], 4.5)])
def test_whatif_with_the_median(make_sales, units, median):
    from tillroll.operators.pricing import price_hold_whatif

    rows = [line(k, f"2023-01-{k + 2:02d}", "07:00:00", n, 3, "3.50", "Tea") for k, n in enumerate(units)]
    rows += [line(90, "2023-01-02", "08:00:00", 2, 3, "4.38", "Tea"), line(91, "2023-01-03", "08:00:00", 3, 3, "4.38", "Tea")]
    out = price_hold_whatif(make_sales(rows), base_price="3.50", stats=("mode", "avg", "median")).first()
    assert float(out.revenue_with_median) == median * 3.5 * 2
    assert float(out.total_original_revenue) == (units[0] + units[1]) * 3.5 + 5 * 4.38
    assert out.asDict().keys() >= {"revenue_with_mode", "revenue_with_avg"}
