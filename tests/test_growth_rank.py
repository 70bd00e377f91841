import random
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.operators.growth import period_growth
from tillroll.operators.ranking import rank_within
from tests.conftest import line


def test_growth_skips_missing_month_and_guards_zero(make_sales):
    rows = [
        line(1, "2023-01-10", "08:00:00", 1, 3, "10.00", "Coffee"),
        line(2, "2023-02-10", "08:00:00", 1, 3, "0.00", "Coffee"),    # zero revenue month
        line(3, "2023-04-10", "08:00:00", 1, 3, "5.00", "Coffee"),    # March missing
        line(4, "2023-04-11", "08:00:00", 1, 3, "7.50", "Coffee"),
    ]
    out = period_growth(make_sales(rows), ["store_id", "store_location"], "month_name").collect()
    got = [(r.month, r.total_revenue, r.prev_month_revenue, r.mom_revenue_growth) for r in out]
    assert got == [
        ("January", Decimal("10.00"), None, None),
        ("February", Decimal("0.00"), Decimal("10.00"), Decimal("-1.000")),
        ("April", Decimal("12.50"), Decimal("0.00"), None),          # previous row, zero guard
    ]


def test_growth_is_year_aware(make_sales):
    rows = [line(1, "2022-12-05", "08:00:00", 1, 3, "4.00", "Coffee"),
            line(2, "2023-01-05", "08:00:00", 1, 3, "5.00", "Coffee")]
    out = period_growth(make_sales(rows), ["store_id", "store_location"], "month").collect()
    assert [(r.month, r.mom_revenue_growth) for r in out] == [("2022-12", None), ("2023-01", Decimal("0.250"))]
    q = period_growth(make_sales(rows), ["store_id", "store_location"], "quarter").collect()
    assert [(r.quarter, r.qtr_revenue_growth) for r in q] == [("2022-Q4", None), ("2023-Q1", Decimal("0.250"))]


def _rank_ties_df(spark):
    return spark.createDataFrame(
        [("c", "a", 10), ("c", "b", 8), ("c", "d", 8), ("c", "e", 1), ("k", "x", 3)],
        "cat string, item string, v int")


def test_rank_ties_share_and_leave_gap(spark):
    for method in ("window", "range"):
        out = rank_within(_rank_ties_df(spark), ["cat"], [F.col("v").desc()], method=method, slices=3)
        got = sorted((r.cat, r.item, r["rank"]) for r in out.collect())
        assert got == [("c", "a", 1), ("c", "b", 2), ("c", "d", 2), ("c", "e", 4), ("k", "x", 1)], method


def test_top_n_keeps_ties(spark):
    out = rank_within(_rank_ties_df(spark), ["cat"], [F.col("v").desc()], top=2)
    assert sorted(r.item for r in out.collect()) == ["a", "b", "d", "x"]


def test_range_rank_equals_window_rank_on_skewed_random_data(spark):
    rnd = random.Random(7)
    # one partition value holds most rows; many ties; NULL keys on both sides
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]),
             rnd.choice([None] + list(range(40))), rnd.randint(0, 3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "cat string, v int, w int")
    order = [F.col("v").desc_nulls_first(), F.col("w").desc_nulls_first()]
    a = rank_within(df, ["cat"], order, method="window")
    for slices in (1, 5, 16):
        b = rank_within(df, ["cat"], order, method="range", slices=slices)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, slices


def test_rank_equals_one_plus_count_of_greater(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xyz"), rnd.randint(0, 20)) for _ in range(200)]
    df = spark.createDataFrame(rows, "cat string, v int")
    ranked = rank_within(df, ["cat"], [F.col("v").desc()], method="range", slices=4).collect()
    for r in ranked:
        assert r["rank"] == 1 + sum(1 for c, v in rows if c == r.cat and v > r.v)
