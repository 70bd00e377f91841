import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.functions import calendar as cal
from tillroll.functions.elasticity import arc_elasticity
from tillroll.functions.groups import CAFE_GROUPS, group_of
from tillroll.functions.money import exact, ratio


def test_day_of_week_sunday_is_zero(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2023, 1, 2),), (dt.date(2023, 1, 7),)], "d date")
    got = [tuple(r) for r in df.select(cal.day_of_week("d"), cal.day_name("d")).collect()]
    assert got == [(0, "Sunday"), (1, "Monday"), (6, "Saturday")]


def test_month_names_full_and_short_list(spark):
    df = spark.createDataFrame([(dt.date(2023, m, 1),) for m in (1, 6, 7, 12)], "d date")
    full = [r[0] for r in df.select(cal.month_name("d")).collect()]
    assert full == ["January", "June", "July", "December"]
    # a six-name list behaves like the study's CASE without ELSE
    half = [r[0] for r in df.select(cal.month_name("d", cal.MONTH_NAMES[:6])).collect()]
    assert half == ["January", "June", None, None]


def test_weekday_sort_key_case_blind_and_unknown(spark):
    df = spark.createDataFrame([("MONDAY",), ("sunday",), ("Funday",), (None,)], "n string")
    assert [r[0] for r in df.select(cal.weekday_sort_key("n")).collect()] == [1, 7, 8, 8]


def test_quarter_and_period_labels(spark):
    df = spark.createDataFrame([(dt.date(2023, 2, 10),), (dt.date(2024, 11, 30),)], "d date")
    rows = df.select(cal.quarter_label("d"), cal.year_quarter("d"), cal.year_month("d"),
                     cal.period_label("month", cal.period_key("month", "d")),
                     cal.period_label("month_name", cal.period_key("month_name", "d"))).collect()
    assert [tuple(r) for r in rows] == [("Q1", "2023-Q1", "2023-02", "2023-02", "February"),
                                        ("Q4", "2024-Q4", "2024-11", "2024-11", "November")]


def test_hour_from_text_and_timestamp(spark):
    df = spark.createDataFrame([("07:45:10", dt.datetime(2024, 1, 1, 20, 5))], "t string, ts timestamp")
    assert tuple(df.select(cal.hour_of_text("t"), cal.hour_of("ts")).first()) == (7, 20)


def test_group_else_catches_null_and_unknown(spark):
    df = spark.createDataFrame([("Coffee",), ("Bakery",), ("Branded",), (None,), ("Nope",)], "c string")
    got = [r[0] for r in df.select(group_of("c", CAFE_GROUPS, "Merchandise")).collect()]
    assert got == ["Beverages", "Snacks", "Merchandise", "Merchandise", "Merchandise"]
    no_else = [r[0] for r in df.select(group_of("c", CAFE_GROUPS, None)).collect()]
    assert no_else == ["Beverages", "Snacks", None, None, None]


def test_ratio_rounds_half_away_from_zero_and_guards_zero(spark):
    df = spark.createDataFrame([(Decimal("0.25"), 1), (Decimal("-0.25"), 1), (Decimal("1.00"), 0)],
                               "a decimal(12,2), b long")
    got = [r[0] for r in df.select(ratio("a", exact("b"), 1)).collect()]
    assert got == [Decimal("0.3"), Decimal("-0.3"), None]


def test_arc_elasticity_study_extremes(spark):
    df = spark.createDataFrame([(5, 3), (11, 1), (4, 4)], "qb int, qh int").withColumns(
        {"pb": F.lit(Decimal("3.50")).cast("decimal(10,2)"), "ph": F.lit(Decimal("4.38")).cast("decimal(10,2)")})
    got = [r[0] for r in df.select(arc_elasticity("qb", "qh", "pb", "ph")).collect()]
    assert got == [Decimal("-2.2386"), Decimal("-7.4621"), Decimal("0.0000")]


def test_arc_elasticity_equals_guarded_midpoint_formula(spark):
    rows = [(qb, qh) for qb in range(1, 12) for qh in range(1, 12)]
    df = spark.createDataFrame(rows, "qb int, qh int").withColumns(
        {"pb": F.lit(Decimal("3.50")).cast("decimal(10,2)"), "ph": F.lit(Decimal("4.38")).cast("decimal(10,2)")})
    out = df.select("qb", "qh", arc_elasticity("qb", "qh", "pb", "ph").alias("e")).collect()
    for r in out:
        q = (Decimal(r.qh - r.qb) / (Decimal(r.qb + r.qh) / 2)) / (Decimal("0.88") / (Decimal("7.88") / 2))
        assert r.e == q.quantize(Decimal("0.0001"), rounding="ROUND_HALF_UP"), (r, q)
