import datetime as dt
from decimal import Decimal

from tillroll.operators import enrich, quality
from tests.conftest import line

TINY = [
    line(1, "2023-01-02", "07:10:00", 2, 3, "3.00", "Coffee", "Latte", "Latte Rg"),
    line(2, "2023-01-02", "07:10:00", 1, 3, "3.75", "Bakery", "Pastry", "Croissant"),
    line(3, "2023-01-02", "07:10:00", 1, 3, "2.50", "Tea", "Brewed", "Earl Grey"),
    line(4, "2023-01-02", "08:00:00", 1, 5, "3.00", "Coffee", "Latte", "Latte Rg"),
    line(5, "2023-01-02", "08:00:00", 0, 5, "3.75", "Bakery", "Pastry", "Croissant"),   # qty 0
    line(6, "2023-02-03", "09:30:00", 2, 5, None, "Coffee", "Latte", "Latte Rg"),       # NULL price
    line(6, "2023-02-03", "09:30:00", 1, 5, "2.50", "Tea", "Brewed", "Earl Grey"),      # repeated id
    line(7, "2023-03-04", "10:00:00", 3, 3, "3.00", "Coffee", "Latte", "Latte Rg"),
    line(8, "2023-03-04", "11:00:00", 1, 3, "-1.00", "Branded", "Mug", "Mug"),          # negative price
    line(9, "2023-06-30", "19:59:59", 1, 5, "3.00", "Coffee", "Latte", "Latte Rg"),
]


def test_quality_checks(make_sales):
    df = make_sales(TINY)
    assert quality.row_count(df).first()["count"] == 10
    assert [tuple(r) for r in quality.duplicate_keys(df).collect()] == [(6, 2)]
    assert sorted(r.transaction_id for r in quality.null_rows(df).collect()) == [6]
    # NULL price is not an outlier; zero qty and negative price are
    assert sorted(r.transaction_id for r in quality.nonpositive_rows(df).collect()) == [5, 8]
    assert tuple(quality.date_range(df).first()) == (dt.date(2023, 1, 2), dt.date(2023, 6, 30))
    stores = sorted(tuple(r) for r in quality.distinct_values(df).collect())
    assert stores == [(3, "store3"), (5, "store5")]
    coll = [tuple(r) for r in quality.basket_collisions(df).collect()]
    assert coll == [(dt.date(2023, 1, 2), "07:10:00", 3, 3), (dt.date(2023, 1, 2), "08:00:00", 5, 2),
                    (dt.date(2023, 2, 3), "09:30:00", 5, 2)]


def test_preview_is_ordered_and_limited(make_sales):
    df = make_sales(TINY)
    ids = [r.transaction_id for r in quality.preview_rows(df, 3).collect()]
    assert ids == [1, 2, 3]


def test_enrichment_columns(make_sales):
    df = make_sales(TINY, enrich=False)
    out = enrich.with_time_parts(df)
    first = out.where("transaction_id = 1").first()
    assert (first.month, first.day_of_week, first.hour) == (1, 1, 7)
    named = enrich.with_time_names(df).where("transaction_id = 9").first()
    assert (named.month, named.day_of_week, named.hour) == ("June", "Friday", 19)
    rev = enrich.with_revenue(df).where("transaction_id = 1").first().revenue
    assert rev == Decimal("6.00")
    key = enrich.with_basket_key(df, ["transaction_date", "transaction_time", "store_id"])
    assert key.where("transaction_id = 1").first().transaction == "2023-01-02 07:10:00 3"
    q = enrich.with_quarter(df).where("transaction_id = 9").first().quarter
    assert q == "Q2"
    g = enrich.with_group(df).where("transaction_id = 8").first().category
    assert g == "Merchandise"


def test_basket_key_null_part_gives_null(spark, make_sales):
    rows = [line(1, "2023-01-02", None, 1, 3, "3.00", "Coffee")]
    df = enrich.with_basket_key(make_sales(rows, enrich=False),
                                ["transaction_date", "transaction_time", "store_id"])
    assert df.first().transaction is None


def test_null_revenue_from_null_price(make_sales):
    df = make_sales(TINY)
    assert df.where("transaction_id = 6 and unit_price is null").first().revenue is None
