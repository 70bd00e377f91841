"""Five hand-made lines through ``study_reports``, with results worked out by hand."""

from decimal import Decimal

import pytest

from tests.conftest import line
from tillroll.plans import study_reports

D = Decimal


@pytest.fixture(scope="module")
def reports(spark):
    from tests.conftest import SALES_SCHEMA

    rows = [
        line(1, "2023-01-02", "07:10:00", 2, 3, "3.00", "Coffee", "Gourmet brewed coffee", "Ethiopia Rg", "Astoria"),
        line(2, "2023-01-02", "07:10:00", 1, 3, "3.00", "Bakery", "Scone", "Oatmeal Scone", "Astoria"),
        line(3, "2023-02-05", "08:00:00", 2, 3, "3.50", "Coffee", "Gourmet brewed coffee", "Ethiopia Lg", "Astoria"),
        line(4, "2023-02-05", "08:00:00", 3, 5, "3.00", "Bakery", "Scone", "Oatmeal Scone", "Lower Manhattan"),
        line(5, "2023-04-03", "07:30:00", 1, 3, "12.00", "Branded", "Housewares", "Mug", "Astoria"),
    ]
    return study_reports(spark.createDataFrame(rows, SALES_SCHEMA))


EXPECTED = {
    "row_count": [(5,)],
    "store_summary": [(3, "Astoria", D("28.00"), 6, D("9.333")), (5, "Lower Manhattan", D("9.00"), 3, D("9.000"))],
    "basket_size_by_store": [(3, "Astoria", D("2.000")), (5, "Lower Manhattan", D("3.000"))],
    "hourly_traffic": [("January", "Monday", 7, "Astoria", 3, D("9.00")),
                       ("February", "Sunday", 8, "Astoria", 2, D("7.00")),
                       ("February", "Sunday", 8, "Lower Manhattan", 3, D("9.00")),
                       ("April", "Monday", 7, "Astoria", 1, D("12.00"))],
    "basket_size_by_dow_hour": [("Monday", 7, D("2.000")), ("Sunday", 8, D("2.500"))],
    "basket_size_by_hour": [(7, D("2.000")), (8, D("2.500"))],
    "store_mom_growth": [(3, "Astoria", "January", D("9.00"), None, None),
                         (3, "Astoria", "February", D("7.00"), D("9.00"), D("-0.222")),
                         (3, "Astoria", "April", D("12.00"), D("7.00"), D("0.714")),
                         (5, "Lower Manhattan", "February", D("9.00"), None, None)],
    "store_qoq_growth": [(3, "Astoria", "Q1", D("16.00"), None, None),
                         (3, "Astoria", "Q2", D("12.00"), D("16.00"), D("-0.250")),
                         (5, "Lower Manhattan", "Q1", D("9.00"), None, None)],
    "product_rank_in_category": [(1, "Ethiopia Lg", "Coffee", 1, D("7.00")), (1, "Mug", "Branded", 1, D("12.00")),
                                 (1, "Oatmeal Scone", "Bakery", 2, D("12.00")),
                                 (2, "Ethiopia Rg", "Coffee", 1, D("6.00"))],
    "basket_combos": [("2023-01-02 07:10:00 3", 3, "Astoria", "Bakery, Coffee", D("9.00"))],
    "top_combos": [("Bakery, Coffee", 1, D("9.00"), D("9.00"))],
    "products_in_category[Bakery]": [("Oatmeal Scone", "Scone", 4, D("12.00"), D("3.000"))],
    "products_of_top_types": [("Ethiopia Lg", "Gourmet brewed coffee", 2, D("7.00")),
                              ("Ethiopia Rg", "Gourmet brewed coffee", 2, D("6.00"))],
}
# Reports whose rows come in a stated order without ties.
IN_ORDER = {"store_summary", "basket_size_by_dow_hour", "store_mom_growth", "store_qoq_growth", "products_of_top_types"}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_results_worked_out_by_hand(reports, name):
    rows = [tuple(r) for r in reports[name].collect()]
    if name not in IN_ORDER:
        rows, want = sorted(rows, key=str), sorted(EXPECTED[name], key=str)
    else:
        want = EXPECTED[name]
    assert rows == want


def test_category_summary_by_hand(reports):
    rows = [tuple(r) for r in reports["category_summary"].collect()]
    assert rows[0] == ("Coffee", 1, 2, 4, D("13.00"), D("3.250"))
    assert sorted(rows[1:]) == [("Bakery", 1, 1, 4, D("12.00"), D("3.000")), ("Branded", 1, 1, 1, D("12.00"), D("12.000"))]
