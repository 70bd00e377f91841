"""Every report over one sales table shaped like the study's, with the
study's literals (``study_reports``), and reading such a table from CSV."""

import tempfile
from decimal import Decimal

from tillroll.plans.params import STUDY
from tillroll.plans.reports import STATEMENTS, study_reports
from tillroll.sources.sales import read_sales
from tests.conftest import line

FOCUS = STUDY.price_products[0]


def _study_rows():
    rows, tid = [], 0

    def add(date, time, qty, store, price, category, ptype, detail):
        nonlocal tid
        tid += 1
        rows.append(line(tid, date, time, qty, store, price, category, ptype, detail,
                         location=f"store {store}"))

    # the price study's product: base and raised price on the 9th of two months
    add("2023-01-09", "08:00:00", 5, 3, "3.50", "Bakery", "Biscotti", FOCUS)
    add("2023-01-09", "15:00:00", 3, 3, "4.38", "Bakery", "Biscotti", FOCUS)
    add("2023-02-09", "09:00:00", 11, 5, "3.50", "Bakery", "Biscotti", FOCUS)
    add("2023-02-09", "16:00:00", 1, 5, "4.38", "Bakery", "Biscotti", FOCUS)
    add("2023-03-02", "10:00:00", 8, 3, "3.50", "Bakery", "Biscotti", FOCUS)
    # baskets: coffee + flavours, coffee + bakery, tea alone
    add("2023-01-10", "07:30:00", 1, 3, "3.00", "Coffee", "Barista Espresso", "Latte Rg")
    add("2023-01-10", "07:30:00", 1, 3, "0.80", "Flavours", "Regular syrup", "Hazelnut syrup")
    add("2023-04-11", "08:15:00", 2, 5, "3.00", "Coffee", "Barista Espresso", "Latte Rg")
    add("2023-04-11", "08:15:00", 1, 5, "3.75", "Bakery", "Pastry", "Croissant")
    add("2023-06-30", "19:00:00", 1, 5, "2.50", "Tea", "Brewed Chai tea", "Spicy Eye Opener Chai Lg")
    add("2023-05-05", "11:00:00", 1, 3, "18.00", "Branded", "Clothing", "I Need My Bean! T-shirt")
    add("2023-05-06", "12:00:00", 1, 3, "21.00", "Coffee beans", "Premium Beans", "Civet Cat")
    return rows


def test_every_report_runs_on_a_study_shaped_table(make_sales):
    df = make_sales(_study_rows(), enrich=False)
    reports = study_reports(df)
    assert set(STATEMENTS) - {"products_in_category"} <= set(reports)
    assert {f"products_in_category[{c}]" for c in STUDY.one_categories} <= set(reports)
    counts = {name: out.count() for name, out in reports.items()}
    assert counts["row_count"] == 1 and counts["distinct_stores"] == 2

    e = {str(r.transaction_date): r.price_elasticity for r in reports["within_day_elasticity"].collect()}
    assert e == {"2023-01-09": Decimal("-2.2386"), "2023-02-09": Decimal("-7.4621")}
    growth = [(r.month, r.mom_revenue_growth) for r in reports["store_mom_growth"].collect()
              if r.store_id == 3]
    assert [m for m, _ in growth] == ["January", "March", "May"]
    combos = {r.product_cate_combo for r in reports["combo_summary"].collect()}
    assert combos == {"Coffee, Flavours", "Bakery, Coffee"}
    assert [r.product_detail for r in reports["products_in_combo"].collect()] in (
        ["Latte Rg", "Hazelnut syrup"], ["Hazelnut syrup", "Latte Rg"])
    whatif = reports["price_hold_whatif"].first()
    # base-price days sold 5, 11 and 8 units: the mode tie takes 5, the mean is 8; 2 change days
    assert (whatif.total_original_revenue, whatif.revenue_with_mode, whatif.revenue_with_avg) == \
        (Decimal("73.52"), Decimal("35.00"), Decimal("56.00"))
    groups = {r.category for r in reports["category_group"].collect()}
    assert groups == {"Beverages", "Snacks", "Merchandise"}


def test_read_sales_from_csv(spark, make_sales):
    df = make_sales(_study_rows(), enrich=False)
    path = tempfile.mkdtemp(prefix="tillroll-study-") + "/sales"
    df.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = read_sales(spark, path, fmt="csv")
    assert {"revenue", "transaction"} <= set(back.columns)
    assert back.count() == len(_study_rows())
    key = back.where("transaction_id = 1").first().transaction
    assert key == "2023-01-09 08:00:00 3"


def test_command_line_run_writes_every_report(spark, make_sales):
    from tillroll.__main__ import folder_name, run
    from tillroll.sources.sinks import read_report

    df = make_sales(_study_rows(), enrich=False)
    base = tempfile.mkdtemp(prefix="tillroll-cli-")
    df.write.option("header", True).csv(f"{base}/sales")
    written = run(spark, f"{base}/sales", f"{base}/out", fmt="csv",
                  only=["store_summary", "within_day_elasticity", "products_in_category[Bakery]"])
    assert sorted(written) == ["products_in_category[Bakery]", "store_summary", "within_day_elasticity"]
    back = read_report(spark, f"{base}/out/{folder_name('within_day_elasticity')}",
                       "transaction_date date, product_detail string, change_type string, p_base double, "
                       "q_base long, p_hike double, q_hike long, price_elasticity double")
    assert sorted(r.price_elasticity for r in back.collect()) == [-7.4621, -2.2386]


def test_read_sales_parquet_and_prepare_is_idempotent(spark, make_sales):
    from decimal import Decimal as D

    from tillroll.sources.sales import prepare_sales
    from tillroll.sources.sinks import write_report

    df = make_sales(_study_rows(), enrich=False)
    base = tempfile.mkdtemp(prefix="tillroll-pq-")
    df.write.parquet(f"{base}/sales")
    once = read_sales(spark, f"{base}/sales")
    twice = prepare_sales(once)
    assert once.columns == twice.columns and once.exceptAll(twice).count() == 0
    assert once.where("transaction_id = 1").first().revenue == D("17.50")
    write_report(once.select("transaction_id", "revenue"), f"{base}/out", fmt="parquet")
    back = spark.read.parquet(f"{base}/out")
    assert dict(back.dtypes)["revenue"].startswith("decimal") and back.count() == once.count()
