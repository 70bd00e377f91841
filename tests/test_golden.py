"""Checks derived from the study's exported results (read in place).

The raw sales table is not available, so each test rebuilds the smallest
input that the exported numbers determine and checks that the operators
reproduce the exported columns.
"""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.functions.calendar import MONTH_NAMES
from tillroll.functions.groups import CAFE_GROUPS
from tillroll.functions.money import exact, ratio
from tillroll.operators.enrich import with_group
from tillroll.operators.growth import period_growth
from tillroll.operators.ranking import rank_within
from tillroll.operators.summary import summarize
from tests.conftest import GOLDEN_ROOT, golden_tables, line, read_golden

# Headers of the exported tables (the reports' own column names).
MONTHLY = ("store_id", "store_location", "month", "total_revenue", "prev_month_revenue",
           "mom_revenue_growth")
QUARTERLY = ("store_id", "store_location", "quarter", "total_revenue", "prev_quarter_revenue",
             "qtr_revenue_growth")
CATEGORY_RANK = ("rank_by_revenue", "product_detail", "product_category", "total_transactions",
                 "total_revenue")
GROUP_RANK = ("rank_by_revenue", "category", "product_detail", "total_transactions", "total_revenue",
              "avg_transaction_value")
TYPES_BY_CATEGORY = ("product_type", "product_category", "total_products", "total_transactions",
                     "total_revenue", "avg_transaction_value")
PRODUCTS = ("product_detail", "product_type", "total_transactions", "total_revenue",
            "avg_transaction_value")
STORES = ("store_id", "store_location", "total_revenue", "total_transactions", "avg_transaction_value")
COMBOS = ("product_cate_combo", "combo_transaction", "total_revenue", "avg_transaction_value")
PRICE_LIST = ("product_category", "product_type", "product_detail", "price_range", "total_revenue")


def _dec(v):
    return None if v is None else Decimal(v)


def test_month_and_quarter_growth(make_sales):
    months = read_golden(*MONTHLY)
    rows = [line(i, f"2023-{MONTH_NAMES.index(r['month']) + 1:02d}-01", "08:00:00", 1,
                 int(r["store_id"]), r["total_revenue"], "Coffee", location=r["store_location"])
            for i, r in enumerate(months)]
    df = make_sales(rows)
    got = {(r.store_id, r.month): (r.total_revenue, r.prev_month_revenue, r.mom_revenue_growth)
           for r in period_growth(df, ["store_id", "store_location"], "month_name").collect()}
    for r in months:
        want = (_dec(r["total_revenue"]), _dec(r["prev_month_revenue"]), _dec(r["mom_revenue_growth"]))
        assert got[(int(r["store_id"]), r["month"])] == want, r

    quarters = read_golden(*QUARTERLY)
    got_q = {(r.store_id, r.quarter): (r.total_revenue, r.prev_quarter_revenue, r.qtr_revenue_growth)
             for r in period_growth(df, ["store_id", "store_location"], "quarter_label").collect()}
    for r in quarters:
        want = (_dec(r["total_revenue"]), _dec(r["prev_quarter_revenue"]), _dec(r["qtr_revenue_growth"]))
        assert got_q[(int(r["store_id"]), r["quarter"])] == want, r


def _ranking_input(spark):
    rows = read_golden(*CATEGORY_RANK)
    data = [(r["product_category"], r["product_detail"], int(r["total_transactions"]),
             Decimal(r["total_revenue"]), int(r["rank_by_revenue"])) for r in rows]
    return spark.createDataFrame(
        data, "product_category string, product_detail string, lines long, "
              "total_revenue decimal(22,2), expected long")


def test_product_rank_in_category_with_ties(spark):
    df = _ranking_input(spark)
    order = [F.col("total_revenue").desc_nulls_first(), F.col("lines").desc_nulls_first()]
    for method in ("window", "range"):
        out = rank_within(df, ["product_category"], order, name="rank_by_revenue", method=method, slices=5)
        bad = out.where(F.col("rank_by_revenue") != F.col("expected")).count()
        assert bad == 0, method
    assert df.count() == 80


def test_product_rank_in_group_from_category_rows(spark):
    expected = {r["product_detail"]: (r["category"], int(r["rank_by_revenue"]), Decimal(r["total_revenue"]))
                for r in read_golden(*GROUP_RANK)}
    df = with_group(_ranking_input(spark), "product_category", CAFE_GROUPS, "Merchandise")
    per = df.groupBy("category", "product_detail").agg(F.sum("total_revenue").alias("total_revenue"))
    out = rank_within(per, ["category"], [F.col("total_revenue").desc_nulls_first()],
                      name="rank_by_revenue", method="range", slices=4)
    got = {r.product_detail: (r.category, r.rank_by_revenue, r.total_revenue) for r in out.collect()}
    assert got == expected


def test_types_by_category_from_product_rows(make_sales):
    """The category × type table equals the roll-up of the per-product
    tables of those types (one line per product carrying its units and
    revenue)."""
    expected = read_golden(*TYPES_BY_CATEGORY)
    category_of = {r["product_type"]: r["product_category"] for r in expected}
    products = {}
    for table in golden_tables(*PRODUCTS):
        if table and all(r["product_type"] in category_of for r in table):
            for r in table:
                products[r["product_detail"]] = r
    assert products
    rows = [line(i, "2023-01-01", "08:00:00", int(r["total_transactions"]), 3, "1.00",
                 category_of[r["product_type"]], r["product_type"], r["product_detail"])
            for i, r in enumerate(products.values())]
    df = make_sales(rows, enrich=False)
    mapping = F.create_map(*[x for k, r in products.items()
                             for x in (F.lit(k), F.lit(Decimal(r["total_revenue"])))])
    df = df.withColumn("revenue", mapping[F.col("product_detail")].cast("decimal(12,2)"))
    out = summarize(df, ["product_category", "product_type"],
                    {"total_products": ("distinct", "product_detail"), "total_transactions": "units",
                     "total_revenue": "revenue", "avg_transaction_value": "avg_unit_revenue"})
    got = {(r.product_type, r.product_category): (r.total_products, r.total_transactions, r.total_revenue,
                                                  r.avg_transaction_value) for r in out.collect()}
    for r in expected:
        want = (int(r["total_products"]), int(r["total_transactions"]), Decimal(r["total_revenue"]),
                Decimal(r["avg_transaction_value"]))
        assert got[(r["product_type"], r["product_category"])] == want, r


def test_store_and_combo_ratios(spark):
    stores = read_golden(*STORES)
    assert sum(Decimal(r["total_revenue"]) for r in stores) == Decimal("698812.33")
    combos = read_golden(*COMBOS)
    df = spark.createDataFrame([(Decimal(r["total_revenue"]), int(r["combo_transaction"]),
                                 Decimal(r["avg_transaction_value"])) for r in combos],
                               "rev decimal(22,2), n long, want decimal(10,2)")
    bad = df.where(ratio(F.col("rev"), exact(F.col("n")), 2) != F.col("want")).count()
    assert bad == 0


def test_price_list_shape(spark):
    rows = read_golden(*PRICE_LIST)
    assert len(rows) == 15
    for r in rows:
        prices = [Decimal(p) for p in r["price_range"].split(", ")]
        assert len(prices) >= 2 and prices == sorted(prices), r
    assert any(r["product_detail"].endswith(" ") for r in read_golden(*CATEGORY_RANK))


def test_dates_of_study_are_one_half_year(spark):
    months = {r["month"] for r in read_golden(*MONTHLY)}
    assert months == set(MONTH_NAMES[:6])
    assert dt.date(2023, 6, 30).month == 6


TYPES = ("product_type", "total_products", "total_transactions", "total_revenue", "avg_transaction_value")
TOP_PRODUCTS = ("product_detail", "product_type", "total_transactions", "total_revenue")


def test_type_table_from_product_rows(make_sales):
    """Types that also appear in per-product tables (top and bottom types):
    rolling those products up by type reproduces the type table's rows."""
    expected = {r["product_type"]: r for r in read_golden(*TYPES)}
    products = {}
    for header in (TOP_PRODUCTS, PRODUCTS):
        for table in golden_tables(*header):
            if table and all(r["product_type"] in expected for r in table):
                for r in table:
                    products[r["product_detail"]] = r
    assert products
    rows = [line(i, "2023-01-01", "08:00:00", int(r["total_transactions"]), 3, "1.00",
                 "Beverage", r["product_type"], r["product_detail"])
            for i, r in enumerate(products.values())]
    df = make_sales(rows, enrich=False)
    mapping = F.create_map(*[x for k, r in products.items()
                             for x in (F.lit(k), F.lit(Decimal(r["total_revenue"])))])
    df = df.withColumn("revenue", mapping[F.col("product_detail")].cast("decimal(12,2)"))
    out = summarize(df, ["product_type"],
                    {"total_products": ("distinct", "product_detail"), "total_transactions": "units",
                     "total_revenue": "revenue", "avg_transaction_value": "avg_unit_revenue"})
    got = {r.product_type: r for r in out.collect()}
    assert len(got) >= 8
    for t, r in got.items():
        want = expected[t]
        assert (r.total_products, r.total_transactions, r.total_revenue, r.avg_transaction_value) == (
            int(want["total_products"]), int(want["total_transactions"]), Decimal(want["total_revenue"]),
            Decimal(want["avg_transaction_value"])), t


def test_study_reports_reproduce_the_group_ranking(make_sales):
    """End to end through ``study_reports`` with the study's literals: a
    table with one line per product (its units and revenue from the exported
    tables) gives the exported group ranking exactly."""
    from tillroll.plans.reports import study_reports

    by_category = {r["product_detail"]: r for r in read_golden(*CATEGORY_RANK)}
    by_group = {r["product_detail"]: r for r in read_golden(*GROUP_RANK)}
    assert set(by_category) == set(by_group)
    rows = [line(i, "2023-01-02", "08:00:00", int(by_group[p]["total_transactions"]), 3, "1.00",
                 by_category[p]["product_category"], "T", p) for i, p in enumerate(sorted(by_group))]
    df = make_sales(rows, enrich=False)
    mapping = F.create_map(*[x for p, r in by_group.items()
                             for x in (F.lit(p), F.lit(Decimal(r["total_revenue"])))])
    df = df.withColumn("revenue", mapping[F.col("product_detail")].cast("decimal(12,2)"))
    out = study_reports(df)["product_rank_in_group"]
    got = {r.product_detail: (r.rank_by_revenue, r.category, r.total_transactions, r.total_revenue,
                              r.avg_transaction_value) for r in out.collect()}
    want = {p: (int(r["rank_by_revenue"]), r["category"], int(r["total_transactions"]),
                Decimal(r["total_revenue"]), Decimal(r["avg_transaction_value"])) for p, r in by_group.items()}
    assert got == want


def test_study_reports_reproduce_the_drill_downs(make_sales):
    """One line per product of every exported per-product table; the study's
    type and category drill-downs (E15-E22, with the study's literal lists)
    reproduce those exported tables exactly."""
    from tillroll.plans.params import STUDY
    from tillroll.plans.reports import study_reports

    category_of = {r["product_detail"]: r["product_category"] for r in read_golden(*CATEGORY_RANK)}
    products = {}
    for header in (TOP_PRODUCTS, PRODUCTS):
        for table in golden_tables(*header):
            for r in table:
                products[r["product_detail"]] = r
    rows = [line(i, "2023-01-02", "08:00:00", int(r["total_transactions"]), 3, "1.00",
                 category_of[p], r["product_type"], p) for i, (p, r) in enumerate(sorted(products.items()))]
    df = make_sales(rows, enrich=False)
    mapping = F.create_map(*[x for p, r in products.items()
                             for x in (F.lit(p), F.lit(Decimal(r["total_revenue"])))])
    reports = study_reports(df.withColumn("revenue", mapping[F.col("product_detail")].cast("decimal(12,2)")))

    def as_set(df_, cols):
        return {tuple(str(r[c]) for c in cols) for r in df_.collect()}

    def golden_set(table, cols):
        return {tuple(str(Decimal(r[c])) if c in ("total_revenue", "avg_transaction_value") else r[c]
                      for c in cols) for r in table}

    checks = 0
    for table in golden_tables(*TOP_PRODUCTS):
        if {r["product_type"] for r in table} == set(STUDY.top_types):
            assert as_set(reports["products_of_top_types"], TOP_PRODUCTS) == golden_set(table, TOP_PRODUCTS)
            checks += 1
    for table in golden_tables(*PRODUCTS):
        types = {r["product_type"] for r in table}
        cats = {category_of[r["product_detail"]] for r in table}
        if types <= set(STUDY.bottom_types):
            name = "products_of_bottom_types"
        elif cats == set(STUDY.two_categories):
            name = "products_in_categories"
        elif len(cats) == 1 and next(iter(cats)) in STUDY.one_categories:
            name = f"products_in_category[{next(iter(cats))}]"
        else:
            continue
        assert as_set(reports[name], PRODUCTS) == golden_set(table, PRODUCTS), name
        checks += 1
    assert as_set(reports["type_summary_by_category"], TYPES_BY_CATEGORY) == \
        golden_set(read_golden(*TYPES_BY_CATEGORY), TYPES_BY_CATEGORY)
    # E14 over the beverage types whose products are all exported (top and bottom types)
    covered = set(STUDY.top_types) | set(STUDY.bottom_types)
    e14 = {r for r in as_set(reports["type_summary_in_categories"], TYPES) if r[0] in covered}
    assert e14 == {r for r in golden_set(read_golden(*TYPES), TYPES) if r[0] in covered}
    assert len(e14) == len(covered)
    assert checks >= 6


def test_study_reports_reproduce_the_category_ranking(spark):
    """E7 breaks revenue ties by line count, so each product gets as many
    lines as the export reports (generated in Spark: about 149,000 lines),
    its units and revenue on the first one; the exported ranking, ties
    included, comes back exactly."""
    from tillroll.plans.reports import study_reports

    ranking = read_golden(*CATEGORY_RANK)
    units = {r["product_detail"]: int(r["total_transactions"]) for r in read_golden(*GROUP_RANK)}
    products = spark.createDataFrame(
        [(i, r["product_detail"], r["product_category"], int(r["total_transactions"]),
          units[r["product_detail"]], Decimal(r["total_revenue"])) for i, r in enumerate(ranking)],
        "pid long, product_detail string, product_category string, k int, units int, rev decimal(12,2)")
    first = F.col("i") == 1
    lines = products.select("*", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i")).select(
        (F.col("pid") * 1_000_000 + F.col("i")).alias("transaction_id"),
        F.lit("2023-01-02").cast("date").alias("transaction_date"),
        F.lit("08:00:00").alias("transaction_time"),
        F.when(first, F.col("units")).otherwise(F.lit(0)).alias("transaction_qty"),
        F.lit(3).alias("store_id"), F.lit("store 3").alias("store_location"),
        F.col("pid").cast("int").alias("product_id"),
        F.lit(Decimal("1.00")).cast("decimal(10,2)").alias("unit_price"),
        "product_category", F.lit("T").alias("product_type"), "product_detail",
        F.when(first, F.col("rev")).otherwise(F.lit(Decimal("0.00"))).cast("decimal(12,2)").alias("revenue"))
    assert lines.count() == sum(int(r["total_transactions"]) for r in ranking)
    out = study_reports(lines)["product_rank_in_category"]
    got = {(r.rank_by_revenue, r.product_detail, r.product_category, r.total_transactions, r.total_revenue)
           for r in out.collect()}
    want = {(int(r["rank_by_revenue"]), r["product_detail"], r["product_category"],
             int(r["total_transactions"]), Decimal(r["total_revenue"])) for r in ranking}
    assert got == want


def test_study_reports_reproduce_growth_and_price_list(make_sales):
    """Growth with the study's year-less labels, and the price-list text:
    one line per store and month carrying that month's revenue, and one line
    per product and price carrying the product's revenue on its first price."""
    from tillroll.plans.reports import study_reports

    months = read_golden(*MONTHLY)
    rows = [line(i, f"2023-{MONTH_NAMES.index(r['month']) + 1:02d}-01", "08:00:00", 1,
                 int(r["store_id"]), "1.00", "Coffee", "T", "P", location=r["store_location"])
            for i, r in enumerate(months)]
    price_rows = read_golden(*PRICE_LIST)
    revenue = {}
    for r in price_rows:
        for j, price in enumerate(r["price_range"].split(", ")):
            tid = 10_000 + len(rows)
            rows.append(line(tid, "2023-01-09", "09:00:00", 1, 3, price, r["product_category"],
                             r["product_type"], r["product_detail"]))
            revenue[tid] = Decimal(r["total_revenue"]) if j == 0 else Decimal("0.00")
    for i, r in enumerate(months):
        revenue[i] = Decimal(r["total_revenue"])
    df = make_sales(rows, enrich=False)
    mapping = F.create_map(*[x for tid, v in revenue.items() for x in (F.lit(tid), F.lit(v))])
    reports = study_reports(df.withColumn("revenue", mapping[F.col("transaction_id")].cast("decimal(12,2)")))

    price_stores = {3}   # the price lines add revenue to store 3 in January: compare the other stores
    got = {(r.store_id, r.month): (r.total_revenue, r.prev_month_revenue, r.mom_revenue_growth)
           for r in reports["store_mom_growth"].collect() if r.store_id not in price_stores}
    want = {(int(r["store_id"]), r["month"]): (_dec(r["total_revenue"]), _dec(r["prev_month_revenue"]),
                                               _dec(r["mom_revenue_growth"]))
            for r in months if int(r["store_id"]) not in price_stores}
    assert got == want and len(got) == 12
    got_q = {(r.store_id, r.quarter): r.qtr_revenue_growth
             for r in reports["store_qoq_growth"].collect() if r.store_id not in price_stores}
    want_q = {(int(r["store_id"]), r["quarter"]): _dec(r["qtr_revenue_growth"])
              for r in read_golden(*QUARTERLY) if int(r["store_id"]) not in price_stores}
    assert got_q == want_q

    got_p = [(r.product_detail, r.price_range, r.total_revenue) for r in reports["price_list"].collect()]
    want_p = [(r["product_detail"], r["price_range"], Decimal(r["total_revenue"])) for r in price_rows]
    assert sorted(got_p) == sorted(want_p)
    assert [p for p, _, _ in got_p] == [p for p, _, _ in want_p]    # revenue order


def test_weekday_order_matches_the_exported_order(spark):
    """The weekday × hour export is in Monday-first weekday order, then hour:
    the weekday sort key puts its rows in exactly that order."""
    from tillroll.functions.calendar import weekday_sort_key

    rows = read_golden("day_of_week", "hour", "avg_transaction_qty")
    df = spark.createDataFrame([(i, r["day_of_week"], int(r["hour"])) for i, r in enumerate(rows)],
                               "i int, day_of_week string, hour int")
    ordered = [r.i for r in df.orderBy(weekday_sort_key("day_of_week"), "hour").collect()]
    assert ordered == list(range(len(rows)))
    assert len({r["day_of_week"] for r in rows}) == 7


def golden_file(*columns):
    """The bytes of the single export with this header."""
    header = ",".join(f'"{c}"' for c in columns)
    (found,) = [p for p in sorted(GOLDEN_ROOT.rglob("*.csv")) if p.open(encoding="utf-8").readline().rstrip("\n") == header]
    return found.read_bytes()


def test_exported_growth_files_are_the_exports_byte_for_byte(make_sales, tmp_path):
    from tillroll.plans.reports import study_reports
    from tillroll.sources.sinks import export_report

    months = read_golden(*MONTHLY)
    rows = [line(i, f"2023-{MONTH_NAMES.index(r['month']) + 1:02d}-01", "08:00:00", 1, int(r["store_id"]), "1.00",
                 "Coffee", "T", "P", location=r["store_location"]) for i, r in enumerate(months)]
    revenue = F.create_map(*[x for i, r in enumerate(months) for x in (F.lit(i), F.lit(Decimal(r["total_revenue"])))])
    reports = study_reports(make_sales(rows, enrich=False).withColumn(
        "revenue", revenue[F.col("transaction_id")].cast("decimal(12,2)")))
    for name, columns in (("store_mom_growth", MONTHLY), ("store_qoq_growth", QUARTERLY)):
        export_report(reports[name], str(tmp_path / f"{name}.csv"))
        assert (tmp_path / f"{name}.csv").read_bytes() == golden_file(*columns), name
