"""The written sales table follows added files by joining only those."""

import os
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMOKE, have_data
from tillroll import session
from tillroll.sources import upkeep
from tillroll.operators import quality
from tillroll.sources.sales import INPUTS, build_sales, sales_quality, sales_upkeep
from tillroll.sources.tables import read_table


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Every table in folders, with a half of customer, orders, part and lineitem kept back."""
    if not have_data(SF_SMOKE):
        pytest.skip("no smoke data")
    root = tmp_path_factory.mktemp("halves")
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "lineitem": "l_orderkey"}
    for name in INPUTS:
        df = read_table(spark, SF_SMOKE, name)
        now = F.col(keys[name]) % 2 == 0 if name in keys else F.lit(True)
        df.where(now).coalesce(1).write.parquet(str(root / "in" / f"{name}.parquet"))
        if name in keys:
            df.where(~now).coalesce(1).write.parquet(str(root / "later" / f"{name}.parquet"))
    return root


@pytest.fixture
def parts(halves, tmp_path):
    """A copy of ``halves`` to change."""
    shutil.copytree(halves, tmp_path, dirs_exist_ok=True)
    return tmp_path


def add(parts, *names):
    for name in names:
        for f in (parts / "later" / f"{name}.parquet").glob("*.parquet"):
            shutil.copy(f, parts / "in" / f"{name}.parquet")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def check(spark, parts, table):
    done = table.refresh()
    assert rows(table._table(done.parts)) == rows(build_sales(spark, str(parts / "in")))
    return done


def test_only_added_files_are_joined(spark, parts):
    table = sales_upkeep(spark, str(parts / "in"), str(parts / "out"))
    assert check(spark, parts, table).action == "rebuild"
    assert check(spark, parts, table) == upkeep.Refresh("none", table.manifest()[1]["parts"])
    add(parts, "lineitem")
    done = check(spark, parts, table)
    assert done.action == "append" and done.read == [dict.fromkeys(INPUTS, 1)]  # one of its two lineitem files
    add(parts, "customer", "orders", "part")
    done = check(spark, parts, table)
    assert done.action == "append" and len(done.parts) == 5
    # Before the changed table: files as they were, after it: as they are now.
    counts = [tuple(r[n] for n in ("customer", "orders", "part", "lineitem")) for r in done.read]
    assert counts == [(1, 2, 2, 2), (1, 1, 2, 2), (1, 1, 1, 2)]
    assert check(spark, parts, table).action == "none"
    assert rows(build_sales(spark, str(parts / "in"))) == rows(build_sales(spark, SF_SMOKE))


def test_added_lines_read_a_range_of_orders(spark, parts, monkeypatch):
    table = sales_upkeep(spark, str(parts / "in"), str(parts / "out"))
    table.refresh()
    read_table(spark, SF_SMOKE, "lineitem").where("l_orderkey between 11 and 21").coalesce(1).write.mode(
        "append").parquet(str(parts / "in" / "lineitem.parquet"))
    plans, write = [], table._write
    monkeypatch.setattr(table, "_write", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    assert check(spark, parts, table).action == "append"
    assert "GreaterThanOrEqual(o_orderkey,11)" in plans[0] and "LessThanOrEqual(o_orderkey,21)" in plans[0]


def test_changed_and_removed_files_rebuild(spark, parts):
    table = sales_upkeep(spark, str(parts / "in"), str(parts / "out"))
    first = check(spark, parts, table).parts
    add(parts, "lineitem", "orders")
    check(spark, parts, table)
    (old,) = {f for f in (parts / "in" / "orders.parquet").glob("*.parquet")
              if not (parts / "later" / "orders.parquet" / f.name).exists()}
    os.remove(old)
    done = check(spark, parts, table)
    assert done.action == "rebuild" and len(done.parts) == 1
    read_table(spark, SF_SMOKE, "orders").where("o_orderkey < 100").coalesce(1).write.parquet(str(parts / "fresh"))
    (fresh,) = (parts / "fresh").glob("*.parquet")
    (kept,) = (parts / "in" / "orders.parquet").glob("*.parquet")
    for f in (parts / "in" / "orders.parquet").glob(".*.crc"):
        os.remove(f)
    shutil.copy(fresh, kept)
    assert check(spark, parts, table).action == "rebuild"
    assert set(table.vacuum()) >= set(first)
    assert check(spark, parts, table).action == "none"


def test_many_parts_become_one_without_the_join(spark, parts, monkeypatch):
    table = sales_upkeep(spark, str(parts / "in"), str(parts / "out"))
    table.most_parts = 2
    table.refresh()
    add(parts, "lineitem")
    table.refresh()
    add(parts, "orders")
    assert len(table.refresh().parts) == 3
    monkeypatch.setattr(table, "build", lambda read: pytest.fail("joined"))
    done = check(spark, parts, table)
    assert done.action == "compact" and len(done.parts) == 1


def test_two_writers_agree(spark, parts):
    """Both find no manifest and join; one is published, the other's draft is deleted."""
    tables = [sales_upkeep(spark, str(parts / "in"), str(parts / "out")) for _ in range(2)]
    meet, results = threading.Barrier(2), []

    def run(table):
        publish = table._publish
        table._publish = lambda *a: (table.__dict__.pop("_publish"), meet.wait(60), publish(*a))[2]
        results.append(table.refresh())

    threads = [threading.Thread(target=run, args=(t,)) for t in tables]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert results[0].parts == results[1].parts and sorted(r.action for r in results) == ["none", "rebuild"]
    assert [f.name for f in (parts / "out" / "parts").iterdir()] == results[0].parts


def test_another_layout_is_written_anew(spark, parts):
    table = sales_upkeep(spark, str(parts / "in"), str(parts / "out"))
    table.refresh()
    table.layout += ",more"
    assert table.refresh().action == "rebuild"


def test_quality_of_the_table_without_a_scan(spark, parts, monkeypatch):
    """Counts, NULLs, outliers and the date range ride on the writes and add up over parts."""
    here = str(parts / "in")
    read_table(spark, SF_SMOKE, "lineitem").where("l_orderkey < 40").withColumn(
        "l_quantity", F.when(F.col("l_linenumber") == 1, 0).when(F.col("l_linenumber") > 1, F.col("l_quantity"))).coalesce(
        1).write.mode("append").parquet(f"{here}/lineitem.parquet")
    for _ in range(2):  # as first written, and with appended parts
        got = {(r.measure, r.column_name): r.value for r in sales_quality(spark, here, str(parts / "out")).collect()}
        table = build_sales(spark, here)
        span = quality.date_range(table).first()
        assert got["rows", ""] == str(table.count())
        assert {c: got["nulls", c] for c in table.columns} == {
            r.column_name: str(r.null_count) for r in quality.null_profile(table).collect()}
        for c in ("transaction_qty", "unit_price"):
            assert got["nonpositive", c] == str(quality.nonpositive_rows(table, [c]).count())
        assert int(got["nonpositive", "transaction_qty"]) > 0
        assert (got["least", "transaction_date"], got["greatest", "transaction_date"]) == (str(span.min), str(span.max))
        add(parts, "lineitem", "orders")
    monkeypatch.setattr(upkeep.MaintainedJoin, "_table", lambda *a: pytest.fail("the table was read"))
    sales_upkeep(spark, here, str(parts / "out")).refresh()
    assert sales_quality(spark, here, str(parts / "out")).count() == len(got)


def test_measures_of_no_rows():
    columns = quality.combined_measures([{"rows:": "0", "least:d": None}, {"rows:": "0", "least:d": None}])
    assert columns == [("rows", "", "0"), ("least", "d", None)]


@pytest.fixture
def star(spark, tmp_path):
    """3,000 lines of own rows: a customer, order and part per key, customer 7 with a NULL nation."""
    made = {
        "region": (2, "id as r_regionkey", "concat('R', id) as r_name"),
        "nation": (3, "id as n_nationkey", "id % 2 as n_regionkey"),
        "customer": (50, "id as c_custkey", "if(id = 7, null, id % 3) as c_nationkey"),
        "orders": (1000, "id as o_orderkey", "id % 50 as o_custkey",
                   "timestamp_seconds(1700000000 + 9999 * id) as o_orderdate"),
        "part": (100, "id as p_partkey", "concat('P', id) as p_name", "concat('B', id % 5) as p_brand",
                 "concat('T', id % 4) as p_type", "id + 0.5D as p_retailprice"),
        "lineitem": (3000, "id div 3 as l_orderkey", "if(id < 1000, 1, id % 100) as l_partkey",
                     "cast(id % 3 as int) as l_linenumber", "double(1 + id % 4) as l_quantity", "id % 11 / 100D as l_discount"),
    }
    for name, (n, *columns) in made.items():
        spark.range(n).selectExpr(*columns).coalesce(1).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    return tmp_path


def files_and_most(spark, root, part):
    """Files of a part that hold rows, and the most rows in one."""
    df = spark.read.parquet(str(root / "out" / "parts" / part))
    counts = [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]
    return len(counts), max(counts)


def test_tasks_of_a_write_follow_the_input(spark, star, monkeypatch):
    """With more input for a task's share, more tasks join and sort it (the session's four
    shuffle partitions wrote four files), also where added files are joined and parts become one.
    Without AQE, which would put rows as few as these into one task."""
    monkeypatch.setattr(session, "TASK_BYTES", 4096)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        before = spark.conf.getAll
        table = sales_upkeep(spark, str(star / "in"), str(star / "out"))
        done = check(spark, star, table)
        files, most = files_and_most(spark, star, done.parts[0])
        assert files >= 8 and most <= 1500
        more = spark.range(3000, 6000).selectExpr(
            "id div 6 as l_orderkey", "id % 100 as l_partkey", "cast(id % 6 as int) as l_linenumber",
            "double(1) as l_quantity", "0D as l_discount")
        more.coalesce(1).write.mode("append").parquet(str(star / "in" / "lineitem.parquet"))
        done = check(spark, star, table)
        assert done.action == "append" and files_and_most(spark, star, done.parts[1])[0] >= 8
        table.most_parts = 1
        done = check(spark, star, table)
        assert done.action == "compact" and files_and_most(spark, star, done.parts[0])[0] >= 8
        assert spark.conf.getAll == before
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_sized_session_keeps_the_settings(spark):
    share = session.TASK_BYTES
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        small, large = (session.sized_session(spark, n * share) for n in (1, 100))
        assert small.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [s.conf.get("spark.sql.shuffle.partitions") for s in (spark, small, large)] == ["4", "4", "200"]
    assert large.sparkContext is spark.sparkContext and spark.conf.get("spark.sql.session.timeZone") == "UTC"
