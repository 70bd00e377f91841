"""The ``sales`` fact: one row per product line, as the reports expect.

The driver's tables are a star schema, so the wide table is built once per
session by a Spark job (four joins) and written to the shared folder named by
``spark.checkpoint.dir``; every report then scans that table with pruned
columns and pushed filters instead of re-running the joins. A written table
also cuts lineage, so a lost executor costs a re-read, not a re-join. Files
added to the input later are joined and appended (``sources.upkeep``).

Join plan at scale: nation and region are lookups of fixed size (25 and 5
rows); they are broadcast after a row-count check. customer, orders, part
and lineitem grow with the data and are always joined by shuffle
(sort-merge, which spills, and which AQE splits when a key is skewed). Only
``store_id`` travels through the big joins; the store name is looked up at
the end. The table is written sorted inside each file by category, type and
product, so parquet row-group statistics let category and type filters skip
data.

Column mapping (driver table → sales column):

================  ====================================================
transaction_id    l_orderkey * 10 + l_linenumber (not unique: tests P3)
transaction_date  date of o_orderdate
transaction_time  time of o_orderdate as 'HH:mm:ss'
transaction_qty   l_quantity as INT
store_id / _loc.  region of the customer (r_regionkey / r_name)
product_id        l_partkey
unit_price        p_retailprice as DECIMAL(10,2)
product_category  p_type;  product_type p_brand;  product_detail p_name
customer_id       o_custkey
revenue           qty × price as DECIMAL(12,2)
transaction       date ' ' customer ' ' store   (the basket key)
tier_price        3.50 when l_discount <= 0.07 else 4.38 (a two-step price
                  per line, for the within-day price reports)
================  ====================================================
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tillroll.functions.money import PRICE_TYPE, line_revenue
from tillroll.operators.enrich import with_basket_key
from tillroll.operators.joins import bounded_broadcast
from tillroll.operators.quality import combined_measures, quality_measures
from tillroll.session import app_id, file_system, remove_at_exit, shared_dir
from tillroll.sources.tables import read_table, table_path
from tillroll.sources.upkeep import Link, MaintainedJoin, Read

# The base and raised price of the price-change study, and the
# discount at or below which a line counts as sold at the base price.
BASE_PRICE = "3.50"
HIKE_PRICE = "4.38"
BASE_DISCOUNT_MAX = 0.07

SALES_COLUMNS = (
    "transaction_id", "transaction_date", "transaction_time", "transaction_qty",
    "store_id", "store_location", "product_id", "unit_price", "product_category",
    "product_type", "product_detail", "customer_id", "revenue", "transaction", "tier_price",
)
BASKET_PARTS = ("transaction_date", "customer_id", "store_id")


def build_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lazy star join (no write). Prefer ``sales`` for repeated reports."""
    return star_join(partial(read_table, spark, sf_dir))


def star_join(read: Read) -> DataFrame:
    """The join of the tables that ``read`` returns by name."""
    region = read("region").select("r_regionkey", "r_name")
    nation = read("nation").select("n_nationkey", "n_regionkey")
    customer = read("customer").select("c_custkey", "c_nationkey")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    lineitem = read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")

    nation, region = bounded_broadcast(nation), bounded_broadcast(region)
    cust_store = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
                  .select("c_custkey", F.col("n_regionkey").alias("store_id")))
    order_store = (orders.join(cust_store, orders.o_custkey == cust_store.c_custkey)
                   .select("o_orderkey", "o_custkey", "o_orderdate", "store_id"))
    lines = (lineitem.join(order_store, lineitem.l_orderkey == order_store.o_orderkey)
             .join(part, lineitem.l_partkey == part.p_partkey)
             .join(region, F.col("store_id") == region.r_regionkey))

    qty = F.col("l_quantity").cast("int")
    price = F.col("p_retailprice").cast(PRICE_TYPE)
    df = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.date_format("o_orderdate", "HH:mm:ss").alias("transaction_time"),
        qty.alias("transaction_qty"),
        F.col("store_id"),
        F.col("r_name").alias("store_location"),
        F.col("l_partkey").alias("product_id"),
        price.alias("unit_price"),
        F.col("p_type").alias("product_category"),
        F.col("p_brand").alias("product_type"),
        F.col("p_name").alias("product_detail"),
        F.col("o_custkey").alias("customer_id"),
        line_revenue(qty, price).alias("revenue"),
        F.when(F.col("l_discount") <= F.lit(BASE_DISCOUNT_MAX), F.lit(BASE_PRICE))
         .otherwise(F.lit(HIKE_PRICE)).cast(PRICE_TYPE).alias("tier_price"),
    )
    return with_basket_key(df, BASKET_PARTS).select(*SALES_COLUMNS)


STUDY_BASKET_PARTS = ("transaction_date", "transaction_time", "store_id")


def prepare_sales(df: DataFrame) -> DataFrame:
    """A user's sales table (the study's eleven base columns) with the derived
    columns the reports read: ``revenue`` (qty × price) and the basket key
    ``transaction`` (date, time and store), each added only when missing. A
    column that already has one of these names must have its type."""
    for name, fits in (("revenue", NumericType), ("transaction", StringType)):
        if name in df.columns and not isinstance(df.schema[name].dataType, fits):
            raise TypeError(f"column {name} is {df.schema[name].dataType.simpleString()}, not what reports read")
    if "revenue" not in df.columns:
        df = df.withColumn("revenue", line_revenue("transaction_qty", "unit_price"))
    if "transaction" not in df.columns:
        df = with_basket_key(df, STUDY_BASKET_PARTS)
    return df


def read_sales(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a sales table with the study's base columns (parquet, or CSV with
    a header: read with an explicit schema, time of day as 'HH:mm:ss' text; a
    field that does not fit its type fails the read instead of becoming NULL)."""
    if fmt == "csv":
        df = (spark.read.schema(STUDY_SCHEMA).option("header", True).option("mode", "FAILFAST")
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .csv(path))
    else:
        df = spark.read.format(fmt).load(path)
    return prepare_sales(df)


STUDY_SCHEMA = ("transaction_id long, transaction_date date, transaction_time string, "
                "transaction_qty int, store_id int, store_location string, product_id int, "
                "unit_price decimal(10,2), product_category string, product_type string, "
                "product_detail string")


INPUTS = ("region", "nation", "customer", "orders", "part", "lineitem")
LINKS = (Link("lineitem", "l_orderkey", "orders", "o_orderkey"), Link("lineitem", "l_partkey", "part", "p_partkey"),
         Link("orders", "o_custkey", "customer", "c_custkey"))


def sales_upkeep(spark: SparkSession, sf_dir: str, root: str | None = None) -> MaintainedJoin:
    """The written sales table of ``sf_dir`` and its manifest. With ``root``, a
    folder of your own, it outlives the application, so the next one joins
    only the files that came since; otherwise it lies in the session's shared
    folder and is deleted when the driver ends."""
    if root is None:
        fs, target = file_system(spark, sf_dir)
        of = hashlib.sha1(fs.makeQualified(target).toString().encode()).hexdigest()[:16]
        root = f"{shared_dir(spark)}/tillroll-sales-{app_id(spark)}-{of}"
        if root not in _removed:
            _removed.add(root)
            remove_at_exit(spark, root)
    return MaintainedJoin(spark, root, {n: table_path(sf_dir, n) for n in INPUTS}, star_join, ",".join(SALES_COLUMNS),
                          LINKS, ("product_category", "product_type", "product_detail"),
                          measures=quality_measures(SALES_COLUMNS, ("transaction_qty", "unit_price"), ("transaction_date",)))


_removed: set[str] = set()  # folders that go when the driver ends


def sales(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """The wide sales table: joined once, then only for files that are added to
    the input (see ``sales_upkeep``); changed input is never served from an old copy."""
    return sales_upkeep(spark, sf_dir, root).read()


def sales_quality(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Rows, NULLs of each column, non-positive amounts and the date range of
    the whole sales table, from what was measured when its parts were written:
    (measure, column_name, value as text). No scan of the table."""
    rows = combined_measures(sales_upkeep(spark, sf_dir, root).measured())
    return spark.createDataFrame(rows, "measure string, column_name string, value string")


EVENT_BASKET_PARTS = ("transaction_date", "customer_id")
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value")


def event_lines(events: DataFrame) -> DataFrame:
    """``events`` rows as sales lines with a time of day: one unit per event,
    ``event_type`` as the store, ``value`` as revenue and a basket per user
    and day."""
    df = events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("ts").cast("date").alias("transaction_date"),
        F.date_format("ts", "HH:mm:ss").alias("transaction_time"),
        F.col("ts").alias("transaction_ts"),
        F.lit(1).alias("transaction_qty"),
        F.col("event_type").alias("store_location"),
        F.col("user_id").alias("customer_id"),
        F.col("value").cast("decimal(12,2)").alias("revenue"),
    )
    return with_basket_key(df, EVENT_BASKET_PARTS)


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as sales lines (see ``event_lines``); used by the
    hour-of-day reports."""
    return event_lines(read_table(spark, sf_dir, "events", *EVENT_COLUMNS))
