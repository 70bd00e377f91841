import tempfile

from pyspark.sql import functions as F

from tillroll import __main__ as cli
from tillroll.sources.sinks import export_report, read_report, write_report


def test_csv_report_round_trip_keeps_blanks_and_nulls(spark):
    df = spark.createDataFrame([("Plain Scone ", 1, None), ("Latte", None, 2.5), ("", 2, None), (None, 3, 0.5)],
                               "name string, n int, v double")
    path = tempfile.mkdtemp(prefix="tillroll-csv-") + "/out"
    write_report(df, path)
    back = read_report(spark, path, "name string, n int, v double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_export_is_one_file_with_one_header_in_order(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").cast("int").alias("n"), (F.col("id") * 7919 % 20_000).alias("big"),
                                    F.concat(F.lit("x"), F.col("id").cast("string")).alias('the "name"'))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = df.orderBy(F.col("big").desc())
        export_report(out, str(tmp_path / "a" / "out.csv"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = (tmp_path / "a" / "out.csv").read_text().split("\n")
    assert lines[0] == '"n","big","the ""name"""' and lines[-1] == "" and len(lines) == 20_002
    rows = sorted(((i * 7919 % 20_000, i) for i in range(20_000)), reverse=True)
    assert lines[1:-1] == [f'{i},"{big}","x{i}"' for big, i in rows]
    assert [f.name for f in (tmp_path / "a").iterdir() if not f.name.endswith(".crc")] == ["out.csv"]


def test_export_of_nulls_quotes_breaks_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(None, None, 'a "b", c\nd'), (1, 2.5, "")], "n int, v double, t string").coalesce(1)
    for _ in range(2):  # the second one replaces the first
        export_report(df, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes() == b'"n","v","t"\n,"","a ""b"", c\nd"\n1,"2.5",""\n'
    export_report(df.limit(0), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_bytes() == b'"n","v","t"\n'


def test_command_line_exports_files(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(
        "transaction_id,transaction_date,transaction_time,transaction_qty,store_id,store_location,product_id,unit_price,"
        "product_category,product_type,product_detail\n1,2023-01-02,07:00:00,2,3,Astoria,5,3.50,Bakery,Scone,Plain Scone \n")
    cli.run(spark, str(tmp_path / "sales.csv"), str(tmp_path / "out"), "csv", "file", only=["distinct_stores", "store_summary"])
    assert (tmp_path / "out" / "store_summary.csv").read_text() == (
        '"store_id","store_location","total_revenue","total_transactions","avg_transaction_value"\n3,"Astoria","7.00","2","7.000"\n')
