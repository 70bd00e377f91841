"""Run every report of the study on one sales table and write each result.

    python -m tillroll --input /data/sales.csv --format csv --out /data/reports

Each report is written by the executors as its own folder under ``--out``
(CSV with a header, or parquet), or with ``--out-format file`` as one CSV file
like the study's exports; nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import SparkSession

from tillroll.plans.reports import study_reports
from tillroll.sources.sales import read_sales
from tillroll.sources.sinks import export_report, write_report


def folder_name(report: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", report).strip("_")


def run(spark: SparkSession, source: str, out: str, fmt: str = "parquet",
        out_format: str = "csv", only: list[str] | None = None) -> list[str]:
    reports = study_reports(read_sales(spark, source, fmt))
    written = []
    for name in reports:
        if only and name not in only:
            continue
        target = f"{out.rstrip('/')}/{folder_name(name)}"
        if out_format == "file":
            export_report(reports[name], f"{target}.csv")
        else:
            write_report(reports[name], target, fmt=out_format)
        written.append(name)
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m tillroll", description=__doc__.split("\n\n")[0])
    ap.add_argument("--input", required=True, help="sales table (the study's eleven columns)")
    ap.add_argument("--format", default="parquet", help="input format: parquet (default) or csv")
    ap.add_argument("--out", required=True, help="output folder, one sub-folder per report")
    ap.add_argument("--out-format", default="csv", choices=["csv", "parquet", "file"])
    ap.add_argument("--only", nargs="*", help="report names to run (default: all)")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("tillroll").getOrCreate()
    for name in run(spark, args.input, args.out, args.format, args.out_format, args.only):
        print(name)


if __name__ == "__main__":
    main()
